"""Regions derived from the data: one aggregate job, then arithmetic on a handful of numbers."""

from __future__ import annotations

import logging
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import spatial as S
from tidemark.operators import geometry as G
from tidemark.operators.locations import coordinate, finite
from tidemark.plans.settings import Box, Settings

log = logging.getLogger("tidemark")


def spherical_center(df: DataFrame, lon: Column, lat: Column, by: list[str] | None = None) -> DataFrame:
    """Mean direction: lon0, lat0 and the length of the mean vector; null where the vectors cancel."""
    x, y, z = S.unit_sphere(F.col("_lon"), F.col("_lat"))
    at = df.select(*(by or []), lon.alias("_lon"), lat.alias("_lat")).where(finite(F.col("_lon")) & finite(F.col("_lat")))
    m = at.groupBy(*(by or [])).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg(z).alias("z"), F.min("_lat").alias("min_lat"), F.max("_lat").alias("max_lat"), F.count("*").alias("n"))
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    m = m.withColumn("resultant", r).withColumn("_ok", F.col("resultant") >= 1e-12)
    safe = F.when(F.col("_ok"), F.col("resultant"))
    return m.select(*(by or []), F.when(F.col("_ok"), F.degrees(F.atan2("y", "x"))).alias("lon0"), F.degrees(F.asin(F.col("z") / safe)).alias("lat0"), "resultant", "min_lat", "max_lat", "n")


def auto_box(west: float, east: float, crosses: bool, min_lat: float, max_lat: float) -> Box:
    """The points' extent, padded and clamped; all longitudes where it crosses the antimeridian."""
    return Box(
        -180.0 if crosses else max(west - S.AUTO_PAD_DEG, -180.0),
        180.0 if crosses else min(east + S.AUTO_PAD_DEG, 180.0),
        max(min_lat - S.AUTO_PAD_DEG, -90.0),
        min(max_lat + S.AUTO_PAD_DEG, 90.0),
    )


def settle(df: DataFrame, s: Settings) -> Settings:
    """Put the region the points give in place of an automatic one. Every row counts, unrounded, repeats included."""
    if s.auto is None:
        return s
    at = df.select(coordinate(df, s.lon_col).alias("lon"), coordinate(df, s.lat_col).alias("lat")).where(finite(F.col("lon")) & finite(F.col("lat")))
    c = spherical_center(at, F.col("lon"), F.col("lat")).first()
    if not c["n"]:
        log.warning("no usable coordinates: the region falls back to the whole globe, centered on (0, 0)")
        return replace(s, auto=None)
    arc = G.covering_arc(at, F.col("lon"), F.col("lon"), []).first()
    if c["lon0"] is None:
        log.warning("the points cancel around the globe and have no mean direction: the region falls back to the globe; partition the run if distances matter")
        return replace(s, auto=None)
    spread = c["resultant"] < S.NO_CENTER_RESULTANT
    if arc["crosses_antimeridian"] and not spread:
        log.info("the points span the antimeridian: the crop keeps every longitude")
    box = s.auto.box(auto_box(arc["min_lon"], arc["max_lon"], arc["crosses_antimeridian"], c["min_lat"], c["max_lat"]))
    lon0, lat0 = s.auto.center((c["lon0"], c["lat0"]))
    log.info("region %s, projection centered on (%.2f, %.2f)", box, lon0, lat0)
    if spread:
        log.warning("the points are spread too widely for one projection (clustering %.2f of 1.00): partition the run", c["resultant"])
    return replace(s, box=box, proj_lon0=lon0, proj_lat0=lat0, auto=None)
