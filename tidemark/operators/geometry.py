"""Polygons and lines as tables: features, edges and boundary segments.

feature: fid long, name string, code string, rings array<array<struct<lon,lat>>>, xmin,
xmax, ymin, ymax. segment: fid, alon, alat, blon, blat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import spatial as S

RINGS = "array<array<struct<lon:double,lat:double>>>"


def with_bounds(features: DataFrame) -> DataFrame:
    """Add xmin, xmax, ymin, ymax over all vertices; null for a feature without any."""
    flat = F.flatten("rings")
    part = lambda field: F.transform(flat, lambda v: v[field])
    return features.withColumns({"xmin": F.array_min(part("lon")), "xmax": F.array_max(part("lon")), "ymin": F.array_min(part("lat")), "ymax": F.array_max(part("lat"))})


def _pairs(features: DataFrame, closed: bool, keep: list[str]) -> DataFrame:
    """Rows of ``keep`` and ring, seg, alon, alat, blon, blat: consecutive vertices; ``closed`` adds last to first."""
    rings = features.select(*keep, F.posexplode("rings").alias("ring", "r"))
    if closed:
        rings = rings.where(F.size("r") >= 3)
        ends = F.concat(F.slice("r", 2, F.size("r") - 1), F.slice("r", 1, 1))
        pairs = F.arrays_zip(F.col("r").alias("a"), ends.alias("b"))
    else:
        rings = rings.where(F.size("r") >= 2)
        pairs = F.arrays_zip(F.expr("slice(r, 1, size(r) - 1)").alias("a"), F.expr("slice(r, 2, size(r) - 1)").alias("b"))
    return rings.select(*keep, "ring", F.posexplode(pairs).alias("seg", "p")).select(
        *keep, "ring", "seg", F.col("p.a.lon").alias("alon"), F.col("p.a.lat").alias("alat"), F.col("p.b.lon").alias("blon"), F.col("p.b.lat").alias("blat")
    )


def edges(features: DataFrame) -> DataFrame:
    """Edges for the even-odd test: rings of three vertices or more, closed implicitly."""
    return _pairs(features, True, ["fid"])


def segments(features: DataFrame) -> DataFrame:
    """Boundary segments: consecutive vertices only, as given."""
    return _pairs(features, False, ["fid"])


def crop_segments(segs: DataFrame, box) -> DataFrame:
    """Segments whose bounds meet a crop box (closed). Kept or dropped whole, never cut."""
    return segs.where(
        (F.greatest("alon", "blon") >= box.min_lon) & (F.least("alon", "blon") <= box.max_lon) & (F.greatest("alat", "blat") >= box.min_lat) & (F.least("alat", "blat") <= box.max_lat)
    )


def crop_features(features: DataFrame, box) -> DataFrame:
    """Features whose bounds meet a crop box: plain comparisons, which reach a Parquet scan of stored bounds."""
    return features.where((F.col("xmax") >= box.min_lon) & (F.col("xmin") <= box.max_lon) & (F.col("ymax") >= box.min_lat) & (F.col("ymin") <= box.max_lat))


def fan_out(segs: DataFrame, parts: DataFrame) -> DataFrame:
    """Each segment to every partition whose crop box it meets: (pid, fid, alon, alat, blon, blat).

    ``parts`` (pid, min_lon, ...) is small by construction: its size is bounded by the
    tolerance of the partitioning, not by the data.
    """
    meets = (F.greatest("alon", "blon") >= F.col("min_lon")) & (F.least("alon", "blon") <= F.col("max_lon")) & (F.greatest("alat", "blat") >= F.col("min_lat")) & (F.least("alat", "blat") <= F.col("max_lat"))
    return segs.join(F.broadcast(parts), meets)


def _widest_gap(starts_ends: DataFrame, by: list[str]) -> DataFrame:
    """Per group of intervals (s, e) in 0..360: the covering arc (min_lon, max_lon, crosses).

    Intervals that start in the same hundredth of a degree are merged first (combined before
    the shuffle), so a group has at most 36,001 rows in the sweep, however many points it
    has. That closes only gaps below a hundredth of a degree, which never decide: an arc
    whose widest gap is under a degree is the whole circle. The sweep is a running maximum.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(*by).orderBy("s", "e")
    merged = starts_ends.groupBy(*by, F.floor(F.col("s") * 100).alias("_bin")).agg(F.min("s").alias("s"), F.max("e").alias("e"))
    swept = merged.withColumn("before", F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1)))
    gaps = swept.withColumn("gap", F.when(F.col("s") > F.col("before"), F.col("s") - F.col("before")))
    g = gaps.groupBy(*by).agg(
        F.min("s").alias("first"),
        F.max("e").alias("last"),
        # the first among the widest gaps: widest, then smallest start
        F.max(F.when(F.col("gap").isNotNull(), F.struct("gap", (-F.col("before")).alias("m")))).alias("inner"),
    )
    wrap = F.col("first") + 360.0 - F.col("last")
    inner = F.coalesce(F.col("inner.gap"), F.lit(-1.0))
    width = F.greatest(inner, wrap)
    start = F.when(wrap > inner, F.col("last")).otherwise(-F.col("inner.m"))
    g = g.withColumns({"_w": width, "_from": start})
    west, east = S.to180(S.norm360(F.col("_from") + F.col("_w"))), S.to180(S.norm360(F.col("_from")))
    whole = F.col("_w") < S.CIRCUMPOLAR_GAP_DEG
    return g.select(
        *by,
        F.when(whole, -180.0).otherwise(west).alias("min_lon"),
        F.when(whole, 180.0).otherwise(east).alias("max_lon"),
        F.when(whole, False).otherwise(west > east).alias("crosses_antimeridian"),
    )


def _split(start: Column, length: Column) -> Column:
    """An interval of the circle as one or two intervals of 0..360."""
    end = start + length
    iv = lambda s, e: F.struct(s.cast("double").alias("s"), e.cast("double").alias("e"))
    return F.when(end > 360.0, F.array(iv(start, F.lit(360.0)), iv(F.lit(0.0), end - 360.0))).otherwise(F.array(iv(start, end)))


def covering_arc(df: DataFrame, lon_a: Column, lon_b: Column, by: list[str]) -> DataFrame:
    """Per group, the smallest longitude arc that covers the intervals from lon_a to lon_b, the short way round."""
    start, length = S.edge_interval(lon_a, lon_b)
    ok = ~F.isnan(lon_a) & ~F.isnan(lon_b) & (F.abs(lon_a) < float("inf")) & (F.abs(lon_b) < float("inf"))
    rows = df.where(ok).select(*by, F.explode(_split(start, length)).alias("i")).select(*by, "i.s", "i.e")
    return _widest_gap(rows, by)


def regions_from_features(features: DataFrame) -> DataFrame:
    """One bounding box per name: longitudes by covering arc of the edges, latitudes over vertices; sorted by name."""
    named = features.where("name is not null")
    pairs = _pairs(named, False, ["name"])
    arcs = covering_arc(pairs, F.col("alon"), F.col("blon"), ["name"])
    # a vertex's latitude counts if its edge has finite longitudes, and every ring's last one
    fin = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    lats = pairs.where(fin(F.col("alon")) & fin(F.col("blon"))).select("name", F.col("alat").alias("lat"))
    lats = lats.union(named.select("name", F.explode("rings").alias("r")).where("size(r) > 0").select("name", F.element_at("r", -1)["lat"]))
    heights = lats.groupBy("name").agg(F.min(F.when(~F.isnan("lat"), F.col("lat"))).alias("min_lat"), F.max(F.when(~F.isnan("lat"), F.col("lat"))).alias("max_lat"))
    out = arcs.join(heights, "name").withColumn("source", F.lit("data"))
    return out.select("name", "min_lon", "max_lon", "min_lat", "max_lat", "crosses_antimeridian", "source").orderBy("name")
