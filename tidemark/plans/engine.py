"""The commands: coast, depth, sea, place, nearest, regions, and all of them in one run."""

from __future__ import annotations

import logging
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import spatial as S
from tidemark.operators import geometry as G
from tidemark.operators import lookups as L
from tidemark.operators.locations import KEYS, check_clashes, coordinate, finite, join_back, unique_locations, with_keys
from tidemark.plans import partition as P
from tidemark.plans import region as R
from tidemark.plans.settings import Box, Settings
from tidemark.plans.staging import staged
from tidemark.sources.areas import PRESETS, SEA_AREAS

log = logging.getLogger("tidemark")

#: Degrees by which a crop grows when answers reach past it.
WIDEN_SLACK, WIDEN_MIN_STEP_DEG, WIDEN_MAX_DEG = 1.25, 5.0, 40.0
DOUBLE, STRING, BOOLEAN = T.DoubleType(), T.StringType(), T.BooleanType()
AREA = "name string, min_lon double, max_lon double, min_lat double, max_lat double, crosses_antimeridian boolean, source string"


@dataclass
class Lookup:
    """One enrichment: its output columns and how locations get them.

    ``find(locs, box, center)`` answers for one region; ``find_parts(locs, parts)`` for
    locations that carry pid, clon and clat, and adds ``shortfall`` (metres by which an
    answer reaches past its crop, infinite if nothing was found). Commands without a
    region have no ``find_parts``. What ``find`` returns may carry ``n_references``, by what the
    references are called: none left is told.
    """

    outputs: list[T.StructField]
    find: Callable[[DataFrame, Box, tuple[float, float]], DataFrame]
    find_parts: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    projected: bool = False
    #: Reference data by what it is called, and how it is cropped to a box; told about where nothing is left.
    references: dict[str, tuple[DataFrame, Callable[[DataFrame, Box], DataFrame] | None]] = field(default_factory=dict)
    #: Points (lon, lat) of the references, of each kind that is looked for: the nearest one bounds how far an answer lies. A kind's answers past its cutoff (metres) don't count.
    vertices: list[tuple[DataFrame, float | None]] = field(default_factory=list)


def _from(df: DataFrame, **found: DataFrame) -> DataFrame:
    """``df``, with the numbers of references that its parts were answered from."""
    df.n_references = {k.replace("_", " "): f.n_references for k, f in found.items()}
    return df


@dataclass
class Report:
    rows: int = 0
    unique: int = 0
    unresolved: int = 0
    rebuilds: int = 0
    parts: int = 0
    worst_distortion: float = 0.0
    notes: list[str] = field(default_factory=list)


def unit_scale(unit: str) -> float:
    if unit not in ("km", "m"):
        raise ValueError(f"unknown unit '{unit}', expected km or m")
    return 1000.0 if unit == "km" else 1.0


def _crop_of(parts: DataFrame) -> DataFrame:
    """Crop boxes: a part's box, its extra degrees and the usual margin."""
    grow = F.col("extra") + S.CROP_MARGIN_DEG
    return parts.select("pid", "clon", "clat", (F.col("min_lon") - grow).alias("min_lon"), (F.col("max_lon") + grow).alias("max_lon"), (F.col("min_lat") - grow).alias("min_lat"), (F.col("max_lat") + grow).alias("max_lat"))


def _short(found: DataFrame, crops: DataFrame, metres: str) -> Column:
    reach = S.crop_reach(F.col("lon"), F.col("lat"), F.col("min_lon"), F.col("max_lon"), F.col("min_lat"), F.col("max_lat"))
    return F.when(F.col(metres).isNull(), F.lit(float("inf"))).otherwise(F.greatest(F.lit(0.0), F.col(metres) - reach))


def coast_lookup(shoreline: DataFrame, unit: str = "km", column: str = "dist_to_coast") -> Lookup:
    """``shoreline``: segments (fid, alon, alat, blon, blat)."""
    scale = unit_scale(unit)

    def find(locs: DataFrame, box: Box, center: tuple[float, float]) -> DataFrame:
        near = L.nearest_segments(locs, G.crop_segments(shoreline, box.grown(S.CROP_MARGIN_DEG)), *center)
        return _from(near.select(*KEYS, (F.col("metres") / scale).alias(column)), shoreline=near)

    def find_parts(locs: DataFrame, parts: DataFrame) -> DataFrame:
        crops = _crop_of(parts)
        near = L.nearest_segments(locs, G.fan_out(shoreline, crops)).select(*KEYS, "metres")
        both = locs.join(near, KEYS, "left").join(F.broadcast(crops.drop("clon", "clat")), "pid")
        return both.select(*KEYS, "pid", (F.col("metres") / scale).alias(column), _short(both, crops, "metres").alias("shortfall"))

    ends = shoreline.select(F.col("alon").alias("lon"), F.col("alat").alias("lat")).union(shoreline.select("blon", "blat"))
    return Lookup([T.StructField(column, DOUBLE)], find, find_parts, True, {"shoreline": (shoreline, G.crop_segments)}, [(ends, None)])


def _vertices(features: DataFrame) -> DataFrame:
    return features.select(F.explode(F.flatten("rings")).alias("v")).select("v.lon", "v.lat")


def _fan_features(features: DataFrame, crops: DataFrame) -> DataFrame:
    meets = (F.col("xmax") >= F.col("min_lon")) & (F.col("xmin") <= F.col("max_lon")) & (F.col("ymax") >= F.col("min_lat")) & (F.col("ymin") <= F.col("max_lat"))
    return features.join(F.broadcast(crops), meets).drop("min_lon", "max_lon", "min_lat", "max_lat")


def _located(locs: DataFrame, features: DataFrame, parts: DataFrame) -> DataFrame:
    """locs with fid, metres and shortfall; contained locations are never short."""
    crops = _crop_of(parts)
    found = L.locate(locs, _fan_features(features, crops))
    both = locs.join(found, KEYS, "left").join(F.broadcast(crops.drop("clon", "clat")), "pid")
    return both.select(*locs.columns, "fid", "metres", F.when(F.col("metres") == 0.0, 0.0).otherwise(_short(both, crops, "metres")).alias("shortfall"))


def sea_lookup(seas: DataFrame, column: str = "sea_name") -> Lookup:
    """``seas``: features. The sea a location lies in, else the one with the nearest boundary."""
    seas = seas.where("name is not null") if "xmin" in seas.columns else G.with_bounds(seas.where("name is not null"))
    names = seas.select("fid", F.col("name").alias(column)).dropDuplicates(["fid"])

    def find(locs: DataFrame, box: Box, center: tuple[float, float]) -> DataFrame:
        found = L.locate(locs, G.crop_features(seas, box.grown(S.CROP_MARGIN_DEG)), *center)
        return _from(found.join(names, "fid").select(*KEYS, column), sea_areas=found)

    def find_parts(locs: DataFrame, parts: DataFrame) -> DataFrame:
        return _located(locs, seas, parts).join(names, "fid", "left").select(*KEYS, "pid", column, "shortfall")

    return Lookup([T.StructField(column, STRING)], find, find_parts, True, {"sea areas": (seas, G.crop_features)}, [(_vertices(seas), None)])


def place_lookup(countries: DataFrame, municipalities: DataFrame | None = None, max_municipality_dist: float | None = None, unit: str = "km") -> Lookup:
    """Country and code, municipality and its distance; a municipality past the cutoff loses both."""
    scale = unit_scale(unit)
    ready = lambda f: (f if "xmin" in f.columns else G.with_bounds(f)).where("name is not null")
    countries = ready(countries)
    municipalities = ready(municipalities) if municipalities is not None else None
    c_names = countries.select("fid", F.col("name").alias("country"), F.col("code").alias("country_code")).dropDuplicates(["fid"])
    outputs = [T.StructField(n, STRING) for n in ("country", "country_code", "municipality")]
    if municipalities is None:
        log.info("no municipalities given: the column stays empty")
        if max_municipality_dist is not None:
            log.warning("a cutoff for municipalities has no effect: no municipalities given")
    else:
        outputs.append(T.StructField("municipality_dist", DOUBLE))

    def muni(found: DataFrame, extra: list[str]) -> DataFrame:
        names = municipalities.select("fid", F.col("name").alias("municipality")).dropDuplicates(["fid"])
        d = F.col("metres") / scale
        near = F.lit(True) if max_municipality_dist is None else d <= F.lit(float(max_municipality_dist))
        joined = found.join(names, "fid", "left")
        return joined.select(*KEYS, F.when(near, F.col("municipality")).alias("municipality"), F.when(near, d).alias("municipality_dist"), *extra)

    def find(locs: DataFrame, box: Box, center: tuple[float, float]) -> DataFrame:
        crop = box.grown(S.CROP_MARGIN_DEG)
        held = L.locate(locs, G.crop_features(countries, crop), *center)
        out = held.join(c_names, "fid").select(*KEYS, "country", "country_code")
        if municipalities is None:
            return _from(out.withColumn("municipality", F.lit(None).cast("string")), countries=held)
        near = L.locate(locs, G.crop_features(municipalities, crop), *center)
        return _from(out.join(muni(near, []), KEYS, "full"), countries=held, municipalities=near)

    def find_parts(locs: DataFrame, parts: DataFrame) -> DataFrame:
        out = _located(locs, countries, parts).join(c_names, "fid", "left").select(*KEYS, "pid", "country", "country_code", "shortfall")
        if municipalities is None:
            return out.withColumn("municipality", F.lit(None).cast("string"))
        found = _located(locs, municipalities, parts)
        # a match past the cutoff is dropped anyway: no need to look for a nearer one
        if max_municipality_dist is not None:
            past = F.col("metres") > max_municipality_dist * scale
            found = found.withColumn("shortfall", F.when(past, 0.0).otherwise(F.col("shortfall")))
        m = muni(found, [F.col("shortfall").alias("_s")])
        return out.join(m, KEYS, "left").withColumn("shortfall", F.greatest("shortfall", F.coalesce("_s", F.lit(0.0)))).drop("_s")

    references = {"countries": (countries, G.crop_features)} | ({"municipalities": (municipalities, G.crop_features)} if municipalities is not None else {})
    cutoff = None if max_municipality_dist is None else max_municipality_dist * scale
    vertices = [(_vertices(countries), None), *([(_vertices(municipalities), cutoff)] if municipalities is not None else [])]
    return Lookup(outputs, find, find_parts, True, references, vertices)


def nearest_lookup(points: DataFrame, lon_col: str = "longitude", lat_col: str = "latitude", name_field: str = "name", unit: str = "km", name_column: str = "nearest_name", dist_column: str = "nearest_dist", order_by: str | None = None) -> Lookup:
    """Nearest row of a second table by great circle. Of equals, the first by ``order_by``, then by name and place."""
    scale = unit_scale(unit)
    if name_field not in points.columns:
        raise ValueError(f"the second table has no column '{name_field}'")
    at = points.select(F.col(f"`{name_field}`").cast("string").alias("name"), coordinate(points, lon_col).alias("lon"), coordinate(points, lat_col).alias("lat"), (F.col(f"`{order_by}`") if order_by else F.lit(0)).alias("_o"))
    at = at.where(finite(F.col("lon")) & finite(F.col("lat")))
    # what orders equals also tells rows apart, and it carries the answer
    refs = at.select(F.struct("_o", "name", "lon", "lat").alias("rid"), "lon", "lat").distinct()

    def find(locs: DataFrame, box: Box, center: tuple[float, float]) -> DataFrame:
        found = L.nearest_points(locs, refs)
        return _from(found.select(*KEYS, F.col("rid.name").alias(name_column), (F.col("metres") / scale).alias(dist_column)), second_table=found)

    return Lookup([T.StructField(name_column, STRING), T.StructField(dist_column, DOUBLE)], find, references={"second table": (refs, None)})


def depth_lookup(grid: DataFrame, lat_axis: tuple[float, float, int], lon_axis: tuple[float, float, int], positive: bool = False, on_land: bool = False, column: str = "bathymetry") -> Lookup:
    """Nearest grid cell's elevation; ``on_land`` is judged before the sign is turned and null off the grid."""
    outputs = [T.StructField(column, DOUBLE), *([T.StructField("on_land", BOOLEAN)] if on_land else [])]

    def find(locs: DataFrame, box: Box, center: tuple[float, float]) -> DataFrame:
        found = L.grid_lookup(locs, grid, lat_axis, lon_axis)
        e = F.col("elevation")
        land = F.when(~F.isnan(e), e >= 0.0)
        return found.select(*KEYS, (-e if positive else e).alias(column), *([land.alias("on_land")] if on_land else []))

    return Lookup(outputs, find)


def custom_lookup(outputs: list[T.StructField], lookup: Callable[[DataFrame], DataFrame]) -> Lookup:
    """A lookup of one's own: ``lookup`` takes (_klon, _klat, lon, lat) and returns the keys and the output columns."""
    return Lookup(outputs, lambda locs, box, center: lookup(locs))


def row_lookup(outputs: list[T.StructField], answer: Callable[[float, float], tuple | None]) -> Lookup:
    """A lookup of a plain function (lon, lat) -> values, or None for no answer: called once per distinct location, in tasks."""
    keys = [T.StructField(k, T.LongType()) for k in KEYS]
    schema = T.StructType([*keys, *outputs])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            rows = [(r, answer(r["lon"], r["lat"])) for r in b.to_pylist()]
            made = [dict(zip(schema.names, (*(r[k] for k in KEYS), *got), strict=True)) for r, got in rows if got is not None]
            yield pa.RecordBatch.from_pylist(made, arrow)

    return Lookup(outputs, lambda locs, box, center: locs.mapInArrow(answers, schema))


def _reaching(x: Lookup, locs: DataFrame, parts: DataFrame) -> DataFrame:
    """``parts`` with ``extra``: degrees by which a crop must grow to hold every location's answer.

    The nearest vertex on the sphere is at least as far as the nearest reference, so a crop
    that reaches it (and what the projection may stretch) holds the answer.
    """
    need = None
    for points, cutoff in x.vertices:
        near = L.nearest_points(locs, points.withColumn("rid", F.lit(0))).select(*KEYS, (F.col("metres") if cutoff is None else F.least("metres", F.lit(cutoff))).alias("need"))
        need = near if need is None else need.union(near)
    if need is None:
        return parts.withColumn("extra", F.lit(0.0))
    far = need.groupBy(*KEYS).agg((F.max("need") * (1 + 1.5 * S.DISTORTION_LIMIT) / S.REACH_SAFETY / S.METRES_PER_DEGREE).alias("_ns"))
    both = locs.select(*KEYS, "lon", "lat", "pid").join(far, KEYS).join(F.broadcast(parts.select("pid", "min_lon", "max_lon", "min_lat", "max_lat")), "pid")
    ew = F.col("_ns") / F.cos(F.radians(F.least(F.abs(F.col("lat")), F.lit(89.9))))
    short = F.greatest(F.col("_ns") - F.least(F.col("lat") - F.col("min_lat"), F.col("max_lat") - F.col("lat")), ew - F.least(F.col("lon") - F.col("min_lon"), F.col("max_lon") - F.col("lon")))
    grown = both.groupBy("pid").agg(F.greatest(F.lit(0.0), F.least(F.lit(WIDEN_MAX_DEG), F.max(short) - S.CROP_MARGIN_DEG)).alias("_extra"))
    known = {r["pid"]: r["_extra"] for r in grown.collect()}  # a few dozen parts
    rows = [(*r, float(known.get(r["pid"], 0.0))) for r in parts.collect()]
    return parts.sparkSession.createDataFrame(rows, T.StructType([*parts.schema, T.StructField("extra", DOUBLE)]))


class Engine:
    """Runs lookups over a table of points.

    ``report`` tells about the last run. Its counts are gathered by the job that writes the
    result, and are there shortly after that job is done (:meth:`told` waits for them). With ``count`` they are there when
    :meth:`run` returns, at the price of jobs of their own.
    """

    def __init__(self, spark: SparkSession, settings: Settings | None = None, count: bool = False):
        self.spark, self.settings, self.count, self._report, self._seen = spark, settings or Settings(), count, Report(), []

    @property
    def report(self) -> Report:
        return self.told(0)

    def told(self, seconds: float = 30) -> Report:
        """The report, once the job that wrote the result has told its counts: shortly after it ended. Without such a job, what is known after ``seconds``."""
        until = time.monotonic() + seconds
        # one job gathers both, and tells of one before the other
        while self._seen and not all(x._jo.future().isCompleted() for x in self._seen):
            if time.monotonic() >= until:
                return self._report
            time.sleep(0.05)
        seen, self._seen = self._seen, []
        if seen:
            self._take({k: v for x in seen for k, v in x.get.items()})
        return self._report

    def _take(self, found: dict) -> None:
        r = self._report
        r.rows, r.unique, r.unresolved = (found.get(k, getattr(r, k)) for k in ("rows", "unique", "unresolved"))
        if found.get("far") is not None:
            r.worst_distortion = abs(math.sqrt((1 + math.cos(found["far"] / S.MEAN_RADIUS)) / 2) - 1)
            if r.worst_distortion >= S.DISTORTION_LIMIT:
                self._note(f"the farthest location is {found['far'] / 1000:.0f} km from the projection center: distances there are off by {100 * r.worst_distortion:.1f}%")

    def run(self, df: DataFrame, *lookups: Lookup) -> DataFrame:
        """Append every lookup's columns: rows are reduced once, and each answer is joined back by key."""
        s, self._report, self._seen = self.settings, Report(), []
        outputs = [f for x in lookups for f in x.outputs]
        check_clashes(df, [f.name for f in outputs], s.overwrite)
        coordinate(df, s.lon_col), coordinate(df, s.lat_col)
        projected = any(x.projected for x in lookups)
        if projected and not s.partition:
            s = R.settle(df, s)
        self.region = s
        keyed = with_keys(df, s.lon_col, s.lat_col, s.decimals)
        locs = unique_locations(keyed, s.decimals)
        if projected and s.partition:
            locs = staged(locs)
            owned, parts = P.partition(locs)
            owned = staged(owned)
            row = parts.agg(F.count("*").alias("n"), F.max("distortion").alias("d")).first()
            self._report.parts, self._report.worst_distortion = row["n"], row["d"]
            log.info("%d parts, worst distortion %.2f%%", row["n"], 100 * row["d"])
        results = None
        for x in lookups:
            got = self._widened(x, owned, parts) if s.partition and x.find_parts else x.find(locs.select(*KEYS, "lon", "lat"), s.box, (s.proj_lon0, s.proj_lat0))
            self._tell_empty(x, getattr(got, "n_references", {}))
            results = got if results is None else results.join(got, KEYS, "full")
        # what there is to tell about locations and rows is summed where they pass anyway
        empty = [F.isnan(f.name) | F.col(f.name).isNull() if isinstance(f.dataType, T.DoubleType) else F.col(f.name).isNull() for f in outputs]
        far = [F.max(S.haversine(s.proj_lon0, s.proj_lat0, F.col("lon"), F.col("lat"))).alias("far")] if projected and not s.partition else []
        told = [F.count("*").alias("unique"), F.count_if(reduce(Column.__and__, empty)).alias("unresolved"), *far]
        answers = locs.join(results, KEYS, "left")
        if self.count:
            self._take(answers.agg(*told).first().asDict() | {"rows": df.count()})
        elif not df.isStreaming:
            self._seen = [Observation(), Observation()]
            keyed, answers = keyed.observe(self._seen[0], F.count("*").alias("rows")), answers.observe(self._seen[1], *told)
        return join_back(keyed, answers, outputs, s.null_floats)

    def _note(self, text: str) -> None:
        self._report.notes.append(text)
        log.warning(text)

    def _tell_empty(self, x: Lookup, found: dict[str, int]) -> None:
        """A note for reference data of which nothing is there, or nothing in the crop: the search has counted it, but for parts."""
        for what in x.references:
            n = found.get(what)
            if n == 0 or n is None and x.references[what][0].isEmpty():
                within = f" within {self.region.box.grown(S.CROP_MARGIN_DEG)}" if n == 0 and x.projected else ""
                self._note(f"no {what}{within}: its columns stay empty")

    def _widened(self, x: Lookup, locs: DataFrame, parts: DataFrame) -> DataFrame:
        """Answer part by part, each crop as wide as its locations need; crops that answers still reach past (across the seam) are widened and asked again."""
        names = [f.name for f in x.outputs]
        parts = _reaching(x, locs, parts)
        done = None
        while True:
            found = staged(x.find_parts(locs, parts))
            short = found.groupBy("pid").agg(F.max("shortfall").alias("short"))
            rows = [r.asDict() for r in parts.join(short, "pid").collect()]  # a few dozen parts
            retry = [r for r in rows if r["short"] > 0 and r["extra"] < WIDEN_MAX_DEG]
            again = {r["pid"] for r in retry}
            settled = found.where(~F.col("pid").isin(sorted(again))) if again else found
            done = settled.select(*KEYS, *names) if done is None else done.union(settled.select(*KEYS, *names))
            if not retry:
                return done
            self._report.rebuilds += len(retry)
            log.info("%d parts have answers beyond their crop, by up to %.0f km: widened", len(retry), max(r["short"] for r in retry) / 1000)
            for r in retry:
                want = WIDEN_MAX_DEG if r["short"] == float("inf") else r["extra"] + r["short"] / S.METRES_PER_DEGREE * WIDEN_SLACK
                r["extra"] = min(max(want, min(r["extra"] + WIDEN_MIN_STEP_DEG, WIDEN_MAX_DEG)), WIDEN_MAX_DEG)
                r.pop("short")
            parts = self.spark.createDataFrame([tuple(r[c] for c in parts.columns) for r in retry], parts.schema)
            locs = locs.where(F.col("pid").isin(sorted(again)))

    def coast(self, df: DataFrame, shoreline: DataFrame, **options) -> DataFrame:
        return self.run(df, coast_lookup(shoreline, **options))

    def sea(self, df: DataFrame, seas: DataFrame, **options) -> DataFrame:
        return self.run(df, sea_lookup(seas, **options))

    def place(self, df: DataFrame, countries: DataFrame, municipalities: DataFrame | None = None, **options) -> DataFrame:
        return self.run(df, place_lookup(countries, municipalities, **options))

    def nearest(self, df: DataFrame, points: DataFrame, **options) -> DataFrame:
        return self.run(df, nearest_lookup(points, **options))

    def depth(self, df: DataFrame, grid: DataFrame, lat_axis: tuple[float, float, int], lon_axis: tuple[float, float, int], **options) -> DataFrame:
        return self.run(df, depth_lookup(grid, lat_axis, lon_axis, **options))

    def regions(self, features: DataFrame | None = None, name: str | None = None) -> DataFrame:
        """The built-in areas, or one box per name of ``features``; ``name`` filters by part of it in any case."""
        if features is None:
            rows = [(n, *b, False, "preset") for n, *b in PRESETS] + [(n, *b, c, "iho") for n, *b, c in SEA_AREAS]
            areas = self.spark.createDataFrame(rows, AREA)
        else:
            areas = G.regions_from_features(features)
        if name is None:
            return areas
        areas = areas.where(F.lower("name").contains(name.lower()))
        if areas.isEmpty():
            raise ValueError(f"no area name contains '{name}'")
        return areas
