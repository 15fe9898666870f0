"""Named polygons from GeoJSON and shapefiles, and the shoreline as segments."""

from __future__ import annotations

from fnmatch import fnmatch
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import geometry as G
from tidemark.plans.staging import hadoop
from tidemark.sources.shapefile import read_shapes

#: Attributes tried for names and codes, in this order.
COUNTRY_NAMES = ["NAME", "ADMIN", "NAME_EN", "NAME_LONG"]
COUNTRY_CODES = ["ISO_A3", "ADM0_A3", "ISO_A3_EH"]
MUNICIPALITY_NAMES = ["LAU_NAME", "LAU_LABEL", "NAME"]


def clean_text(c: Column) -> Column:
    """Trimmed; empty and -99 count as missing."""
    return F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit("-99"))


def first_text(df: DataFrame, candidates: list[str]) -> Column:
    """The first candidate column with a text; columns that aren't text are passed over."""
    found = [clean_text(F.col(f"`{c}`")) for c in candidates if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


_FEATURE = "type string, properties string, geometry struct<type:string,coordinates:string>"


def _in_ranges(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows (p, kind, c, at) of a FeatureCollection read in byte ranges, or None if the file can't be: each feature must start with its type, as writers of the format do.

    The text source splits at ``"Feature"`` in any file system it reads. What follows is a
    feature and the start of the next; a piece that isn't (the word inside a property, say)
    doesn't parse or doesn't end so, and the file is then read whole. ``at`` is where the
    piece's range starts in the file.
    """
    raw = spark.read.option("lineSep", '"Feature"').text(path).select("value", F.col("_metadata.file_block_start").alias("at"))
    head = F.ltrim(F.col("value")).startswith("{")
    f = F.from_json(F.concat(F.lit('{"type":"Feature"'), F.col("value")), _FEATURE + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    next_ = F.col("value").rlike(r'\{\s*"type"\s*:\s*\z')
    last = F.col("value").rlike(r"\]\s*(,[^\[\]{}]*(\[[^\[\]{}]*\]|\{[^\[\]]*\})?[^\[\]{}]*)*\}\s*\z")
    begins = F.col("value").rlike(r'\A\s*\{') & F.col("value").rlike(r'"type"\s*:\s*"FeatureCollection"') & F.col("value").rlike(r'"features"\s*:\s*\[\s*\{\s*"type"\s*:\s*\z')
    pieces = raw.select("at", head.alias("head"), F.when(head, begins).otherwise(next_ | last).alias("ok"), F.when(~head, f).alias("f"))
    told = pieces.agg(F.count_if("head").alias("heads"), F.count_if(~F.col("ok") | F.col("f._bad").isNotNull() | (~F.col("head") & F.col("f").isNull())).alias("bad")).first()
    if told["heads"] != 1 or told["bad"]:
        return None
    return pieces.where("not head").select(F.col("f.properties").alias("p"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"), "at")


def read_geojson(spark: SparkSession, path: str, name_field: str = "NAME", multi_line: bool = True) -> DataFrame:
    """Features of a FeatureCollection: a polygon is one, a multipolygon one per part, all else is skipped.

    The name must be a non-empty JSON text after trimming. A file is read in byte ranges where
    its features start with their type, else whole; ``fid`` follows the place in the file.
    ``multi_line`` False reads one collection per line.
    """
    f = _in_ranges(spark, path) if multi_line else None
    if f is None:
        schema = f"type string, features array<struct<{_FEATURE.replace(' string', ':string').replace(' struct', ':struct')}>>"
        df = spark.read.schema(schema).json(path, multiLine=multi_line)
        if not df.where("type is null or type <> 'FeatureCollection'").isEmpty():
            raise ValueError(f"{path} is not a GeoJSON FeatureCollection")
        f = df.select(F.explode("features").alias("f")).select(F.col("f.properties").alias("p"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"), F.lit(0).cast("long").alias("at"))
    # the raw value tells a text from a number: from_json with a variant keeps the JSON type
    value = F.variant_get(F.parse_json("p"), "$." + name_field, "string") if name_field.isidentifier() else F.get_json_object("p", f"$['{name_field}']")
    is_text = F.schema_of_variant(F.variant_get(F.parse_json("p"), "$." + name_field, "variant")) == "STRING" if name_field.isidentifier() else F.lit(True)
    f = f.withColumn("name", F.when(is_text, F.nullif(F.trim(value), F.lit("")))).where("name is not null and kind in ('Polygon', 'MultiPolygon')")
    point, ring = "array<double>", "array<array<array<double>>>"
    parts = F.when(F.col("kind") == "Polygon", F.array(F.from_json("c", ring))).otherwise(F.from_json("c", f"array<array<array<{point}>>>"))
    f = f.select("name", "at", F.explode(parts).alias("part"))
    rings = F.transform("part", lambda r: F.transform(r, lambda v: F.struct(F.get(v, F.lit(0)).alias("lon"), F.get(v, F.lit(1)).alias("lat"))))
    # a range has more bytes than parts: its start and the number of the part within the task never meet another's
    fid = F.col("at") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return G.with_bounds(f.select(fid.alias("fid"), "name", F.lit(None).cast("string").alias("code"), rings.alias("rings")))


def read_shapefile(spark: SparkSession, path: str, names: list[str], codes: list[str] | None = None) -> DataFrame:
    """Features of a shapefile: a polygon of many parts is one feature, even-odd across its rings."""
    df = read_shapes(spark, path)
    pick = lambda keys: F.coalesce(*[clean_text(F.try_element_at("attributes", F.lit(k))) for k in keys], F.lit(None).cast("string"))
    return G.with_bounds(df.select("fid", pick(names).alias("name"), pick(codes or []).alias("code"), "rings"))


def read_features(spark: SparkSession, path: str, name_field: str = "NAME") -> DataFrame:
    """Named polygons by the file's ending; a file without any is an error that names the field."""
    end = Path(path).suffix.lower()
    if end in (".geojson", ".json"):
        found = read_geojson(spark, path, name_field)
    elif end == ".shp":
        found = read_shapefile(spark, path, [name_field]).where("name is not null")
    else:
        raise ValueError(f"{path}: expected .geojson, .json or .shp")
    if found.isEmpty():
        raise ValueError(f"{path} has no polygon with a text in '{name_field}'")
    return found


def resolve_shoreline(spark: SparkSession, path: str) -> str:
    """A shapefile, or the first full-resolution level-1 shoreline (by name) in a folder of any store Spark reads."""
    fs, where = hadoop(spark, path)
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        return path
    found = sorted(s.getPath().getName() for s in fs.listStatus(where) if fnmatch(s.getPath().getName(), "GSHHS_*_L1.shp"))
    if not found:
        raise ValueError(f"{path} holds no GSHHS_*_L1.shp")
    return f"{path.rstrip('/')}/{found[0]}"


def read_shoreline(spark: SparkSession, path: str) -> DataFrame:
    """Segments (fid, alon, alat, blon, blat) of a shoreline shapefile or folder."""
    return G.segments(read_shapes(spark, resolve_shoreline(spark, path))).drop("ring", "seg")


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    return read_shapefile(spark, path, COUNTRY_NAMES, COUNTRY_CODES).where("name is not null")


def read_municipalities(spark: SparkSession, path: str) -> DataFrame:
    return read_shapefile(spark, path, MUNICIPALITY_NAMES).where("name is not null")
