"""Reduce rows to distinct rounded locations, and join answers back.

Every lookup runs once per distinct location, so its cost follows the number of positions
and not the number of rows. Keys are whole numbers: doubles are never compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["_klon", "_klat"]


def coordinate(df: DataFrame, name: str) -> Column:
    """A column as double; what isn't a number is null."""
    if name not in df.columns:
        raise ValueError(f"input has no column '{name}'")
    return F.col(f"`{name}`").cast("string").try_cast("double") if isinstance(df.schema[name].dataType, T.StringType) else F.col(f"`{name}`").try_cast("double")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def key(c: Column, decimals: int) -> Column:
    """The rounded value in units of the last decimal, half away from zero on the scaled value; null where not finite.

    Rounding the scaled value, and not to decimals, is what keeps halves exact.
    """
    scale = 10.0**decimals
    scaled = F.when(finite(c), c * scale)
    return F.when(F.abs(scaled) < 9.0e18, F.round(scaled, 0)).cast("long")


def with_keys(df: DataFrame, lon: str, lat: str, decimals: int) -> DataFrame:
    """Add the integer keys; both are null unless both coordinates are finite."""
    a, b = key(coordinate(df, lon), decimals), key(coordinate(df, lat), decimals)
    both = a.isNotNull() & b.isNotNull()
    return df.withColumns({KEYS[0]: F.when(both, a), KEYS[1]: F.when(both, b)})


def unique_locations(keyed: DataFrame, decimals: int) -> DataFrame:
    """Rows (_klon, _klat, lon, lat), one per distinct key: combined before the shuffle."""
    scale = 10.0**decimals
    uniq = keyed.where("_klon is not null").select(*KEYS).distinct()
    return uniq.select(*KEYS, (F.col("_klon") / F.lit(scale)).alias("lon"), (F.col("_klat") / F.lit(scale)).alias("lat"))


def check_clashes(df: DataFrame, names: Sequence[str], overwrite: bool) -> None:
    """Output names must be new, unless they are to be overwritten. Names that differ only in case can't be told apart."""
    clash = [n for n in names if n in df.columns]
    if clash and not overwrite:
        raise ValueError(f"input already has {', '.join(clash)}; pass overwrite to replace")
    lower = {c.lower(): c for c in df.columns}
    near = [lower[n.lower()] for n in names if n.lower() in lower and n not in df.columns]
    if near:
        raise ValueError(f"input has {', '.join(near)}, which differ from output names only in case")


def join_back(keyed: DataFrame, results: DataFrame, outputs: Sequence[T.StructField], null_floats: bool = False) -> DataFrame:
    """Every input row with its location's answer. Floats that miss are NaN (or null), texts and booleans null.

    Null keys match nothing. An output whose name the input has takes its place and
    position. Row order is not kept.
    """
    made = {f.name: f"_out{i}" for i, f in enumerate(outputs)}
    joined = keyed.join(results.select(*KEYS, *[F.col(f"`{n}`").alias(m) for n, m in made.items()]), KEYS, "left")

    def value(f: T.StructField) -> Column:
        c = F.col(made[f.name])
        if isinstance(f.dataType, T.DoubleType) and not null_floats:
            c = F.coalesce(c, F.lit(float("nan")))
        return c.alias(f.name)

    fields = {f.name: f for f in outputs}
    old = [c for c in keyed.columns if c not in KEYS]
    return joined.select(*[value(fields[c]) if c in fields else F.col(f"`{c}`") for c in old], *[value(f) for f in outputs if f.name not in old])
