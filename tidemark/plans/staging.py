"""Tables written to the folder that all executors share, to cut lineage between rounds."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only in local mode where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or _own_dir()).rstrip("/")


def _staging(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"


#: What this process has staged, in order.
MADE: list[str] = []


def staged(df: DataFrame) -> DataFrame:
    path = f"{_staging(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    MADE.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_lines(df: DataFrame) -> str:
    """Where the lines of a one-column table were staged as text."""
    path = f"{_staging(df.sparkSession)}/lines-{uuid.uuid4().hex}"
    MADE.append(path)
    df.write.text(path)
    return path


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path in any store Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def drop_staged(spark: SparkSession, since: int = 0) -> None:
    """Delete what this process has staged since ``MADE`` held so many tables. Results not yet written that build on them can't be computed any more."""
    gone, MADE[since:] = MADE[since:], []
    for path in gone:
        fs, where = hadoop(spark, path)
        fs.delete(where, True)
