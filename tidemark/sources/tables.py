"""Point tables in Parquet, CSV and TSV, plain or gzip; format by name or as given."""

from __future__ import annotations

import csv
import json
import uuid
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.plans.staging import hadoop, staged, staged_lines

FORMATS = ("parquet", "csv", "tsv", "csv.gz", "tsv.gz")


def format_of(path: str, explicit: str | None = None) -> str:
    """The format a path's name tells, in any case; an unknown ending means Parquet. An explicit format wins."""
    if explicit is not None:
        if explicit not in FORMATS:
            raise ValueError(f"unknown format '{explicit}', expected one of {', '.join(FORMATS)}")
        return explicit
    lower = path.lower()
    for end in ("tsv.gz", "csv.gz", "tsv", "csv"):
        if lower.endswith("." + end):
            return end
    return "parquet"


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Scan a table lazily. Text files have a header; their types are inferred.

    A gzip file is one split, so what follows a gzip scan is dealt out anew. Spark tells
    gzip by the ending of a file's name; where a gzip format is given for other names, tasks
    unpack the files to a staged table of lines first.
    """
    kind = format_of(path, fmt)
    if kind == "parquet":
        return spark.read.parquet(path)
    sep = "\t" if kind.startswith("tsv") else ","
    if kind.endswith(".gz") and fmt is not None and not path.lower().endswith(".gz"):
        odd = spark.read.format("binaryFile").load(path).where(~F.lower("path").endswith(".gz"))
        if not odd.select("path").isEmpty():
            return _unpacked(odd, sep)
    df = spark.read.csv(path, header=True, inferSchema=True, sep=sep)
    return df.repartition(spark.sparkContext.defaultParallelism) if kind.endswith(".gz") else df


def _batches(packed: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """(value, head) of one gzip file given in pieces, of any number of members: some thousand lines at a time, the first one its head."""
    unpack, rest, head = zlib.decompressobj(31), b"", True

    def told(lines: list[bytes]) -> Iterator[pa.RecordBatch]:
        nonlocal head
        if lines:
            text = [x.decode("utf-8", "replace").removesuffix("\r") for x in lines]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array([head] + [False] * (len(text) - 1))], ["value", "head"])
            head = False

    for piece in packed:
        while piece:
            if unpack.eof:
                unpack = zlib.decompressobj(31)
            rest += unpack.decompress(piece, 1 << 20)
            piece = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            *lines, rest = rest.split(b"\n")
            yield from told(lines)
    rest += unpack.flush()
    yield from told(rest.removesuffix(b"\n").split(b"\n") if rest else [])


def _pieces(file: BinaryIO) -> Iterator[bytes]:
    while piece := file.read(1 << 20):
        yield piece


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _GzipReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            yield from _batches(_pieces(f))


class GzipLines(DataSource):
    """format("gzip_lines").option("paths", json).load(): value string, head boolean; a file is read from a stream, whatever its name and size."""

    @classmethod
    def name(cls) -> str:
        return "gzip_lines"

    def schema(self) -> str:
        return "value string, head boolean"

    def reader(self, schema) -> _GzipReader:
        return _GzipReader(json.loads(self.options["paths"]))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for content in (c for b in batches for c in b.column("content")):
        yield from _batches(iter([content.as_py()]))


def _unpacked(files: DataFrame, sep: str) -> DataFrame:
    """Gzip files under other names: from a stream where tasks can open them, else (up to 2 GB each) through Spark's file systems. All must have one header."""
    spark = files.sparkSession
    paths = [r["path"] for r in files.select("path").toLocalIterator()]
    own = [p.removeprefix("file:") for p in paths]
    if all(p.startswith("file:") for p in paths):
        spark.dataSource.register(GzipLines)
        read = spark.read.format("gzip_lines").option("paths", json.dumps(["/" + p.lstrip("/") for p in own])).load()
    else:
        read = files.select("content").mapInArrow(_lines, "value string, head boolean")
    lines = staged(read)
    heads = [r["value"] for r in lines.where("head").select("value").distinct().limit(2).collect()]
    if len(heads) > 1:
        raise ValueError(f"the files differ in their header: {heads[0]!r} and {heads[1]!r}")
    names = next(csv.reader(heads, delimiter=sep)) if heads else []
    path = staged_lines(lines.where("not head").select("value"))
    text = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    df = spark.read.csv(path, inferSchema=True, sep=sep)
    return df.toDF(*names) if len(df.columns) == len(names) else spark.read.csv(path, schema=text, sep=sep)


def write_table(df: DataFrame, path: str, fmt: str | None = None, single_file: bool = False) -> None:
    """Write a folder of part files, or one file at ``path`` itself if ``single_file``; an existing result is replaced."""
    if single_file:
        fs, part = hadoop(df.sparkSession, f"{path}.part-{uuid.uuid4().hex}")
        write_table(df.coalesce(1), part.toString(), format_of(path, fmt))
        made = [s.getPath() for s in fs.listStatus(part) if s.getPath().getName().startswith("part-")]
        target = hadoop(df.sparkSession, path)[1]
        fs.delete(target, True)
        fs.rename(made[0], target)
        fs.delete(part, True)
        return
    kind = format_of(path, fmt)
    writer = df.write.mode("overwrite")
    if kind == "parquet":
        writer.parquet(path)
        return
    writer = writer.option("header", True).option("sep", "\t" if kind.startswith("tsv") else ",")
    (writer.option("compression", "gzip") if kind.endswith(".gz") else writer).csv(path)


def default_output(path: str, tag: str, fmt: str | None = None) -> str:
    """<stem>.<tag>.<ending> beside the input; a compound ending counts whole, unknown endings give Parquet."""
    where = PurePosixPath(path)
    kind, name = format_of(path, fmt), where.name
    for end in (".csv.gz", ".tsv.gz", ".parquet", ".pq", ".csv", ".tsv"):
        if name.lower().endswith(end):
            name = name[: -len(end)]
            break
    else:
        name = where.stem
    return str(where.with_name(f"{name}.{tag}.{kind}"))
