"""ESRI shapefiles as a Spark data source: polygons of a .shp with the attributes of its .dbf."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from pathlib import Path
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.plans.staging import hadoop

_POLYGONS = {5, 15, 25}


def _records(path: str, at: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(record number, content) of the records from byte ``at`` up to ``stop``."""
    with open(path, "rb") as f:
        f.seek(at)
        while f.tell() < stop:
            head = f.read(8)
            if len(head) < 8:
                return
            number, words = struct.unpack(">ii", head)
            yield number, f.read(2 * words)


def _rings(content: bytes) -> list[list[tuple[float, float]]] | None:
    """The rings of a polygon record; None for any other shape."""
    if len(content) < 44 or struct.unpack_from("<i", content)[0] not in _POLYGONS:
        return None
    n_parts, n_points = struct.unpack_from("<ii", content, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", content, 44), n_points]
    xy = struct.unpack_from(f"<{2 * n_points}d", content, 44 + 4 * n_parts)
    return [[(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]


class _Dbf:
    """Character attributes of a .dbf by record number (from 1)."""

    def __init__(self, file: BinaryIO):
        self.f = file
        head = self.f.read(32)
        self.n, self.at, self.size = struct.unpack_from("<IHH", head, 4)
        self.fields, offset = {}, 1
        for _ in range((self.at - 33) // 32):
            d = self.f.read(32)
            name, kind, length = d[:11].split(b"\0")[0].decode("ascii", "replace"), chr(d[11]), d[16]
            self.fields[name] = (kind, offset, length)
            offset += length

    def row(self, number: int) -> dict[str, str]:
        self.f.seek(self.at + (number - 1) * self.size)
        raw = self.f.read(self.size)
        return {k: raw[o : o + n].decode("utf-8", "replace").strip() for k, (kind, o, n) in self.fields.items() if kind == "C"}


class _Split(InputPartition):
    def __init__(self, at: int, stop: int):
        self.at, self.stop = at, stop


class _Reader(DataSourceReader):
    """Splits a file by record boundaries, found by hopping over record heads only."""

    def __init__(self, path: str, records_per_split: int):
        self.path, self.step = path, records_per_split

    def partitions(self) -> list[_Split]:
        size, at, cuts = Path(self.path).stat().st_size, 100, [100]
        with open(self.path, "rb") as f:
            n = 0
            while at < size:
                f.seek(at)
                head = f.read(8)
                if len(head) < 8:
                    break
                at += 8 + 2 * struct.unpack(">ii", head)[1]
                n += 1
                if n % self.step == 0:
                    cuts.append(at)
        if cuts[-1] != at:
            cuts.append(at)
        return [_Split(a, b) for a, b in zip(cuts, cuts[1:], strict=False)] or [_Split(100, 100)]

    def read(self, partition: _Split) -> Iterator[tuple]:
        dbf = Path(self.path).with_suffix(".dbf")
        rows = _Dbf(dbf.open("rb")) if dbf.exists() else None
        for number, content in _records(self.path, partition.at, partition.stop):
            rings = _rings(content)
            if rings is not None:
                yield number, rings, rows.row(number) if rows else {}


class ShapefileSource(DataSource):
    """format("shapefile").load(path): fid long, rings, attributes map<string,string>. Shapes that aren't polygons are skipped."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return "fid long, rings array<array<struct<lon:double,lat:double>>>, attributes map<string,string>"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("recordsPerSplit", "2000")))


_SHAPES = "fid long, rings array<array<struct<lon:double,lat:double>>>, attributes map<string,string>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number, record) of whole files, some MB at a time."""
    for content in (c for b in batches for c in b.column(0)):
        data, at, numbers, records, size = memoryview(content.as_buffer()), 100, [], [], 0
        while at + 8 <= len(data):
            number, words = struct.unpack_from(">ii", data, at)
            numbers.append(number)
            records.append(bytes(data[at + 8 : at + 8 + 2 * words]))
            at, size = at + 8 + 2 * words, size + 2 * words
            if size > 4 << 20 or at + 8 > len(data):
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(records, pa.binary())], ["number", "record"])
                numbers, records, size = [], [], 0


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(n, [[{"lon": x, "lat": y} for x, y in ring] for ring in rings]) for n, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (rings := _rings(r)) is not None]
        kind = pa.list_(pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())])))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([r for _, r in rows], kind)], ["fid", "rings"])


def _attributes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for content in (c for b in batches for c in b.column(0)):
        dbf = _Dbf(io.BytesIO(content.as_py()))
        for low in range(1, dbf.n + 1, 4096):
            numbers = range(low, min(dbf.n + 1, low + 4096))
            yield pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.int64()), pa.array([list(dbf.row(k).items()) for k in numbers], pa.map_(pa.string(), pa.string()))], ["fid", "attributes"])


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """(fid, rings, attributes) of a shapefile, by the data source where tasks can open it, else through Spark's file systems.

    In a store that only Spark reads, a task gets the file as one row (up to 2 GB) and deals its
    records out; the attributes come from the .dbf beside it by record number, if there is one.
    """
    if Path(path.removeprefix("file://")).exists():
        spark.dataSource.register(ShapefileSource)
        return spark.read.format("shapefile").load(path.removeprefix("file://"))
    whole = lambda p: spark.read.format("binaryFile").load(p).select("content")
    shapes = whole(path).mapInArrow(_cut, "number long, record binary").repartition(spark.sparkContext.defaultParallelism).mapInArrow(_parsed, T.StructType(T.StructType.fromDDL(_SHAPES).fields[:2]))
    fs, dbf = hadoop(spark, path[: -len(Path(path).suffix)] + ".dbf")
    if not fs.exists(dbf):
        return shapes.withColumn("attributes", F.create_map().cast("map<string,string>"))
    rows = whole(dbf.toString()).mapInArrow(_attributes, "fid long, attributes map<string,string>")
    return shapes.join(rows, "fid", "left").withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))


def write_shapefile(path: str, shapes: list[tuple[list[list[tuple[float, float]]], dict[str, str]]]) -> None:
    """Write polygons and text attributes: for fixtures and small exports."""
    body = b""
    for number, (rings, _) in enumerate(shapes, 1):
        flat = [p for r in rings for p in r]
        starts = [sum(len(r) for r in rings[:i]) for i in range(len(rings))]
        xs, ys = [p[0] for p in flat], [p[1] for p in flat]
        content = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(flat)) + struct.pack(f"<{len(starts)}i", *starts)
        content += b"".join(struct.pack("<2d", *p) for p in flat)
        body += struct.pack(">ii", number, len(content) // 2) + content
    head = struct.pack(">i20xi", 9994, 50 + len(body) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    Path(path).write_bytes(head + body)
    names = list(shapes[0][1]) if shapes else []
    width = 60
    out = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(shapes), 33 + 32 * len(names), 1 + width * len(names))
    out += b"".join(struct.pack("<11sc4xB15x", n.encode()[:10], b"C", width) for n in names) + b"\r"
    out += b"".join(b" " + b"".join(a[n].encode()[:width].ljust(width) for n in names) for _, a in shapes)
    Path(path).with_suffix(".dbf").write_bytes(out)
