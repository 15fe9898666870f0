"""Regular elevation grids: NetCDF classic files to the grid table (i, j, elevation) and its two axes."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tidemark.functions import spatial as S

#: Fixed values of the format: type code to struct letter.
_TYPES = {1: "b", 2: "c", 3: "h", 4: "i", 5: "f", 6: "d"}
Axis = tuple[float, float, int]


class _Header:
    """Dimensions and variables of a classic (CDF-1 or CDF-2) file."""

    def __init__(self, path: str):
        self.path, self.f = path, open(path, "rb")  # noqa: SIM115
        magic = self.f.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2):
            raise ValueError(f"{path} is not a NetCDF classic file; convert NetCDF-4 grids to Parquet or classic first")
        self.wide = magic[3] == 2
        self._int()  # number of records
        self.dims = [(self._name(), self._int()) for _ in self._list()]
        self._attributes()
        self.vars = {}
        for _ in self._list():
            name = self._name()
            dims = [self._int() for _ in range(self._int())]
            self._attributes()
            kind, _ = self._int(), self._int()
            begin = struct.unpack(">q" if self.wide else ">i", self.f.read(8 if self.wide else 4))[0]
            self.vars[name] = ([self.dims[d][1] for d in dims], _TYPES[kind], begin)

    def _int(self) -> int:
        return struct.unpack(">i", self.f.read(4))[0]

    def _list(self) -> range:
        self._int()
        return range(self._int())

    def _name(self) -> str:
        n = self._int()
        return self.f.read(n + -n % 4)[:n].decode()

    def _attributes(self) -> None:
        for _ in self._list():
            self._name()
            kind, n = self._int(), self._int()
            size = n * struct.calcsize(_TYPES[kind])
            self.f.read(size + -size % 4)

    def values(self, name: str, start: int = 0, count: int | None = None) -> np.ndarray:
        shape, letter, begin = self.vars[name]
        total = 1
        for d in shape:
            total *= d
        count, size = total - start if count is None else count, struct.calcsize(letter)
        self.f.seek(begin + start * size)
        return np.frombuffer(self.f.read(count * size), np.dtype(letter if letter == "b" else f">{letter}{size}" if letter in "if" else {"c": "S1", "h": ">i2", "d": ">f8"}[letter]))

    def axis(self, name: str) -> Axis:
        """(origin, step, length); the step comes from the ends."""
        v = self.values(name)
        return float(v[0]), (float(v[-1]) - float(v[0])) / (len(v) - 1) if len(v) > 1 else 0.0, len(v)

    def checked(self) -> _Header:
        missing = [n for n in ("lat", "lon", "elevation") if n not in self.vars]
        if missing:
            raise ValueError(f"{self.path} has no variable {', '.join(missing)}")
        return self


class _Rows(InputPartition):
    """Rows first to stop - 1; the tile columns wanted of them, or None for all."""

    def __init__(self, first: int, stop: int, columns: list[int] | None = None):
        self.first, self.stop, self.columns = first, stop, columns


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows, self.first, self.stop, self.tiles = path, rows, 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of i leave latitude rows unread, and a list of tiles all others (with spark.sql.python.filterPushdown.enabled); Spark applies all filters besides."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("i",) and isinstance(value, int):
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    end = f.value + (not isinstance(f, LessThan))
                    self.stop = end if self.stop is None else min(self.stop, end)
            if getattr(f, "attribute", None) == ("tile",) and isinstance(f, In | EqualTo):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.tiles = wanted if self.tiles is None else self.tiles & wanted
            yield f

    def partitions(self) -> list[_Rows]:
        n = _Header(self.path).checked().vars["elevation"][0][0]
        stop = n if self.stop is None else min(n, self.stop)
        if self.tiles is None:
            return [_Rows(i, min(stop, i + self.rows)) for i in range(self.first, stop, self.rows)] or [_Rows(0, 0)]
        side, bands = 1 << S.TILE_BITS, {}
        for t in self.tiles:
            bands.setdefault(t >> 16, []).append(t & 0xFFFF)
        found = [_Rows(i, min(stop, i + self.rows, (b + 1) * side), sorted(columns)) for b, columns in sorted(bands.items()) for i in range(max(self.first, b * side), min(stop, (b + 1) * side), self.rows)]
        return found or [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        h = _Header(self.path)
        width, side = h.vars["elevation"][0][1], 1 << S.TILE_BITS
        spans = [(0, width)] if partition.columns is None else [(c * side, min(width, (c + 1) * side)) for c in partition.columns]
        for i in range(partition.first, partition.stop):
            for low, high in spans:
                if low < high:
                    j = np.arange(low, high, dtype=np.int32)
                    row = h.values("elevation", i * width + low, high - low).astype(float)
                    tile = (i >> S.TILE_BITS) << 16 | j >> S.TILE_BITS
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(high - low, i, np.int32)), pa.array(j), pa.array(row), pa.array(tile.astype(np.int32))], ["i", "j", "elevation", "tile"])


class GridSource(DataSource):
    """format("elevation_grid").load(path): i int, j int, elevation double, tile int; read by blocks of latitude rows, of the tiles asked for."""

    @classmethod
    def name(cls) -> str:
        return "elevation_grid"

    def schema(self) -> str:
        return "i int, j int, elevation double, tile int"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("rowsPerSplit", "64")))


def read_grid(spark: SparkSession, path: str) -> tuple[DataFrame, Axis, Axis]:
    """(grid table, latitude axis, longitude axis). For grids read often, see :func:`write_tiles`."""
    h = _Header(path).checked()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridSource)
    return spark.read.format("elevation_grid").load(path), h.axis("lat"), h.axis("lon")


def write_tiles(grid: DataFrame, path: str) -> None:
    """A grid table as Parquet, a folder per tile and sorted inside: a lookup reads the tiles it needs."""
    tiled = grid.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("elevation").cast("double").alias("elevation")).withColumn("tile", S.tile(F.col("i"), F.col("j")))
    tiled.repartition("tile").sortWithinPartitions("tile", "i", "j").write.partitionBy("tile").parquet(path)


def write_grid(path: str, lat: list[float], lon: list[float], elevation: list[list[float]]) -> None:
    """A classic file with lat, lon and elevation(lat, lon) as doubles: for fixtures."""

    def name(s: str) -> bytes:
        return struct.pack(">i", len(s)) + s.encode().ljust(len(s) + -len(s) % 4, b"\0")

    head = b"CDF\1" + struct.pack(">iii", 0, 10, 2) + name("lat") + struct.pack(">i", len(lat)) + name("lon") + struct.pack(">i", len(lon)) + struct.pack(">iiii", 0, 0, 11, 3)
    specs = [("lat", [0], lat), ("lon", [1], lon), ("elevation", [0, 1], [v for r in elevation for v in r])]
    size = len(head) + sum(len(name(n)) + 4 + 4 * len(d) + 8 + 8 + 4 for n, d, _ in specs)
    data = b""
    for n, dims, values in specs:
        head += name(n) + struct.pack(f">i{len(dims)}i", len(dims), *dims) + struct.pack(">ii", 0, 0) + struct.pack(">iii", 6, 8 * len(values), size + len(data))
        data += struct.pack(f">{len(values)}d", *values)
    Path(path).write_bytes(head + data)
