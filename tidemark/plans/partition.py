"""Error-bounded partitions of the locations, each with a projection centre of its own.

The number of partitions is bounded by the tolerance (a few dozen cover the globe), and
so is what reaches the driver: locations are summed into cells of half a degree first (at
most 259,200, whatever the data), and the cells are split and merged. A cell's locations
lie within the angle from its mean to its farthest corner, which is held back from the
tolerance; a cell with one location holds nothing back.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import spatial as S
from tidemark.operators.locations import KEYS
from tidemark.plans.region import auto_box
from tidemark.plans.settings import Box

CELL_DEG = 0.5


def _angle_error(angle: np.ndarray | float):
    return np.abs(np.sqrt((1 + np.cos(angle)) / 2) - 1)


def _serviceable(tolerance: float) -> float:
    """Radians from a centre within the tolerance."""
    return math.acos(max(-1.0, min(1.0, 2 * (1 - tolerance) ** 2 - 1)))


def _vectors(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    l, p = np.radians(lon), np.radians(lat)  # noqa: E741
    return np.c_[np.cos(p) * np.cos(l), np.cos(p) * np.sin(l), np.sin(p)]


def _angles(v: np.ndarray, to: np.ndarray) -> np.ndarray:
    return 2 * np.arcsin(np.clip(np.linalg.norm(v - to, axis=-1) / 2, 0, 1))


@dataclass
class Part:
    members: np.ndarray
    center: np.ndarray
    distortion: float

    @property
    def lonlat(self) -> tuple[float, float]:
        x, y, z = self.center
        return math.degrees(math.atan2(y, x)), math.degrees(math.asin(max(-1.0, min(1.0, z))))


def _evaluate(v: np.ndarray, weight: np.ndarray, members: np.ndarray, slack: np.ndarray) -> Part | None:
    mean = np.average(v[members], axis=0, weights=weight[members])
    length = np.linalg.norm(mean)
    if length < 1e-12:
        return None
    center = mean / length
    worst = (_angles(v[members], center) + slack[members]).max()
    return Part(members, center, float(_angle_error(min(worst, math.pi))))


def split(v: np.ndarray, weight: np.ndarray, tolerance: float, slack: np.ndarray | None = None) -> list[Part]:
    """Bisect by farthest pair until every part is within the tolerance, then merge what still fits.

    Ties go to the lower index; of the merges that fit, the tightest comes first, and pairs
    whose centres are over two serviceable radii apart are not tried.
    """
    slack = np.zeros(len(v)) if slack is None else slack
    done: list[Part] = []
    todo = [np.arange(len(v))] if len(v) else []
    while todo:
        members = todo.pop()
        part = _evaluate(v, weight, members, slack)
        if part is not None and (part.distortion <= tolerance or len(members) == 1):
            done.append(part)
            continue
        a = members[np.argmax(_angles(v[members], v[members[0]]))]
        from_a = _angles(v[members], v[a])
        b = members[np.argmax(from_a)]
        left = from_a <= _angles(v[members], v[b])
        if left.all():
            left = np.arange(len(members)) < len(members) // 2
        todo += [members[left], members[~left]]
    reach, scores = 2 * _serviceable(tolerance), {}
    parts: dict[int, Part] = dict(enumerate(done))
    fresh = len(parts)

    def tried(i: int, j: int) -> Part | None:
        if (i, j) not in scores:
            near = _angles(parts[i].center, parts[j].center) <= reach
            joined = _evaluate(v, weight, np.sort(np.r_[parts[i].members, parts[j].members]), slack) if near else None
            scores[i, j] = joined if joined is not None and joined.distortion <= tolerance else None
        return scores[i, j]

    while True:
        order = sorted(parts)
        fits = [(m.distortion, i, j) for k, i in enumerate(order) for j in order[k + 1 :] if (m := tried(i, j)) is not None]
        if not fits:
            return sorted(parts.values(), key=lambda p: p.lonlat)
        _, i, j = min(fits)
        parts[fresh] = scores[i, j]
        del parts[i], parts[j]
        fresh += 1


def _covering(lon: np.ndarray) -> tuple[float, float, bool]:
    """The smallest longitude arc over points: the complement of the widest gap."""
    x = np.unique(np.mod(lon, 360.0))
    gaps = np.diff(np.r_[x, x[0] + 360.0])
    k = int(np.argmax(gaps[:-1])) if len(x) > 1 and gaps[:-1].max() >= gaps[-1] else len(x) - 1
    if gaps[k] < S.CIRCUMPOLAR_GAP_DEG:
        return -180.0, 180.0, False
    west, east = x[(k + 1) % len(x)], x[k]
    west, east = (w - 360.0 if w > 180.0 else w for w in (west, east))
    return float(west), float(east), bool(west > east)


def _extent(rows) -> tuple[np.ndarray, np.ndarray]:
    """(mean directions of the cells, angle from each to the farthest corner of its locations' extent)."""
    v = _vectors(rows["lon"].to_numpy(float), rows["lat"].to_numpy(float))
    corners = [_vectors(rows[x].to_numpy(float), rows[y].to_numpy(float)) for x in ("west", "east") for y in ("south", "north")]
    return v, np.max([_angles(c, v) for c in corners], axis=0)


def partition(locs: DataFrame, tolerance: float = S.DISTORTION_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(locations with pid, clon, clat; parts with pid, clon, clat, box, distortion, members).

    Cells of half a degree stand for their locations. The assignment is a join on cells,
    which are at most 259,200 and broadcast, as are the parts.
    """
    spark = locs.sparkSession
    cells = locs.withColumns({"_ci": F.floor(F.col("lon") / CELL_DEG), "_cj": F.floor(F.col("lat") / CELL_DEG)})
    extent = [F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north")]
    mean = [F.avg("lon").alias("lon"), F.avg("lat").alias("lat")]
    rows = cells.groupBy("_ci", "_cj").agg(*mean, *extent, F.count("*").alias("n")).orderBy("_ci", "_cj").toPandas()
    if not len(rows):
        raise ValueError("partition found no usable coordinates in the input")
    weight = rows["n"].to_numpy(float)
    v, slack = _extent(rows)
    parts = split(v, weight, tolerance, slack)
    pid = np.empty(len(rows), np.int32)
    table = []
    for i, p in enumerate(parts):
        pid[p.members] = i
        own = rows.iloc[p.members]
        box: Box = auto_box(*_covering(np.r_[own["west"], own["east"]]), float(own["south"].min()), float(own["north"].max()))
        table.append((i, *p.lonlat, box.min_lon, box.max_lon, box.min_lat, box.max_lat, p.distortion, int(weight[p.members].sum())))
    about = spark.createDataFrame(table, "pid int, clon double, clat double, min_lon double, max_lon double, min_lat double, max_lat double, distortion double, members long")
    owner = spark.createDataFrame(rows[["_ci", "_cj"]].assign(pid=pid), "_ci long, _cj long, pid int")
    owned = cells.join(F.broadcast(owner), ["_ci", "_cj"]).join(F.broadcast(about.select("pid", "clon", "clat")), "pid")
    return owned.select(*KEYS, "lon", "lat", "pid", "clon", "clat"), about
