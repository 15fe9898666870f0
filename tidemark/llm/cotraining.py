"""Quality by co-training: one classifier sees what a text says, the other its metadata.

Each round either view labels, for the other, the unlabelled documents it is sure of: all of
them, in one pass over the table that returns sums only. The views are calibrated on labelled
rows kept apart, and combined to score all documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, tuned

N_SHAPE, N_WORDS = 16, 112
N_TEXT = N_SHAPE + N_WORDS
#: Slots of the metadata view: lang, source, magnitude of n_chars. Their combinations are its cells.
SLOTS = (64, 256, 8)
N_CELLS = SLOTS[0] * SLOTS[1] * SLOTS[2]
_END = re.compile(r"[.!?:;\"'’”)。]\s*$")


def text_features(text: str | None) -> np.ndarray:
    """What a whole text says and looks like: counts of its form, and the root of each hashed word's share. Null counts as empty."""
    t = text or ""
    words, lines = t.split(), [x for x in t.split("\n") if x.strip()]
    n, size = max(len(words), 1), max(len(t), 1)
    drop = lambda chars: len(t) - len(t.translate(dict.fromkeys(map(ord, chars))))
    symbols, digits, pipes = drop("#*$%&<>"), drop("0123456789"), t.count("|")
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeat = 1 - len(set(runs)) / max(len(runs), 1)
    said = Counter(t.lower().split())
    out = np.zeros(N_TEXT, np.float32)
    out[:N_SHAPE] = [
        np.log1p(len(words)), min(size / n, 40.0), min(symbols / n, 5.0), min(pipes / n, 5.0), min(20 * symbols / size, 5.0), digits / size,
        len(said) / n, repeat, float(repeat > 0.2), 1 - len(set(lines)) / max(len(lines), 1), sum(map(bool, map(_END.search, lines))) / max(len(lines), 1),
        min(n / max(len(lines), 1), 500.0) / 100, float(len(words) < 10), float(symbols > 0.2 * n), float(pipes > 0.1 * n), max(map(len, words), default=0) > 40,
    ]
    if said:
        slots = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) % N_WORDS for w in said), np.int64, len(said))
        out[N_SHAPE:] = np.sqrt(np.bincount(slots, np.fromiter(said.values(), float, len(said)), N_WORDS) / n)
    return out


def meta_cell(lang: str | None, source: str | None, n_chars: float | None) -> int:
    """The cell of a document's metadata: a slot for lang, one for source, one for the magnitude of n_chars. Null has a slot like a value."""
    size = n_chars if n_chars is not None and n_chars > 0 else 0.0
    at = zlib.crc32(repr(lang).encode()) % SLOTS[0], zlib.crc32(repr(source).encode()) % SLOTS[1], int(min(SLOTS[2] - 1, np.log10(1 + size)))
    return (at[0] * SLOTS[1] + at[1]) * SLOTS[2] + at[2]


def with_views(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", n_chars: str = "n_chars", out: str = "_view") -> DataFrame:
    """Add ``out``: both views of each row, as (says binary, cell int); the binary holds N_TEXT 4-byte floats."""

    @F.arrow_udf("struct<says: binary, cell: int>")
    def view(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        says = pa.array([text_features(t.as_py()).tobytes() for t in a], pa.binary())
        cell = pa.array([meta_cell(*m) for m in zip(b.to_pylist(), c.to_pylist(), d.to_pylist(), strict=True)], pa.int32())
        return pa.StructArray.from_arrays([says, cell], ["says", "cell"])

    return df.withColumn(out, view(F.col(f"`{text}`"), F.col(f"`{lang}`").cast("string"), F.col(f"`{source}`").cast("string"), F.col(f"`{n_chars}`").cast("double")))


def _matrix(says: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(says.to_pylist()), np.float32).reshape(-1, N_TEXT).astype(float)


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


@dataclass
class Logistic:
    """Standardised logistic regression, fitted by Newton steps with weights per row."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ridge: float = 1.0

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.ones(len(x)), (x - self.mean) / self.scale]

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the loss over these rows."""
        z = self.design(x)
        p = _chance(z @ self.w)
        return z.T @ (p - y), (z * (p * (1 - p))[:, None]).T @ z

    def stepped(self, g: np.ndarray, h: np.ndarray) -> Logistic:
        penalty = np.full(len(self.w), self.ridge)
        penalty[0] = 1e-3
        return replace(self, w=self.w - np.linalg.solve(h + np.diag(penalty), g + penalty * self.w))

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 12) -> Logistic:
        got = Logistic(x.mean(0), x.std(0) + 1e-6, np.zeros(x.shape[1] + 1), self.ridge)
        for _ in range(steps):
            got = got.stepped(*got.sums(x, y))
        return got

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ self.w, -20, 20)


@dataclass
class Cells:
    """Logistic regression on the three slots of a metadata cell, fitted from sums per cell."""

    w: np.ndarray = field(default_factory=lambda: np.zeros(1 + sum(SLOTS)))

    @staticmethod
    def columns(cell: np.ndarray) -> np.ndarray:
        """The columns that are 1 for a cell: the constant and one per slot."""
        a, b, c = cell // (SLOTS[1] * SLOTS[2]), cell // SLOTS[2] % SLOTS[1], cell % SLOTS[2]
        return np.c_[np.zeros(len(cell), np.int64), 1 + a, 1 + SLOTS[0] + b, 1 + SLOTS[0] + SLOTS[1] + c]

    def fit(self, bad: np.ndarray, good: np.ndarray, ridge: float = 1.0, steps: int = 12) -> Cells:
        """``bad``, ``good``: weight of the rows of each label, per cell."""
        cell = np.flatnonzero(bad + good)
        at, n, y, w = self.columns(cell), (bad + good)[cell], good[cell], np.zeros(len(self.w))
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-3
        for _ in range(steps):
            p = _chance(w[at].sum(1))
            g, h = penalty * w, np.diag(penalty)
            np.add.at(g, at, (n * p - y)[:, None])
            np.add.at(h, (at[:, :, None], at[:, None, :]), (n * p * (1 - p))[:, None, None])
            w = w - np.linalg.solve(h, g)
        return Cells(w)

    def margin(self, cell: np.ndarray) -> np.ndarray:
        return np.clip(self.w[self.columns(cell)].sum(1), -20, 20)


@dataclass
class CoTrained:
    text: Logistic
    meta: Cells
    combine: Logistic
    rounds: list[tuple[int, int]]  # documents labelled by the text view, and by the metadata view

    def score(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return _chance(self.combine.margin(np.c_[self.text.margin(x), self.meta.margin(cell)]))


@dataclass
class Teachers:
    """Both views as they stand, each with its calibration."""

    text: Logistic
    meta: Cells
    platt: tuple[Logistic, Logistic]
    bounds: tuple[float, float]  # the least chance at which a view names a document bad, and good

    def labels(self, margin: np.ndarray, view: int) -> np.ndarray:
        """1 or 0 where the view is sure, else -1."""
        p = _chance(self.platt[view].margin(margin[:, None]))
        return np.where(p >= self.bounds[1], 1, np.where(1 - p >= self.bounds[0], 0, -1))


_UPPER = np.triu_indices(N_TEXT + 1)
_PER_CLASS = 1 + N_TEXT + 1 + len(_UPPER[0])  # count, gradient, upper half of the Hessian


def taught(pool: DataFrame, teachers: Teachers, text: Logistic) -> dict[str, np.ndarray]:
    """What both views teach over the whole ``pool`` (says, cell), as sums.

    Per class, the number of documents the metadata view labels and the gradient and Hessian
    of ``text`` over them; per class and cell, the documents the text view labels. A task
    returns sums, Spark adds them up by key: at most 2 x (8,515 + 131,072) rows reach the driver.
    """
    shared = pool.sparkSession.sparkContext.broadcast((teachers, text))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know, now = shared.value
        total, cells = np.zeros((2, _PER_CLASS)), np.zeros(2 * N_CELLS)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, cell = _matrix(batch.column(0)), batch.column(1).to_numpy().astype(np.int64)
            by_text, by_meta = know.labels(know.text.margin(x), 0), know.labels(know.meta.margin(cell), 1)
            for c in (0, 1):
                cells[c * N_CELLS : (c + 1) * N_CELLS] += np.bincount(cell[by_text == c], minlength=N_CELLS)
                mine = x[by_meta == c]
                if len(mine):
                    g, h = now.sums(mine, np.full(len(mine), float(c)))
                    total[c] += np.r_[len(mine), g, h[_UPPER]]
        every = np.r_[total.ravel(), cells]
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(every[at])], names=["k", "v"])

    rows = pool.select("says", "cell").mapInArrow(work, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    every = np.zeros(2 * _PER_CLASS + 2 * N_CELLS)
    every[rows["k"].to_numpy()] = rows["v"].to_numpy()
    per, cells = every[: 2 * _PER_CLASS].reshape(2, -1), every[2 * _PER_CLASS :].reshape(2, -1)
    h = np.zeros((2, N_TEXT + 1, N_TEXT + 1))
    for c in (0, 1):
        h[c][_UPPER] = per[c, N_TEXT + 2 :]
        h[c] = h[c] + np.triu(h[c], 1).T
    return {"n": per[:, 0], "g": per[:, 1 : N_TEXT + 2], "h": h, "cells": cells}


def fit_views(x: np.ndarray, cell: np.ndarray, y: np.ndarray, pool: DataFrame, rounds: int = 4, steps: int = 2, sure: float = 0.9) -> CoTrained:
    """Co-train on labelled rows (x, cell, y) and all rows of an unlabelled ``pool`` (says, cell).

    A quarter of the labelled rows is kept for calibration. A view names a document for the
    other where its calibrated chance is at least ``sure`` and half of what the class lacks to
    1 beyond its share of the labels (a view that only knows the shares names nothing).
    What a view is taught weighs half as much as the labelled rows, each class by its share
    of the labels and no document more than a labelled one: the size of the pool sharpens
    what it says, not how loud it is.
    """
    kept = np.arange(len(y)) % 4 == 3
    xs, cs, ys = x[~kept], cell[~kept], y[~kept]
    share = np.array([1 - ys.mean(), ys.mean()])
    bounds = np.maximum(sure, (1 + share) / 2)
    own = np.array([np.bincount(cs[ys == c], minlength=N_CELLS) for c in (0, 1)], float)
    text, meta, log = Logistic().fit(xs, ys), Cells().fit(*own), []
    for _ in range(rounds):
        platt = Logistic().fit(text.margin(x[kept])[:, None], y[kept]), Logistic().fit(meta.margin(cell[kept])[:, None], y[kept])
        teachers = Teachers(text, meta, platt, tuple(bounds))
        loud = lambda n: np.minimum(1.0, share * len(ys) / 2 / np.maximum(n, 1))
        for step in range(steps):
            got = taught(pool, teachers, text)
            if step == 0:
                named = got["cells"].sum(1)
                meta = Cells().fit(*(own + loud(named)[:, None] * got["cells"]))
                log.append((int(named.sum()), int(got["n"].sum())))
            if not got["n"].sum():
                break  # nothing was taught to the text view
            g, h = text.sums(xs, ys)
            w = loud(got["n"])
            text = text.stepped(g + w @ got["g"], h + np.tensordot(w, got["h"], 1))
    both = np.c_[text.margin(x[kept]), meta.margin(cell[kept])]
    return CoTrained(text, meta, Logistic().fit(both, y[kept]), log)


def _fit(viewed: DataFrame, labels: DataFrame, scratch: Scratch, ident: str, view: str, doc_id: str, label: str, most_rows: int) -> CoTrained:
    rows = viewed.select(F.col(ident).alias("_id"), F.col(f"{view}.says").alias("says"), F.col(f"{view}.cell").alias("cell"))
    known = labels.where(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("_id")).agg(F.max(F.col(f"`{label}`").cast("double")).alias("_y"))
    ids = rows.select("_id").where("_id is not null").distinct()
    chosen = known.join(ids, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    one = rows.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.first("_y").alias("_y"), F.min(F.struct("says", "cell")).alias("_v"))
    got = one.orderBy(F.xxhash64("_id"), "_id").select("_y", "_v.says", "_v.cell").toArrow().combine_chunks()
    pool = scratch.cut(rows.join(known, "_id", "left_anti").select("says", "cell"))
    y = got["_y"].to_numpy() if got.num_rows else np.zeros(0)
    x = _matrix(got["says"])
    cell = got["cell"].to_numpy().astype(np.int64) if got.num_rows else np.zeros(0, np.int64)
    mix = np.random.default_rng(5).permutation(len(y))
    x, cell, y = x[mix], cell[mix], y[mix]
    if len(y) < 8 or len(set(y[np.arange(len(y)) % 4 == 3])) < 2 or len(set(y[np.arange(len(y)) % 4 != 3])) < 2:
        x, cell, y = np.r_[np.zeros((8, N_TEXT)), x], np.r_[np.zeros(8, np.int64), cell], np.r_[np.arange(8) // 4 % 2 * 1.0, y]
    model = fit_views(x, cell, y, pool)
    scratch.drop(pool)
    return model


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", most_rows: int = 20_000) -> CoTrained:
    """Fit on at most ``most_rows`` labelled documents (a documented bound; those of the smallest hashed doc_ids) and on all unlabelled ones.

    Null labels count as none; a document labelled twice is good if any label says so; of
    rows that share a labelled doc_id one counts, the least by its features; a null doc_id is
    unlabelled. With no labelled row
    of one of the classes, eight rows of an even prior are put to them.
    """
    spark = tuned(docs.sparkSession)
    scratch = Scratch(spark, "cotraining")
    viewed = scratch.cut(with_views(docs).select(F.col(f"`{doc_id}`").alias("_id"), "_view"))
    model = _fit(viewed, labels, scratch, "_id", "_view", doc_id, label, most_rows)
    scratch.drop(viewed)
    return model


def _scored(viewed: DataFrame, model: CoTrained, view: str, out: str) -> DataFrame:
    shared = viewed.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def chance(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for says, cell in batches:
            yield pa.array(shared.value.score(_matrix(says), cell.to_numpy().astype(np.int64)) if len(says) else np.zeros(0))

    return viewed.withColumn(out, chance(F.col(f"{view}.says"), F.col(f"{view}.cell"))).drop(view)


def score(docs: DataFrame, model: CoTrained, out: str = "quality_score") -> DataFrame:
    """Add ``out``, the chance that a document is good, to every row.

    Null texts and metadata have defined features; equal rows get equal scores; an input
    column named like ``out`` is replaced, all others stay; an empty table stays empty.
    """
    own = fresh([*docs.columns, out], "_view")
    return _scored(with_views(docs, out=own), model, own, out)


def fit_and_score(docs: DataFrame, labels: DataFrame, keep: list[str], doc_id: str = "doc_id", label: str = "quality", most_rows: int = 20_000, out: str = "quality_score") -> DataFrame:
    """:func:`fit` and :func:`score` over one table of features, so that texts are read once; returns ``keep`` and ``out``."""
    spark = tuned(docs.sparkSession)
    scratch = Scratch(spark, "cotraining")
    view = fresh([*docs.columns, *keep, out], "_view")
    ident = fresh([*docs.columns, *keep, out, view], "_id")
    kept = [F.col(f"`{c}`") for c in keep]
    viewed = scratch.cut(with_views(docs, out=view).select(*kept, F.col(f"`{doc_id}`").alias(ident), view))
    model = _fit(viewed, labels, scratch, ident, view, doc_id, label, most_rows)
    return _scored(viewed.drop(ident), model, view, out)
