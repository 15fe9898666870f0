"""Toxicity by a factorization machine over hashed terms.

A linear term per hashed word and a factor vector per word whose products weigh pairs, so
that two words may be toxic together while neither is alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, tuned

HASH_BITS = 18


@dataclass
class FactorizationMachine:
    """slot: hash bucket to feature, or -1; w: linear weights; v: factors; b: bias."""

    slot: np.ndarray
    w: np.ndarray
    v: np.ndarray
    b: float

    def margins(self, terms: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One margin per row; row i has terms[ends[i]:ends[i + 1]]."""
        feature = self.slot[terms]
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[feature >= 0]
        feature, n = feature[feature >= 0], len(ends) - 1
        out = self.b + np.bincount(row, self.w[feature], n)
        for f in range(self.v.shape[1]):
            x = self.v[feature, f]
            out += 0.5 * (np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n))
        return out


def terms(df: DataFrame, text: str, out: str = "_terms") -> DataFrame:
    """Add ``out``: the distinct hashed words of the whole text (runs of letters and digits, lower case)."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), r"[^\p{L}\p{N}]+"))
    return df.withColumn(out, F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(1 << HASH_BITS)).cast("int")))


def fit_machine(flat: np.ndarray, ends: np.ndarray, y: np.ndarray, most_features: int = 4096, factors: int = 8, epochs: int = 30, seed: int = 7) -> FactorizationMachine:
    """Fit on rows of hashed terms: keep the terms whose rates differ most between the labels, then Adam on the log-loss."""
    rng, size = np.random.default_rng(seed), 1 << HASH_BITS
    row = np.repeat(np.arange(len(y)), np.diff(ends))
    pos, n1, n0 = np.bincount(flat, y[row], size), max(y.sum(), 1.0), max((1 - y).sum(), 1.0)
    neg = np.bincount(flat, minlength=size) - pos
    p1, p0 = (pos + 0.5) / (n1 + 1), (neg + 0.5) / (n0 + 1)
    z = np.log(p1 / p0) / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    best = np.argsort(-np.abs(z), kind="stable")[:most_features]
    best = best[(np.abs(z[best]) >= 3) & (pos[best] + neg[best] >= 3)]
    slot = np.full(size, -1, np.int32)
    slot[best] = np.arange(len(best))
    rate = (y.sum() + 1) / (len(y) + 2)
    m = FactorizationMachine(slot, np.zeros(len(best)), rng.normal(0, 0.01, (len(best), factors)), float(np.log(rate / (1 - rate))))
    if not len(best):
        return m
    feature = slot[flat]
    row, feature = row[feature >= 0], feature[feature >= 0]
    starts = np.searchsorted(row, np.arange(len(y) + 1))
    params = [m.w, m.v]
    mean, square, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 512):
            rows = order[at : at + 512]
            counts = starts[rows + 1] - starts[rows]
            inside = np.repeat(starts[rows] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
            f, r, n = feature[inside], np.repeat(np.arange(len(rows)), counts), len(rows)
            vf = m.v[f]
            sums = np.stack([np.bincount(r, vf[:, k], n) for k in range(factors)], 1)
            squares = np.bincount(r, (vf**2).sum(1), n)
            margin = m.b + np.bincount(r, m.w[f], n) + 0.5 * ((sums**2).sum(1) - squares)
            g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]) / n
            gv = g[r][:, None] * (sums[r] - vf)
            size_f = len(best)
            grads = [np.bincount(f, g[r], size_f) + 1e-5 * m.w, np.stack([np.bincount(f, gv[:, k], size_f) for k in range(factors)], 1) + 1e-4 * m.v]
            t += 1
            rate_t = 0.05 / (1 + epoch / 5)
            for p, d, a, s in zip(params, grads, mean, square, strict=True):
                a += 0.1 * (d - a)
                s += 0.001 * (d * d - s)
                p -= rate_t * (a / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
            m.b -= 0.5 * g.sum()
    return m


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = 20_000) -> FactorizationMachine:
    """Fit on at most ``most_rows`` labelled rows, those of the smallest hashed doc_ids (a documented bound).

    Null labels and rows without a document are left out; a document labelled twice counts
    once, toxic if any label says so. Without labels the machine answers one half.
    """
    tuned(docs.sparkSession)
    chosen = labels.where(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("_id")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    rows = terms(docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text")), "_text").join(F.broadcast(chosen), "_id").select("_id", "_y", "_terms").toArrow()
    rows = rows.combine_chunks().sort_by([("_id", "ascending")])
    if not rows.num_rows:
        return FactorizationMachine(np.full(1 << HASH_BITS, -1, np.int32), np.zeros(0), np.zeros((0, 1)), 0.0)
    lists = rows["_terms"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
    return fit_machine(lists.flatten().to_numpy(), ends, rows["_y"].to_numpy().astype(float))


def score(docs: DataFrame, machine: FactorizationMachine, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: the chance of toxicity of each whole text.

    Null and empty texts get the machine's base rate, equal texts equal scores, repeated
    rows a score each; an input column named like ``out`` is replaced, all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for a in batches:
            ends = np.concatenate(([0], np.cumsum(a.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            yield pa.array(1 / (1 + np.exp(-np.clip(m.margins(a.flatten().to_numpy(), ends), -30, 30))))

    own = fresh([*docs.columns, out], "_terms")
    return terms(docs, text, own).withColumn(out, scored(own)).drop(own)
