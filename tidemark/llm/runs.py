"""Periodic runs of words, found on a harmonic grid.

A run is a stretch of words that repeats with a period q, is at least three periods long and
can't be extended. Points q apart are laid over the words for every period q. A run of period
q holds neighbouring points i and i + q early in it, from where at least q words agree; how
far they agree to both sides (their longest common extensions) is the run. Prefix hashes
tell that for all pairs of period and point at once: numpy compares one word, then q, then
halves the open interval. What is found is verified word by word, and the points of one run,
and multiples of its period, collapse to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, texts, tuned

#: Periods a run must hold at least, and words.
TIMES, LEAST = 3, 24
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_TOGETHER = 1 << 15  # words of short texts that are searched as one
_PAIRS = 1 << 20  # pairs of period and grid point held at a time


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    """Powers 0 to n of the factor, modulo 2 ** 64."""
    out = np.full(n + 1, _FACTOR, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _grid(n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(period, point) for periods low to high - 1 and their multiples that have another point after them below ``n``."""
    counts = np.maximum(0, (n - 1) // np.arange(low, high, dtype=np.int64))
    q = np.repeat(np.arange(low, high, dtype=np.int64), counts)
    return q, (np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)) * q


@lru_cache(maxsize=16)
def _kept_grid(n: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The grid of short texts, whose sizes are few."""
    return _grid(n, 1, high)


def _slabs(n: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grid of periods up to ``longest``, in parts of a bounded number of pairs (a period of its own has n / q at most)."""
    if n <= _TOGETHER:
        yield _kept_grid(n, longest + 1)
        return
    low = 1
    while low <= longest:
        high = min(longest + 1, low + max(1, _PAIRS * low // n))
        yield _grid(n, low, high)
        low = high


class _Hashes:
    """Prefix hashes of a sequence of codes."""

    def __init__(self, codes: np.ndarray):
        self.n, self.codes = len(codes), codes
        size = 1 << max(0, self.n - 1).bit_length()
        self.powers = _powers(size)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_mixed(codes.astype(np.uint64)) * self.powers[: self.n], dtype=np.uint64, out=self.sums[1:])

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``size`` words from i and from j > i have the same hash."""
        return (self.sums[i + size] - self.sums[i]) * self.powers[j - i] == self.sums[j + size] - self.sums[j]

    def reach(self, q: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words agree from i and i + q on, and before them, by halving for all at once."""
        out = []
        for back in (False, True):
            low, high = np.zeros_like(i), i.copy() if back else self.n - i - q
            while (open_ := low < high).any():
                mid = (low + high + open_) // 2
                start = i - mid if back else i
                same = self.equal(start, start + q, mid)
                low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
            out.append(low)
        return out[0], out[1]


def _exact(codes: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """Start and end of the stretch of period q around i and i + q, by comparing words."""
    def agree(a: np.ndarray, b: np.ndarray) -> int:
        n, at, step = min(len(a), len(b)), 0, 256
        while at < n:
            off = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
            if len(off):
                return at + int(off[0])
            at, step = at + step, step * 2
        return n

    after, before = agree(codes[i:], codes[i + q :]), agree(codes[:i][::-1], codes[: i + q][::-1])
    return i - before, i + q + after


def find_runs(codes: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of codes, by start, then period; periods up to ``longest``."""
    n = len(codes)
    longest = n // TIMES if longest is None else min(longest, n // TIMES)
    if n < LEAST or not longest:
        return np.zeros((0, 3), np.int64)
    hashes, found = _Hashes(codes), []
    for q, i in _slabs(n, longest):
        at = np.flatnonzero(codes[i] == codes[i + q])
        q, i = q[at], i[at]
        # from its first grid point on, a run goes on for so many words more than q
        least = np.maximum(q + 1, LEAST + 1 - 2 * q)
        fits = i + q + least <= n
        q, i, least = q[fits], i[fits], least[fits]
        alike = hashes.equal(i, i + q, least)
        q, i = q[alike], i[alike]
        if not len(q):
            continue
        after, before = hashes.reach(q, i)
        start, end = i - before, i + q + after
        long = end - start >= np.maximum(LEAST, TIMES * q)
        found.append(np.stack([start, end, q, i], 1)[long])
    if not found or not sum(map(len, found)):
        return np.zeros((0, 3), np.int64)
    found = np.concatenate(found)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    found = found[np.r_[True, (found[1:, :3] != found[:-1, :3]).any(1)]]
    best: dict[tuple[int, int], int] = {}
    for start, end, q, i in found.tolist():
        # of a stretch, its smallest period: any other that is found is a multiple of that
        if (start, end) in best:
            continue
        if not np.array_equal(codes[start : end - q], codes[start + q : end]):  # hashes agreed by chance
            start, end = _exact(codes, i, q)
            if end - start < max(LEAST, TIMES * q):
                continue
        best[start, end] = min(q, best.get((start, end), q))
    rows = sorted((s, q, e - s) for (s, e), q in best.items())
    return np.array(rows, np.int64).reshape(-1, 3)[:, [0, 2, 1]]


def runs_of(all_words: list[list[bytes]]) -> list[np.ndarray]:
    """Runs of each list of words. Short texts of like length are searched together, a word of its own between two."""
    out = [np.zeros((0, 3), np.int64) for _ in all_words]
    order = sorted((i for i, w in enumerate(all_words) if len(w) >= LEAST), key=lambda i: len(all_words[i]))
    at = 0
    while at < len(order):
        batch, size = [], 0
        limit = 1 << (len(all_words[order[at]]) - 1).bit_length()
        while at < len(order) and len(all_words[order[at]]) <= limit and (not batch or size + len(all_words[order[at]]) + 1 <= _TOGETHER):
            size += len(all_words[order[at]]) + 1
            batch.append(order[at])
            at += 1
        ids: dict[bytes, int] = {}
        parts, begins, n = [], [], 0
        for k, i in enumerate(batch):
            begins.append(n)
            parts.append(np.fromiter((ids.setdefault(w, len(ids)) for w in all_words[i]), np.int64, len(all_words[i])))
            parts.append(np.array([-1 - k]))
            n += len(all_words[i]) + 1
        parts.append(-1 - len(batch) - np.arange(max(0, _TOGETHER - n)))  # to the size that grids are kept for
        found = find_runs(np.concatenate(parts), limit // TIMES)
        of = np.searchsorted(begins, found[:, 0], side="right") - 1
        for k in np.unique(of).tolist():
            out[batch[k]] = found[of == k] - np.array([begins[k], 0, 0])
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()])


def periodic_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, runs, best, collapsed), one per input row.

    ``runs``: (start, length, period) in words (runs of anything but ASCII blanks, numbered
    from 0) of every run of the whole text, by start, then period. ``best``: the one of the
    greatest exact length / period (ties: smallest start, then period), null without a run.
    ``collapsed``: the words that no run holds after its first period, joined by one space.
    Null and empty texts have no runs and an empty ``collapsed``; null and repeated doc_ids,
    repeated rows and ties of texts are answered row by row; an empty table gives no rows;
    other columns are not read. One pass, without a shuffle; a text's grid is searched in
    parts, so that memory grows with its words only.
    """
    tuned(df.sparkSession)
    run = "struct<start:long,length:long,period:long>"
    names = ("start", "length", "period")

    def work(c: dict) -> dict:
        rows, bests, kept = [], [], []
        words = [t.encode("utf-8", "surrogatepass").split() for t in texts(c[text])]  # bytes split at just the six ASCII blanks
        for own, found in zip(words, runs_of(words), strict=True):
            told = found.tolist()
            best = None
            for r in told:  # by start, then period: only a greater quotient takes its place
                if best is None or r[1] * best[2] > best[1] * r[2]:
                    best = r
            rows.append([dict(zip(names, r, strict=True)) for r in told])
            bests.append(dict(zip(names, best, strict=True)) if best else None)
            kept.append(collapsed(own, found).decode("utf-8", "surrogatepass"))
        return {"doc_id": c[doc_id], "runs": rows, "best": bests, "collapsed": pa.array(kept, pa.string())}

    return arrow_map(df, [doc_id, text], f"doc_id {df.schema[doc_id].dataType.simpleString()}, runs array<{run}>, best {run}, collapsed string", work)
