"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if a string of ``least`` bytes around it starts earlier as well. Ranking every
position of the corpus is out of reach, so doubling is pruned hard, as suffix sorting
allows: a position that is unique at some length is unique at any greater one.

1. Ranks of runs of 1, 2, 4, ... 32 bytes come from doubling inside each text (the rank of
   a run is that of its halves, as a fingerprint). In every window of ``least`` bytes the
   smallest 32-byte rank is its sample: equal windows have equal samples. Spark groups the
   sampled ranks; samples whose rank is unique drop out.
2. The samples that are left are re-ranked by the whole stretch of windows they stand for:
   the ranks at length ``least`` of its first and last window, which overlap. In each class
   of equal stretches the first is kept; all windows of the later ones start earlier too.
   Samples whose 32-byte rank has only one class are settled with that.
3. Only first stretches that share a sample with a different stretch are ranked window by
   window. Spark sorts them by sample and place, and a pass over the sorted rows finds the
   windows that started before; a sample with very many different stretches is instead
   taken window by window, so that no sample has to fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, arrow_map, row_key

GRAM = 32
_A = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def run_ranks(data: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Fingerprints of all runs of ``length`` bytes, by joining runs of doubled length."""
    run, size, power = data.astype(np.uint64) + np.uint64(1), 1, base
    out, done = None, 0
    while True:
        if length & size:
            if out is None:
                out, done = run, size
            else:
                n = min(len(run), len(out) - size)
                shift = np.uint64(pow(int(base), done, 1 << 64))
                out, done = run[: max(n, 0)] * shift + out[size : size + max(n, 0)], done + size
        size *= 2
        if size > length:
            return out[: max(0, len(data) - length + 1)]
        half = size // 2
        run = _mixed(run[: max(0, len(run) - half)] * power + run[half:])
        power = np.uint64(pow(int(power), 3, 1 << 64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of ``width``: doubled runs, the last two overlapping."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def samples(data: np.ndarray, least: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rank, sample position, first window, number of windows) of the stretches of texts laid end to end.

    Every window start belongs to one stretch: that of the leftmost smallest 32-byte rank
    inside its window. ``ends``: where each text ends; windows across an end don't count.
    """
    if len(data) < least:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty
    grams = _mixed(run_ranks(data, GRAM, _A[0]))
    span = least - GRAM + 1
    low = sliding_min(grams, span)
    starts = np.arange(len(low))
    if ends is not None and len(ends) > 1:
        inside = np.zeros(len(data) + 1, np.int64)
        begins = np.concatenate(([0], ends[:-1]))
        np.add.at(inside, begins, 1)
        np.add.at(inside, np.maximum(begins, ends - least + 1), -1)
        starts = starts[np.cumsum(inside)[: len(low)] > 0]
        if not len(starts):
            return samples(data[:0], least)
    # the leftmost place in the window that attains the minimum; places may be minima of
    # other windows only: step on until the value fits
    places = np.flatnonzero(_attains(grams, low, span))
    pos, want = places[np.searchsorted(places, starts)], low[starts]
    off = np.flatnonzero(grams[pos] != want)
    while len(off):
        pos[off] = places[np.searchsorted(places, pos[off], side="right")]
        off = off[grams[pos[off]] != want[off]]
    cut = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])
    return grams[pos[cut]], pos[cut], starts[cut], np.diff(np.r_[cut, len(starts)])


def _attains(grams: np.ndarray, low: np.ndarray, span: int) -> np.ndarray:
    """Whether each gram is the minimum of some window."""
    pad = np.zeros(span - 1, np.uint64)
    highest = ~sliding_min(~np.concatenate((pad, low, pad)), span)
    return grams == highest[: len(grams)]


def stretch_ranks(data: np.ndarray, least: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rank of the sample, rank of the whole stretch, first window, number of windows) of the stretches of texts."""
    g, pos, lo, n = samples(data, least, ends)
    if not len(g):
        return g, g, lo, n
    w = run_ranks(data, least, _A[1])
    h = _mixed(w[lo] * _A[0] + w[lo + n - 1]) * _A[1] + (n * 128 + pos - lo).astype(np.uint64)
    return g, _mixed(h), lo, n


def _laid(texts: list[str | None], most: int = 1 << 15):
    """Texts laid end to end in runs of about ``most`` bytes: (number of the first, bytes, ends). Short arrays cost more in calls than in work."""
    first, parts, size = 0, [], 0
    for i, t in enumerate(texts):
        parts.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(parts[-1])
        if size >= most or i == len(texts) - 1:
            yield first, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
            first, parts, size = i + 1, [], 0


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _listed(column: pa.Array, *fields: str) -> Iterator[tuple[np.ndarray, ...]]:
    """Row by row, the named fields of a column of lists of structs as arrays; a null list is empty."""
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = column.flatten()
    flat = [flat.field(f).to_numpy(zero_copy_only=False) for f in fields]
    low = 0
    for end in ends.tolist():
        yield tuple(x[low:end] for x in flat)
        low = end


def _longs(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64))


def _ints(parts: list[np.ndarray], kind=np.int32) -> pa.Array:
    return pa.array(np.concatenate([np.zeros(0, np.int64), *parts]).astype(kind))


def _sampled(df: DataFrame, least: int) -> DataFrame:
    """The rank of every sample."""

    def work(c: dict) -> dict:
        return {"g": _longs([samples(data, least, ends)[0] for _, data, ends in _laid(c["text"].to_pylist())])}

    return arrow_map(df, ["text"], "g long", work)


def _stretches(df: DataFrame, least: int) -> DataFrame:
    """Rows (g, h, doc_id, row, lo, n) per stretch."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def work(c: dict) -> dict:
        g, h, row, lo, n = [], [], [], [], []
        for first, data, ends in _laid(c["text"].to_pylist()):
            found = stretch_ranks(data, least, ends)
            which = np.searchsorted(ends, found[2], side="right")
            g.append(found[0])
            h.append(found[1])
            row.append(which + first)
            lo.append(found[2] - np.concatenate(([0], ends))[which])
            n.append(found[3])
        return {"g": _longs(g), "h": _longs(h), "doc_id": c["doc_id"].take(at := _ints(row, np.int64)), "row": c["row"].take(at), "lo": _ints(lo), "n": _ints(n)}

    return arrow_map(df, ["doc_id", "row", "text"], f"g long, h long, doc_id {kind}, row long, lo int, n int", work)


def _ranked(picked: DataFrame, least: int, kind: str) -> DataFrame:
    """Rows (g, h, doc_id, row, lo, hot, w) per stretch asked for: w holds the ranks of its windows, eight bytes each."""

    def work(c: dict) -> dict:
        g, h, row, lo, hot, w = [], [], [], [], [], []
        for i, (t, asked) in enumerate(zip(c["text"].to_pylist(), _listed(c["_at"], "g", "h", "lo", "n", "hot"), strict=True)):
            ranks = run_ranks(_bytes(t), least, _A[1])
            for a, b, at, n, x in zip(*(v.tolist() for v in asked), strict=True):
                part = ranks[at : at + n]
                if len(part):
                    g.append(a)
                    h.append(b)
                    row.append(i)
                    lo.append(at)
                    hot.append(x)
                    w.append(part.tobytes())
        at = pa.array(row, pa.int64())
        return {"g": pa.array(g, pa.int64()), "h": pa.array(h, pa.int64()), "doc_id": c["doc_id"].take(at), "row": c["row"].take(at), "lo": pa.array(lo, pa.int32()), "hot": pa.array(hot, pa.bool_()), "w": pa.array(w, pa.binary())}

    return arrow_map(picked, ["doc_id", "row", "text", "_at"], f"g long, h long, doc_id {kind}, row long, lo int, hot boolean, w binary", work)


def _seen_before(ranked: DataFrame, kind: str) -> DataFrame:
    """Rows (g, h, doc_id, row, lo, n): runs of windows of a sample that start earlier as well. One pass over rows sorted by sample and place.

    Rows of one doc_id have one order of places, so they are judged together.
    """
    shape = f"g long, h long, doc_id {kind}, row long, lo int, n int"
    schema = to_arrow_schema(T.StructType.fromDDL(shape))

    def run(batches):
        seen: set[int] = set()
        held: list[tuple] = []

        def told() -> list[tuple]:
            """The runs of what is held, all of one sample and doc_id."""
            nonlocal held
            lowest: dict[int, int] = {}
            if len(held) > 1:
                for *_, at, ranks in held:
                    for p, r in enumerate(ranks, at):
                        if lowest.get(r, p + 1) > p:
                            lowest[r] = p
            rows = []
            for g, h, doc, row, at, ranks in held:
                if len(held) > 1:
                    old = np.fromiter((r in seen or lowest[r] < p for p, r in enumerate(ranks, at)), np.int8, len(ranks))
                else:  # the windows of a stretch differ: the sample lies elsewhere in each
                    old = np.fromiter((r in seen for r in ranks), np.int8, len(ranks))
                for x, y in np.flatnonzero(np.diff(np.r_[0, old, 0])).reshape(-1, 2).tolist():
                    rows.append((g, h, doc, row, at + x, y - x))
            for *_, ranks in held:
                seen.update(ranks)
            held = []
            return rows

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

        for batch in batches:
            out = []
            for g, h, doc, row, at, w in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if held and (held[0][0] != g or held[0][2] != doc):
                    last = held[0][0]
                    out += told()
                    if last != g:
                        seen = set()
                if held and (h, row, at) == (held[-1][1], held[-1][3], held[-1][4]):
                    continue  # a repeated row
                held.append((g, h, doc, row, at, np.frombuffer(w, np.int64).tolist()))
            yield batch_of(out)
        yield batch_of(told())

    return ranked.select("g", "h", "doc_id", "row", "lo", "w").mapInArrow(run, shape)


def _exploded(ranked: DataFrame, kind: str) -> DataFrame:
    """Rows (g, h, w, doc_id, row, p), one per window."""

    def work(c: dict) -> dict:
        parts = [np.frombuffer(w, np.uint64) for w in c["w"].to_pylist()]
        at = pa.array(np.repeat(np.arange(len(parts)), [len(x) for x in parts]).astype(np.int64))
        return {**{k: c[k].take(at) for k in ("g", "h", "doc_id", "row")}, "w": _longs(parts), "p": _ints([a + np.arange(len(x)) for a, x in zip(c["lo"].to_pylist(), parts, strict=True)])}

    return arrow_map(ranked, ["g", "h", "doc_id", "row", "lo", "w"], f"g long, h long, w long, doc_id {kind}, row long, p int", work)


def repeated_windows(docs: DataFrame, scratch: Scratch, least: int, most_in_task: int) -> DataFrame:
    """Rows (doc_id, row, lo, n): runs of window starts at which a window starts that also starts earlier."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    often = scratch.cut(_sampled(docs, least).groupBy("g").count().where("count > 1").select("g"))
    stretches = scratch.cut(_stretches(docs, least).join(often, "g", "left_semi"), drop=often)
    first = scratch.cut(stretches.groupBy("g", "h").agg(F.min(F.struct("doc_id", "lo", "row")).alias("first"), F.count("*").alias("k"), F.min("n").alias("n")))
    rest = stretches.join(first.where("k > 1").select("g", "h", "first"), ["g", "h"]).where("struct(doc_id, lo, row) <> first")
    rest = scratch.cut(rest.select("g", "h", "doc_id", "row", "lo", "n", F.expr("doc_id = first.doc_id and lo = first.lo").alias("tie")), drop=stretches)
    later = rest.where("not tie").select("doc_id", "row", "lo", "n")
    # other rows of the first one's doc_id that hold the stretch at the same place: what is found in it holds for them
    ties = rest.where("tie").select("g", "h", F.col("row").alias("other")).distinct()
    several = first.groupBy("g").count().where("count > 1").select("g", (F.col("count") > most_in_task).alias("hot"))
    asked = first.join(several, "g").select("first.doc_id", "first.row", "first.lo", "n", "g", "h", "hot").groupBy("doc_id", "row").agg(F.collect_list(F.struct("lo", "n", "g", "h", "hot")).alias("_at"))
    ranked = scratch.cut(_ranked(docs.join(asked, ["doc_id", "row"]), least, kind), drop=first)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    early = _seen_before(ranked.where("not hot").repartition(parts, "g").sortWithinPartitions("g", "doc_id", "lo", "row"), kind)
    windows = _exploded(ranked.where("hot"), kind)
    starts = windows.groupBy("g", "w").agg(F.min(F.struct("doc_id", "p")).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    more = windows.join(starts, ["g", "w"]).where("struct(doc_id, p) <> first").select("g", "h", "doc_id", "row", F.col("p").alias("lo"), F.lit(1).alias("n"))
    inside = scratch.cut(early.union(more))
    return later.union(inside.drop("g", "h")).union(inside.join(ties, ["g", "h"]).select("doc_id", F.col("other").alias("row"), "lo", "n"))


def remove_repeats(df: DataFrame, least: int = 100, doc_id: str = "doc_id", text: str = "text", most_in_task: int = 2_000) -> DataFrame:
    """Rows (doc_id, text, spans, kept): spans (start, end) of removed bytes, and the bytes that stay.

    One row per input row; null and empty texts have no spans and keep no bytes. "Earlier"
    is a smaller doc_id or, within a document, a smaller start; strings never cross
    documents and are judged on the input. Null doc_ids neither remove nor lose anything.
    Rows that share a doc_id have one order of places: of a string that two of them hold,
    the smaller start is earlier, and at equal starts neither is. What is found for a row
    is taken from that row only, told by its doc_id and ``row_key``. ``most_in_task`` is the number of different
    stretches of one sample up to which a task compares them; it changes no result.
    """
    scratch = Scratch(df.sparkSession, "repeats")
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), row_key(text).alias("row"))
    found = repeated_windows(docs.where("doc_id is not null"), scratch, least, most_in_task)
    asked = scratch.cut(found.distinct().groupBy(F.col("doc_id").alias("_d"), F.col("row").alias("_r")).agg(F.collect_list(F.struct("lo", "n")).alias("_at")))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(c: dict) -> dict:
        spans, kept = [], []
        for t, (lo, n) in zip(c["text"].to_pylist(), _listed(c["_at"], "lo", "n"), strict=True):
            data = _bytes(t)
            if not len(lo):
                spans.append([])
                kept.append(data.tobytes())
                continue
            edges = np.zeros(len(data) + 1, np.int64)
            hi = np.minimum(lo.astype(np.int64) + n + least - 1, len(data))
            np.add.at(edges, lo, 1)
            np.add.at(edges, hi, -1)
            gone = np.cumsum(edges[:-1]) > 0
            turns = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            spans.append([{"start": a, "end": b} for a, b in turns.reshape(-1, 2).tolist()])
            kept.append(data[~gone].tobytes())
        return {"doc_id": c["doc_id"], "n_bytes": pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in c["text"].to_pylist()], pa.int64()), "spans": spans, "kept": pa.array(kept, pa.binary())}

    both = docs.join(asked, F.expr("row = _r and doc_id = _d"), "left").select("doc_id", "text", "_at")
    return arrow_map(both, ["doc_id", "text", "_at"], f"doc_id {kind}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary", work)
