"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur with up to k edits. Cut into k + 1 pieces, at least
one of them occurs unchanged. Exact piece hits are found in one pass over each text by an
automaton of all pieces; the place is then verified with Myers' bit-parallel distance.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, tuned


def plain(text: str | None) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join((text or "").lower().split())


def budget(length: int, per: int = 16) -> int:
    """Edits allowed in an item: one per ``per`` characters."""
    return length // per


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length: (offset, piece)."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def distances(item: str, text: str) -> Iterator[int]:
    """After each character of ``text``, the least edit distance of ``item`` to a stretch that ends there."""
    m = len(item)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        yield score


def myers(item: str, text: str, k: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of ``item`` in ``text`` with at most ``k`` edits, the first among equals, or None."""
    return min(((d, end) for end, d in enumerate(distances(item, text), 1) if d <= k), default=None)


def every_place(item: str, text: str, k: int) -> Iterator[tuple[int, int]]:
    """(distance, end) of each place with at most ``k`` edits; of places that overlap, the best."""
    best = None
    for end, d in enumerate(distances(item, text), 1):
        if best and end >= best[1] + len(item) - k:
            yield best
            best = None
        if d <= k and (best is None or d < best[0]):
            best = d, end
    if best:
        yield best


class Matcher:
    """An automaton over the pieces of some items."""

    def __init__(self, items: list[tuple], per: int):
        self.items = [(key, text, budget(len(text), per)) for key, text in ((key, plain(t)) for key, t in items) if text]
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, text, k) in enumerate(self.items):
            for offset, piece in pieces(text, k):
                at[piece].append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()
        self.any = bool(at)

    def find(self, raw: str | None) -> Iterator[tuple[object, int, int, int]]:
        """(item key, start, end, distance) per occurrence, in the plain form of the text; of overlapping places, the best."""
        text = plain(raw)
        if not self.any or not text:
            return
        starts: dict[int, set[int]] = defaultdict(set)
        for last, (n, places) in self.automaton.iter(text):
            for i, offset in places:
                starts[i].add(last + 1 - n - offset)
        for i, found in sorted(starts.items()):
            key, item, k = self.items[i]
            m, run = len(item), []
            short = m < 16  # so short an item must stand between word ends
            for s in [*sorted(found), None]:
                if run and (s is None or s > run[-1] + m + 2 * k):  # else places could overlap
                    yield from self._verify(key, item, k, m, run, text, short)
                    run = []
                if s is not None:
                    run.append(s)

    @staticmethod
    def _verify(key, item: str, k: int, m: int, run: list[int], text: str, short: bool) -> Iterator[tuple[object, int, int, int]]:
        if run[-1] - run[0] <= 2 * k or not k:  # with edits allowed, room for one place
            after = 0
            for s in run:
                if s >= after and text.startswith(item, s) and (not short or ((s == 0 or text[s - 1] == " ") and (s + m == len(text) or text[s + m] == " "))):
                    yield key, s, s + m, 0
                    if k:
                        return
                    after = s + m
        if not k:
            return
        low, high = max(0, run[0] - k), min(len(text), run[-1] + m + k)
        for d, end in every_place(item, text[low:high], k):
            end += low
            # the same distance from the end backwards tells where the place starts
            back = text[max(low, end - m - k) : end][::-1]
            yield key, end - myers(item[::-1], back, d)[1], end, d


def _searcher(shared, kind: T.ArrayType):
    @F.arrow_udf(kind)
    def hits_in(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type

        matcher, arrow = Matcher(*shared.value), to_arrow_type(kind)
        names = ("item_id", "start", "end", "distance")
        for a in batches:
            yield pa.array([[dict(zip(names, h, strict=True)) for h in matcher.find(t)] for t in a.to_pylist()], arrow)

    # else the filter that an explode implies would run the search a second time
    return hits_in.asNondeterministic()


def _passes(spark: SparkSession, benchmark: DataFrame, item_id: str, item_text: str, per: int, block_bytes: int) -> list:
    """One search function per block of the benchmark, each over a broadcast of about ``block_bytes`` of items."""
    items = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = n_bytes // block_bytes + 1
    hit = T.ArrayType(T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), *[T.StructField(n, T.IntegerType()) for n in ("start", "end", "distance")]]))
    found = []
    for block in range(n_blocks):
        rows = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect()]
        found.append(_searcher(spark.sparkContext.broadcast((rows, per)), hit))
    return found


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", per: int = 16, block_bytes: int = 4 << 20, out: str = "hits") -> DataFrame:
    """Add ``out``: where whole items occur in each whole text with at most one edit per ``per`` characters.

    An array of (item_id, start, end, distance); places are code points of the plain form
    (lower case, white space runs as one space). Null and empty items match nothing, null
    and empty texts hold nothing; items of fewer than ``per`` characters must occur
    unchanged. Repeated items are each told; repeated texts have the same hits. The
    benchmark is the query set: its size is measured and it is taken in blocks of about
    ``block_bytes``. Several blocks are several passes over the texts, and a task holds the
    automaton of one: what is found (one row per block and different text) is joined back
    by the text's digest.
    """
    spark = tuned(docs.sparkSession)
    passes, at = _passes(spark, benchmark, item_id, item_text, per, block_bytes), F.col(f"`{text}`")
    if len(passes) == 1:
        return docs.withColumn(out, passes[0](at))
    key, digest = fresh([*docs.columns, out], "_digest"), F.sha2(at, 256)
    found = reduce(DataFrame.union, [docs.select(digest.alias(key), find(at).alias(out)).where(F.size(out) > 0).dropDuplicates([key]) for find in passes])
    found = found.groupBy(key).agg(F.flatten(F.collect_list(out)).alias(out))
    joined = docs.withColumn(key, digest).join(found, key, "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(out), F.array().cast(found.schema[out].dataType)).alias(out))


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", per: int = 16, block_bytes: int = 4 << 20) -> DataFrame:
    """Rows (doc_id, item_id, start, end, distance), one per occurrence; see :func:`search`. Clean documents give no row."""
    spark = tuned(docs.sparkSession)
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = [source.select("doc_id", F.explode(find("text")).alias("hit")) for find in _passes(spark, benchmark, "item_id", "text", per, block_bytes)]
    return reduce(DataFrame.union, found).select("doc_id", "hit.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` in which no test item occurs, with its columns."""
    hits = fresh(docs.columns, "_hits")
    return search(docs, benchmark, text, block_bytes=block_bytes, out=hits).where(F.size(hits) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
