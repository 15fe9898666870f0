"""Phrase collocations by vertical positional inverted lists.

Words are numbered along blocks of text, a gap at each end of a piece, and every word of a
block has its list of positions, ascending. The list of a longer phrase comes from a merge of
the list of its first words with the lists of the words that stand next to them; how long
the lists of a phrase are, over all blocks, is its exact frequency. Only phrases whose parts
are frequent are extended. Blocks hold a bounded number of words, and what Spark shuffles are
a block's words, its phrases with the lengths of their lists, and which of them go on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map

#: Words of a block at most, all languages of a task together.
BLOCK = 1 << 21
#: Fixed characters that end a piece and that end a word; A-Z in lower case. A piece's end becomes a full stop.
_PLAIN = bytearray(range(256))
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _PLAIN[_c] = ord(".")
for _c in range(65, 91):
    _PLAIN[_c] = _c + 32
_PLAIN = bytes(_PLAIN)
_END = re.compile(r"[.,;:!?\x0a-\x0d]")


def tokens(text: str) -> list[bytes]:
    """The words of a text in lower case, with b"." where a piece ends (no word holds one)."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).replace(b".", b" . ").split()


class _Codes(dict):
    """Numbers for words, in order of appearance; b"." is 0."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def blocks(df: DataFrame, lang: str, text: str, size: int = BLOCK) -> DataFrame:
    """Rows (lang, block, words, counts, codes): the words of a block, how often each occurs in it, and its tokens as places in ``words``.

    ``codes`` are 32-bit numbers, packed, 0 for the end of a piece. ``block`` is unique. A block ends
    with a piece, so that it holds at most ``size`` tokens beyond its last piece.
    """
    schema = "lang string, block long, words array<string>, counts array<long>, codes binary"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[str, tuple[_Codes, list[np.ndarray]]] = {}
        number, n = TaskContext.get().partitionId() << 32, 0

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal number, n
            for lang_, (known, parts) in held.items():
                codes = np.concatenate(parts)
                counts = np.bincount(codes, minlength=len(known))
                counts[0] = 0
                number += 1
                row = [[lang_], [number], [[w.decode("utf-8", "surrogatepass") for w in known]], [counts], [_packed(codes)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=names)
            held.clear()
            n = 0

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in _slices(t or "", 1 << 20):
                    own = tokens(part)
                    if name not in held:
                        held[name] = _Codes(), []
                    held[name][1].append(np.fromiter(map(held[name][0].__getitem__, [*own, b"."]), np.int32, len(own) + 1))
                    n += len(own) + 1
                    if n >= size:
                        yield from told()
        yield from told()

    source = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, schema)


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of all and compressed: they are moved twice."""
    return len(numbers).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T), "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n).T.copy().view("<i4").ravel()


def _slices(text: str, size: int) -> Iterator[str]:
    """A text in parts of about ``size`` characters, each up to the end of a piece."""
    at = 0
    while at < len(text):
        end = _END.search(text, at + size) if at + size < len(text) else None
        stop = end.end() if end else len(text)
        yield text[at:stop]
        at = stop


def word_lists(word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inverted lists of a block: (word, position) of all its words, by word, then position; -1 stands for no word."""
    at = np.flatnonzero(word_at >= 0)
    order = np.argsort(word_at[at], kind="stable")
    return word_at[at][order].astype(np.int64), at[order]


def extend(phrase: np.ndarray, last: np.ndarray, word_at: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists of phrases one word longer: (phrase * n_words + next word, position of that), by phrase, then position.

    ``phrase`` and ``last``: the lists of shorter phrases, by the position of their last word.
    """
    after = word_at[np.minimum(last + 1, len(word_at) - 1)]
    on = (after >= 0) & (last + 1 < len(word_at))
    longer, last = phrase[on] * n_words + after[on], last[on] + 1
    order = np.argsort(longer, kind="stable")
    return longer[order], last[order]


def _lengths(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and the lengths of their lists."""
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)
    return sorted_keys[starts], np.diff(np.r_[starts, len(sorted_keys)])


def _renumbered(tables: DataFrame) -> DataFrame:
    """Rows (block, ids, word_at): the frequent words of a block, ascending, and for each of its tokens the place of its word there or -1."""

    def work(c: dict) -> dict:
        ids, out = [], []
        for codes, known in zip(c["codes"].to_pylist(), c["known"], strict=True):
            code, id_ = (known.values.field(k).to_numpy() for k in (0, 1))
            order, codes = np.argsort(id_), _unpacked(codes)
            place = np.full(int(codes.max(initial=0)) + 1, -1, np.int32)
            place[code[order]] = np.arange(len(order), dtype=np.int32)
            ids.append(id_[order])
            out.append(_packed(place[codes]))
        return {"block": c["block"], "ids": ids, "word_at": pa.array(out, pa.binary())}

    return arrow_map(tables, ["block", "codes", "known"], "block long, ids array<long>, word_at binary", work, each=True)


def _pairs(tables: DataFrame) -> DataFrame:
    """Rows (block, a, b, n): phrases of two frequent words and the lengths of their lists."""

    def work(c: dict) -> dict:
        block, a, b, n = [], [], [], []
        for x, ids, word_at in zip(c["block"].to_pylist(), c["ids"], c["word_at"].to_pylist(), strict=True):
            ids, word_at = ids.values.to_numpy(), _unpacked(word_at)
            pair, size = _lengths(extend(*word_lists(word_at), word_at, len(ids))[0])
            block.append(np.full(len(pair), x))
            a.append(ids[pair // len(ids)])
            b.append(ids[pair % len(ids)])
            n.append(size)
        return _flat(block=block, a=a, b=b, n=n)

    return arrow_map(tables, ["block", "ids", "word_at"], "block long, a long, b long, n long", work, each=True)


def _triples(tables: DataFrame) -> DataFrame:
    """Rows (a, b, c, n): phrases of three words, both pairs frequent, and the lengths of their lists in a block."""

    def work(c: dict) -> dict:
        out = {"a": [], "b": [], "c": [], "n": []}
        for ids, word_at, pairs in zip(c["ids"], c["word_at"].to_pylist(), c["pairs"], strict=True):
            ids, word_at = ids.values.to_numpy(), _unpacked(word_at)
            v = len(ids)
            a, b = (np.searchsorted(ids, pairs.values.field(k).to_numpy()) for k in (0, 1))
            often = np.sort(a * v + b)
            pair, last = extend(*word_lists(word_at), word_at, v)
            at = np.minimum(np.searchsorted(often, pair), len(often) - 1)
            on = often[at] == pair
            triple, _ = extend(at[on], last[on], word_at, v)
            triple, size = _lengths(triple)
            first, third = often[triple // v], triple % v
            tail = (first % v) * v + third
            on = often[np.minimum(np.searchsorted(often, tail), len(often) - 1)] == tail
            for name, x in (("a", ids[first // v]), ("b", ids[first % v]), ("c", ids[third]), ("n", size)):
                out[name].append(x[on])
        return _flat(**out)

    return arrow_map(tables, ["ids", "word_at", "pairs"], "a long, b long, c long, n long", work, each=True)


def _flat(**columns: list[np.ndarray]) -> dict:
    return {k: pa.array(np.concatenate([np.zeros(0, np.int64), *v])) for k, v in columns.items()}


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly: counts of up to 15 digits."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def collocations(df: DataFrame, lang: str = "lang", text: str = "text", least: int = 10, share: int = 50, top: int = 2000, block: int = BLOCK) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two or three words of each language.

    Texts are taken in lower case (A-Z), cut at [.,;:!?] and line ends into pieces, and those
    at blanks and tabs into words. ``a`` is how often a phrase occurs inside pieces (at least
    ``least`` times), ``l`` and ``r`` how often the parts do at its weakest cut, ``n`` the words
    of the language. A phrase of two words that lies in one of three that is at least
    ``share`` % as frequent goes. Order: score, then ``a``, both descending, then phrase.
    Null languages are ``und``; null and empty texts hold no words; repeated rows count each
    time; ties in score and ``a`` go by the bytes of the phrase; an empty table gives no rows;
    other columns are not read. Tasks hold a block of ``block`` tokens, whatever the table.
    """
    scratch = Scratch(df.sparkSession, "phrases")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tables = scratch.cut(blocks(df, lang, text, block))
    words = tables.select("lang", "block", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w")).where("w.counts > 0").select("lang", "block", "code", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    single = scratch.cut(words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()))
    known = words.join(single, ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("code", "id")).alias("known"))
    # lists of the words of a block are bounded by its size
    lists = scratch.cut(_renumbered(tables.select("block", "codes").join(known, "block")))
    totals = scratch.cut(tables.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n")), drop=tables)
    # a pair has a row per block at most: they meet once, are summed, and go back to their blocks
    own = Window.partitionBy("a", "b").orderBy("block")
    f = F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    met = _pairs(lists).withColumns({"f": f, "first": F.row_number().over(own) == 1})
    found = scratch.cut(met.where(F.col("f") >= least).select("block", "a", "b", "f", "first"))
    double = found.where("first").select("a", "b", "f")
    often = found.groupBy("block").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    triple = scratch.cut(_triples(lists.join(often, "block")).groupBy("a", "b", "c").agg(F.sum("n").alias("f")).where(F.col("f") >= least), drop=lists)

    word = lambda x: single.select(F.col("id").alias(x), F.col("word").alias(f"w{x}"), F.col("f").alias(f"f{x}"))
    pair = lambda x, y: double.select(F.col("a").alias(x), F.col("b").alias(y), F.col("f").alias(f"f{x}{y}"))
    cut = lambda k, l, r: F.struct(score(F.col("f"), F.col(l), F.col(r)).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))
    inside = triple.select("a", "b", "f").union(triple.select("b", "c", "f")).groupBy("a", "b").agg(F.max("f").alias("longer"))
    twos = double.join(inside, ["a", "b"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("f")))
    twos = twos.join(word("a"), "a").join(word("b"), "b").select("a", F.concat_ws(" ", "wa", "wb").alias("phrase"), "f", cut(1, "fa", "fb").alias("cut"))
    threes = triple.join(pair("a", "b"), ["a", "b"]).join(pair("b", "c"), ["b", "c"]).join(word("a"), "a").join(word("b").drop("fb"), "b").join(word("c"), "c")
    threes = threes.select("a", F.concat_ws(" ", "wa", "wb", "wc").alias("phrase"), "f", F.least(cut(1, "fa", "fbc"), cut(2, "fab", "fc")).alias("cut"))
    both = twos.union(threes).join(single.select(F.col("id").alias("a"), "lang"), "a").select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # first within shares of a language, so that no task has to sort all of one
    dealt = both.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_r") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
