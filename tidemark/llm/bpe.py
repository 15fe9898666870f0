"""Byte-level BPE encoding and decoding.

The words of the corpus are counted, and the most frequent distinct ones are folded into
tokens once by Spark's higher-order functions against a literal rank map. Their number is
a parameter, so the table that goes to the executors has a fixed bound. Each text is then
split where it lies and its words are looked up; a word outside the table is folded in the
task by the same rule and remembered. Texts and ids are never shuffled.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let

BUCKETS = 8192
_NEVER = 1 << 40  # the rank of a pair that is no token


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 tokens and ranks. A fixed-size vocabulary file of the driver's host."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: an array of small maps from hex bytes to rank, addressed by CRC32.

    A lookup in a map literal scans it, so the vocabulary is dealt over many small maps.
    """
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        key = token.hex().upper()
        maps[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>", {"maxStringLen": "100000000"})


def rank_of(piece: Column, ranks: Column) -> Column:
    bucket = (F.crc32(piece.cast("binary")) % BUCKETS).cast("int")
    return F.try_element_at(F.get(ranks, bucket), piece)


def fold(word: Column, ranks: Column) -> Column:
    """Token ids of one word: its bytes, merged pair by pair, lowest rank first and leftmost among equals."""
    n = F.octet_length(word)
    start = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.hex(word), 2 * i - 1, F.lit(2)))

    def step(p: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: rank_of(F.concat(F.get(p, i), F.get(p, i + 1)), ranks))

        def merged(r: Column) -> Column:
            at = F.array_position(r, F.array_min(r)).cast("int")
            return F.when(F.array_min(r).isNull(), p).otherwise(
                F.concat(F.slice(p, F.lit(1), at - 1), F.array(F.concat(F.get(p, at - 1), F.get(p, at))), F.slice(p, at + 2, F.greatest(F.size(p) - at - 1, F.lit(0))))
            )

        return F.when(F.size(p) < 2, p).otherwise(let(pairs, merged))

    steps = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    merged = F.transform(F.aggregate(steps, start, step), lambda p: rank_of(p, ranks))
    whole = rank_of(F.hex(word), ranks)
    return F.when(n == 0, F.array().cast("array<int>")).when(whole.isNotNull(), F.array(whole)).otherwise(merged)


def fold_in_task(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold for a word outside the shared table."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > 512:
        return _fold_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    rank = ranks.get
    pairs = [rank(word[i : i + 2], _NEVER) for i in range(len(word) - 1)]
    while pairs:
        best = min(pairs)
        if best == _NEVER:
            break
        at = pairs.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = rank(parts[at - 1] + parts[at], _NEVER)
        if at < len(pairs):
            pairs[at] = rank(parts[at] + parts[at + 1], _NEVER)
    return [ranks[p] for p in parts]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """For very long words: a heap of pairs over linked parts, n log n steps."""
    import heapq

    n = len(word)
    end, prev, nxt, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if alive[i] else -1
        if j < 0 or end[j] != stop:
            continue  # one of the two has been merged since
        end[i], nxt[i], alive[j] = stop, nxt[j], False
        if nxt[j] >= 0:
            prev[nxt[j]] = i
        for a in (prev[i], i):
            if a >= 0 and (b := nxt[a]) >= 0 and (r := ranks.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def word_table(df: DataFrame, text: str, pattern: str, ranks: dict[bytes, int], most_words: int, most_bytes: int) -> dict[str, bytes]:
    """The most frequent words of all texts (of at most ``most_bytes`` bytes) and their ids as int32 bytes.

    All words are counted. A histogram of the counts (a few hundred bins, whatever the
    corpus) tells the least count that at most ``most_words`` words reach, so no task has
    to rank them all. What comes back is at most 5 * most_words * most_bytes bytes.
    """
    scratch = Scratch(df.sparkSession, "words")
    words = df.select(F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit("(?U)" + pattern), F.lit(0))).alias("w"))
    counted = scratch.cut(words.groupBy("w").agg(F.floor(F.log2(F.count("*")) * 16).cast("int").alias("bin")).where(F.octet_length("w") <= most_bytes))
    least, total = 1 << 20, 0
    for r in counted.groupBy("bin").agg(F.count("*").alias("n")).orderBy(F.desc("bin")).collect():
        total += r["n"]
        if total > most_words:
            break
        least = r["bin"]
    often = counted.where(F.col("bin") >= least).select("w").repartition(24)
    # bound once: the plan, of which the driver keeps copies, then holds the literal once
    rows = often.select("w", let(rank_map(ranks), lambda m: fold(F.col("w"), m)).alias("ids")).toArrow().combine_chunks()
    scratch.drop(counted)
    if not rows.num_rows:
        return {}
    lists = rows["ids"].chunk(0)
    raw = lists.flatten().to_numpy().astype("<i4").tobytes()
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))) * 4
    return {w: raw[a:b] for w, a, b in zip(rows["w"].to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)}


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "token_ids", most_words: int = 1 << 17, most_bytes: int = 64, most_kept: int = 400_000) -> DataFrame:
    """Add ``out``: the token ids of each whole text, without special tokens.

    Null and empty texts give an empty array; repeated rows are encoded alike; a column
    called ``out`` is replaced. ``most_words`` and ``most_bytes`` bound the shared table,
    ``most_kept`` what a task remembers; none changes the result.
    """
    import regex

    ranks = read_ranks(ranks_path)
    table = word_table(df, text, pattern, ranks, most_words, most_bytes)
    shared = df.sparkSession.sparkContext.broadcast((ranks, table))

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, common = shared.value
        split = regex.compile(pattern).findall

        class Memo(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) > most_kept + len(common):
                    self.clear()
                    self.update(common)
                found = np.asarray(fold_in_task(word.encode(), known), "<i4").tobytes()
                if len(word) <= most_bytes:
                    self[word] = found
                return found

        get = Memo(common).__getitem__
        for batch in batches:
            coded = [b"".join(map(get, split(t))) if t else b"" for t in batch.to_pylist()]
            ends = np.cumsum([0, *(len(c) // 4 for c in coded)], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4"), pa.int32()))

    return df.withColumn(out, ids_of(F.col(f"`{text}`")))


def decode(df: DataFrame, ranks_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` (binary): the pieces of the ids in order, concatenated. Null ids give null, no ids no bytes.

    The pieces are a literal array in hex, so that joining and one unhex concatenate them in the JVM.
    """
    ranks = read_ranks(ranks_path)
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    literal = F.split(F.lit(",".join(pieces)), ",", -1)
    return df.withColumn(out, F.unhex(F.array_join(F.transform(F.col(f"`{ids}`"), lambda i: F.get(literal, i)), "")))
