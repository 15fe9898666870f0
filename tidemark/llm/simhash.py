"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most ``bits`` places are cut into so few segments that one
of them differs in at most one bit. Every segment is indexed once per wildcard position,
with that bit cleared; equal signatures then meet in an equality join and are verified on
the whole fingerprint.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, components, fresh, linked, meetings, row_key, texts
from .line_dedup import band_keys, permutations, sketches

BANDS, ROWS = 20, 4  # of MinHash over word shingles
#: Fingerprints beyond which keys also hold a piece of the other bits, so that few meet by chance.
MANY = 1 << 24
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """The SimHash of a whole text; 0 if it has no word."""
    words = _WORDS(text.encode().translate(_LOWER))
    if not words:
        return 0
    line, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, n)
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in pairs), np.uint64, n - k + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):  # bounded memory for very long texts
        block = hashes[at : at + (1 << 15)]
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * total > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """Rows (doc_id, fp): the 64 bits as a signed long. Null texts count as empty."""
    kind = df.schema[doc_id].dataType.simpleString()

    def work(c: dict) -> dict:
        fps = np.fromiter((fingerprint(t, width) for t in texts(c[text])), np.uint64, len(c[text]))
        return {"doc_id": c[doc_id], "fp": pa.array(fps.view(np.int64))}

    return arrow_map(df, [doc_id, text], f"doc_id {kind}, fp long", work)


def segments(bits: int, size: int = 64) -> list[tuple[int, int]]:
    """(start, length) of the fewest segments of which one differs by at most one bit: bits // n <= 1."""
    n = bits // 2 + 1
    cuts = [size * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variants(fp: Column, bits: int, many: bool = False) -> Column:
    """Array of signatures: for each segment and bit of it, the segment with that bit cleared and the number of the bit.

    A signature of 16 to 31 bits is shared by chance once there are ``many`` fingerprints.
    Then the bits outside the segment are cut into ``bits`` + 1 pieces, of which one must be
    equal, and there is a signature per segment, bit and piece. Both forms miss no pair.
    """
    out = []
    for start, length in segments(bits):
        part = F.shiftrightunsigned(fp, start).bitwiseAND((1 << length) - 1)
        signatures = [F.shiftleft(part.bitwiseAND(~(1 << i)), 6).bitwiseOR(F.lit(start + i)) for i in range(length)]
        if many:
            others = [i for i in range(64) if not start <= i < start + length]
            cuts = [len(others) * k // (bits + 1) for k in range(bits + 2)]
            masks = [sum(1 << i for i in others[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
            masks = [m - (1 << 64) if m >> 63 else m for m in masks]
            signatures = [F.xxhash64(s, fp.bitwiseAND(F.lit(m)), F.lit(k)).bitwiseAND(F.lit((1 << 63) - 1)) for s in signatures for k, m in enumerate(masks)]
        out += signatures
    return F.array(*out)


def classes(prints: DataFrame, scratch: Scratch, bits: int = 4) -> DataFrame:
    """Rows (fp, component) for all fingerprints that have a link to a different one.

    Works on distinct fingerprints: copies are one row, whatever their number.
    """
    ids = scratch.cut(prints.select(F.col("fp").alias("id")).distinct())
    many = ids.count() > MANY
    ids = ids.repartition(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a few MB that grow to many
    index = ids.select(F.explode(variants(F.col("id"), bits, many)).alias("key"), "id", F.col("id").alias("code"))
    met = meetings(index, scratch, bits)
    return components(met.where("id <> low").select(F.col("low").alias("src"), F.col("id").alias("dst")), scratch).select(F.col("id").alias("fp"), "component")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 4, width: int = 4) -> DataFrame:
    """Rows (doc_id, fp, component_id): one per input row, component_id the smallest doc_id reachable by links.

    Texts without a word (null included) share fingerprint zero and are linked like any
    other. Repeated rows and ties share a component. Empty tables give no rows. Null
    doc_ids are linked too but never become a component's id, unless nothing else is there.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    prints = scratch.cut(fingerprints(df, doc_id, text, width))
    found = classes(prints, scratch, bits)
    low = prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    low = scratch.cut(low.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    best = low.groupBy("component").agg(F.min("low").alias("component_id"))
    named = low.join(best, "component").select("fp", "component_id", "low", "n")
    # only fingerprints of more than one document, or of a component of several, need a look-up
    shared = scratch.cut(named.where("n > 1 or component_id <> low or low is null").select("fp", "component_id"))
    return prints.join(shared, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def shingle_set(text: str, width: int) -> set[bytes]:
    words = _WORDS(text.encode().translate(_LOWER))
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def text_key(text: str) -> int:
    """64 bits for the words of a text, as a signed long: texts of equal words share every shingle."""
    return xxhash.xxh64_intdigest(b" ".join(_WORDS(text.encode().translate(_LOWER))), 7) - (1 << 63)


def shingle_bands(all_texts: list[str], width: int = 5, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """MinHash band keys (len(all_texts), bands), all negative, and sketches over the ``width``-word shingles of each text."""
    digest, out, codes, at = xxhash.xxh64_intdigest, np.empty((len(all_texts), bands), np.int64), np.empty(len(all_texts), np.int64), 0
    while at < len(all_texts):
        low, size, stop = [], 0, at
        while stop < len(all_texts) and size < 1 << 18:
            words = _WORDS(all_texts[stop].encode().translate(_LOWER)) or [b""]
            n, k = len(words), min(width, len(words))
            h = np.fromiter(map(digest, words), np.uint64, n)
            run = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                run = (run ^ h[j : j + n - k + 1]) * np.uint64(0x9E3779B97F4A7C15)
                run ^= run >> np.uint64(32)
            low.append((run & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            size, stop = size + len(run), stop + 1
        starts = np.cumsum([0, *map(len, low[:-1])])
        flat = np.concatenate(low)
        least = np.stack([np.minimum.reduceat(flat * x + y, starts) for x, y in zip(*permutations(bands * rows), strict=True)], 1)
        out[at:stop], codes[at:stop] = band_keys(least, bands, rows), sketches(least)
        at = stop
    return out | np.int64(-1 << 63), codes


def signatures(df: DataFrame, print_width: int, width: int) -> DataFrame:
    """Rows (doc_id, row, h, fp, bands, sketch): row_key and text_key, fingerprint, MinHash bands and sketch of each text. Null texts count as empty."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def work(c: dict) -> dict:
        all_texts = texts(c["text"])
        fps = np.fromiter((fingerprint(t, print_width) for t in all_texts), np.uint64, len(all_texts))
        keys, codes = shingle_bands(all_texts, width)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(all_texts) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
        return {"doc_id": c["doc_id"], "row": c["row"], "h": pa.array([text_key(t) for t in all_texts], pa.int64()), "fp": pa.array(fps.view(np.int64)), "bands": lists, "sketch": pa.array(codes)}

    source = df.select("doc_id", row_key("text").alias("row"), "text")
    return arrow_map(source, ["doc_id", "row", "text"], f"doc_id {kind}, row long, h long, fp long, bands array<long>, sketch long", work)


def similar(near: DataFrame, docs: DataFrame, first: DataFrame, width: int, least: float, scratch: Scratch, together: int = 4096) -> DataFrame:
    """Of the pairs (src, dst) of texts, told by ``h``, those whose texts have a Jaccard similarity of ``least`` or more.

    ``first``: a row (h, doc_id, row) of ``docs`` for each h. The text of a dst moves to its
    src, that of a src once to each lot of about ``together`` of its dsts: a pass over
    the sorted rows keeps one set and compares it with those that follow.
    """
    near = scratch.cut(near)
    ids = near.select(F.col("src").alias("h")).union(near.select(F.col("dst").alias("h"))).distinct()
    wanted = first.select("h", F.col("doc_id").alias("_d"), F.col("row").alias("_r")).join(ids, "h", "left_semi")
    found = docs.select("doc_id", "text", row_key("text").alias("row")).join(wanted, F.expr("row = _r and doc_id <=> _d"))
    lines = scratch.cut(found.select("h", "text").dropDuplicates(["h"]))
    lots = F.ceil(F.count("*") / F.lit(together)).alias("_lots")
    dealt = near.join(near.groupBy("src").agg(lots).where("_lots > 1"), "src", "left").withColumn("lot", F.when(F.col("_lots") > 1, F.pmod(F.xxhash64("dst"), F.col("_lots"))).otherwise(0))
    dealt = scratch.cut(dealt.select("src", "dst", "lot"))
    head = dealt.select("src", "lot").distinct().join(lines.withColumnRenamed("h", "src"), "src").select("src", "lot", F.lit(None).cast("long").alias("dst"), "text")
    rows = head.union(dealt.join(lines.withColumnRenamed("h", "dst"), "dst").select("src", "lot", "dst", "text"))
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        own: set[bytes] = set()
        for batch in batches:
            src, dst = [], []
            for a, b, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                other = shingle_set(t, width)
                if b is None:
                    own = other
                    continue
                common = len(own & other)
                if common >= least * (len(own) + len(other) - common):
                    src.append(a)
                    dst.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    # nulls first: the text of a src comes before those of its dsts
    return rows.repartition(parts, "src", "lot").sortWithinPartitions("src", "lot", "dst").select("src", "dst", "text").mapInArrow(run, "src long, dst long")


def keep_one(df: DataFrame, bits: int = 4, print_width: int = 2, width: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``df`` that are the first (smallest doc_id) of their near-duplicate group, with its columns.

    Documents are near duplicates if their sets of ``width``-word shingles have a Jaccard
    similarity of ``least`` or more. Candidates are texts whose fingerprints over runs of
    ``print_width`` words differ in at most ``bits`` places, and texts that share a MinHash
    band over the ``width``-word shingles: an added block moves a fingerprint beyond any
    small budget, while bands depend on the similarity alone and miss a pair at 0.8 with
    probability (1 - 0.8 ** ROWS) ** BANDS, 3 in 100,000. Every candidate is verified,
    equal fingerprints of different words too. Texts without a word (null and empty ones
    included) are copies of one another. Rows that share a doc_id are told apart by
    ``row_key`` of their text: each has its own fate, and the smallest key is first of
    several; rows equal in both are one document, and stay or go together. Rows with a
    null doc_id always stay. An empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "simhash-keep")
    docs = df.select("doc_id", "text")
    prints = scratch.cut(signatures(df, print_width, width))
    first = scratch.cut(prints.groupBy("h").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_no"), "doc_id", "row")).alias("_k"), F.min("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).select("h", "_k", "_k.doc_id", "_k.row", "fp", "bands", "sketch"))
    many = first.count() > MANY
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = lambda keys, code: F.transform(keys, lambda k: F.struct(k.alias("key"), F.col(code).alias("code")))
    both = F.concat(keyed("bands", "sketch"), keyed(variants(F.col("fp"), bits, many), "fp"))
    index = first.repartition(parts).select(F.col("h").alias("id"), F.explode(both).alias("k")).select("k.key", "id", "k.code")
    links = lambda pairs: similar(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), docs, first, width, least, scratch)
    found = linked(index, links, scratch, bits)
    low = first.select("h", "_k").join(found.withColumnRenamed("id", "h"), "h", "left").withColumn("component", F.coalesce("component", "h"))
    best = low.groupBy("component").agg(F.min("_k").alias("keeper"))
    keepers = low.join(best, "component").select("h", "keeper")
    d, r = fresh(df.columns, "_d"), fresh(df.columns, "_row")
    lost = prints.where("doc_id is not null").select("doc_id", "row", "h").join(keepers, "h").where("doc_id <> keeper.doc_id or row <> keeper.row")
    lost = scratch.cut(lost.select(F.col("doc_id").alias(d), F.col("row").alias(r)).distinct())
    return df.join(lost, (df["doc_id"] == lost[d]) & (row_key("text") == lost[r]), "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
