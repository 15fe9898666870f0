"""Fuzzy line deduplication by MinHash over character shingles.

Lines are reduced to distinct ones before anything else, so a line repeated by a third of
all documents is one row. Signatures are banded; lines that share a band and have like
sketches are verified by exact Jaccard similarity; components of the verified links keep
their first line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, components, dealt, fresh, let, meetings, row_key, texts

#: Long lines: unrelated ones share many short shingles, so theirs are long. A pair at 0.8 is missed with probability (1 - 0.8 ** 4) ** 12, 2 in 1,000; at 0.85: 1 in 10,000.
SHINGLE, BANDS, ROWS, JACCARD = 10, 12, 4, 0.8
#: Lines of up to SHORT characters: a changed character spoils up to 10 shingles of 10, over a fifth of a line of under 99. Missed at 0.8: 2 in 1,000.
FINE, SHORT, FINE_BANDS, FINE_ROWS = 4, 140, 16, 5
FEW = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 16  # code points hashed at a time: what is made of them stays in the cache


def plain(line: str) -> str:
    return " ".join(line.lower().split())


def shingle_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` code points, by joining runs of doubled length."""
    with np.errstate(over="ignore"):
        power, run, size = _BASE, codes.astype(np.uint64) + np.uint64(1), 1
        out, done = None, 0
        while True:
            if width & size:
                if out is None:
                    out, done = run, size
                else:
                    # runs of ``size`` followed by what has been collected
                    shift = np.uint64(pow(int(_BASE), done, 1 << 64))
                    n = min(len(run), len(out) - size)
                    out, done = run[:n] * shift + out[size : size + n], done + size
            size *= 2
            if size > width:
                break
            half = size // 2
            run = run[:-half] * power + run[half:]
            power = power * power
        out = out ^ (out >> np.uint64(33))
        out = out * np.uint64(0xFF51AFD7ED558CCD)
        return out ^ (out >> np.uint64(32))


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and offsets of ``n`` MinHash functions of 32 bits."""
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def sketches(least: np.ndarray) -> np.ndarray:
    """A code per row of minima: two bits of each of the first 32."""
    some = least[:, :32].astype(np.uint32)
    some = ((some ^ (some >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(30)
    return np.bitwise_or.reduce(some.astype(np.uint64) << (2 * np.arange(32, dtype=np.uint64)), axis=1).view(np.int64)


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys (n, bands) from minima (n, bands * rows)."""
    least, out = least.astype(np.uint64), np.empty((len(least), bands), np.int64)
    with np.errstate(over="ignore"):
        for k in range(bands):
            key = np.full(len(least), k + 1, np.uint64)
            for r in range(rows):
                key = (key ^ least[:, k * rows + r]) * np.uint64(0x9FB21C651E98DF25)
                key ^= key >> np.uint64(29)
            out[:, k] = key.view(np.int64)
    return out


def minhash_bands(lines: list[str], width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (len(lines), bands) and sketches of plain lines; a line shorter than a shingle is padded to one."""
    a, b = permutations(bands * rows)
    out, codes = np.empty((len(lines), bands), np.int64), np.empty(len(lines), np.int64)
    at = 0
    while at < len(lines):
        stop, size = at, 0
        while stop < len(lines) and (size < _BLOCK or stop == at):
            size += max(len(lines[stop]), width)
            stop += 1
        part = [x if len(x) >= width else x.ljust(width, "\0") for x in lines[at:stop]]
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        hashes = shingle_hashes(np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32), width)
        low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        # runs across two lines belong to none
        ends = np.cumsum(lengths)
        own = np.ones(len(low), bool)
        own[(ends[:-1, None] - np.arange(1, width)).ravel()] = False
        low, starts = low[own], ends - lengths - np.arange(len(part)) * (width - 1)
        one, least = np.empty_like(low), np.empty((len(a), len(part)), np.uint32)
        for k in range(len(a)):
            np.multiply(low, a[k], out=one)
            np.add(one, b[k], out=one)
            np.minimum.reduceat(one, starts, out=least[k])
        out[at:stop], codes[at:stop] = band_keys(least.T, bands, rows), sketches(least.T)
        at = stop
    return out, codes


def scan(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, row, n_lines, line_no, h, line): every line with a word, in plain form, its hash and, with a text's first, how many it has."""
    kind = df.schema[doc_id].dataType.simpleString()

    def work(c: dict) -> dict:
        rows, numbers, lines, sizes = [], [], [], []
        for i, t in enumerate(texts(c["text"])):
            before = len(lines)
            for n, line in enumerate(t.lower().split("\n")):
                # of white space, blanks alone are printable
                p = line.strip(" ") if line.isprintable() and "  " not in line else " ".join(line.split())
                if p:
                    rows.append(i)
                    numbers.append(n)
                    lines.append(p)
            sizes += [len(lines) - before, *[None] * (len(lines) - before - 1)][: len(lines) - before]
        hashes = np.fromiter((xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass"), 1) for p in lines), np.uint64, len(lines)).view(np.int64)
        at = pa.array(rows, pa.int64())
        return {"doc_id": c["doc_id"].take(at), "row": c["row"].take(at), "n_lines": pa.array(sizes, pa.int64()), "line_no": pa.array(numbers, pa.int32()), "h": pa.array(hashes), "line": pa.array(lines, pa.string())}

    source = df.select(F.col(f"`{doc_id}`").alias("doc_id"), row_key(text).alias("row"), F.col(f"`{text}`").alias("text"))
    return arrow_map(source, ["doc_id", "row", "text"], f"doc_id {kind}, row long, n_lines long, line_no int, h long, line string", work)


def band_index(distinct: DataFrame, fine: int | None) -> DataFrame:
    """Lots of (key, id, code), as :func:`dealt` packs them: the bands of each line (h, line), all keys negative.

    The lowest bit of a key tells the width of its shingles: 0 for SHINGLE, 1 for ``fine``.
    Lines of at most SHORT code points have fine keys; those from 0.8 times that on have
    wide keys, so that longer ones meet them.
    """
    sign = np.int64(-1 << 63)

    def work(c: pa.RecordBatch) -> list[np.ndarray]:
        ids, lines = c.column(0).to_numpy(), c.column(1).to_pylist()
        size = np.fromiter(map(len, lines), np.int64, len(lines))
        kinds = [(SHINGLE, BANDS, ROWS, 0, size >= JACCARD * (SHORT - SHINGLE) if fine else size > 0)]
        kinds += [(fine, FINE_BANDS, FINE_ROWS, 1, size <= SHORT)] if fine else []
        key, id_, code = [], [], []
        for width, bands, rows, odd, which in kinds:
            at = np.flatnonzero(which)
            keys, codes = minhash_bands([lines[i] for i in at], width, bands, rows)
            key.append(((keys & np.int64(-2)) | np.int64(odd) | sign).ravel())
            id_.append(np.repeat(ids[at], bands))
            code.append(np.repeat(codes, bands))
        return [np.concatenate(x) for x in (key, id_, code)]

    return dealt(distinct.select("h", "line"), work)


def _common(a: str, b: str, n: int, end: bool) -> int:
    """Length of the common start (or end) of two lines, ``n`` at most."""
    low = 0
    while low < n:
        mid = (low + n + 1) // 2
        same = a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low] if end else a[low:mid] == b[low:mid]
        low, n = (mid, n) if same else (low, mid - 1)
    return low


_BINS = 512


class Bucket:
    """Lines of one group. ``add`` returns the ids of earlier lines that link a new one to components it isn't in.

    A line is first held against one leader of each component, then against the members of
    components that none of their leaders brought in: every pair of lines in different
    components is compared, and near copies cost one comparison each. Where there are many,
    counts of shingles by bin, whose minima bound what two lines have in common, rule out
    most before any is compared. Similarity is that of the sets of 64-bit shingle hashes.
    """

    def __init__(self, least: float, width: int):
        self.least, self.width, self.ids, self.lines, self.sets = least, width, [], [], []
        self.bins, self.sizes, self.comp, self.led, self.binned = np.zeros((8, _BINS), np.uint16), np.zeros(8, np.int64), np.zeros(8, np.int64), np.zeros(8, bool), np.zeros(8, bool)

    def _set(self, i: int) -> np.ndarray:
        """The sorted distinct shingle hashes of line ``i``; kept for leaders."""
        if self.sets[i] is not None:
            return self.sets[i]
        line = self.lines[i].ljust(self.width, "\0")
        found = shingle_hashes(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32), self.width)
        found.sort()
        new = np.empty(len(found), bool)
        new[0], new[1:] = True, found[1:] != found[:-1]
        found = found[new]
        self.sizes[i] = len(found)
        if self.led[i] or i == len(self.ids) - 1:
            self.sets[i] = found
        return found

    def _bin(self, i: int) -> None:
        if not self.binned[i]:
            self.binned[i] = True
            self.bins[i] = np.minimum(np.bincount((self._set(i) & np.uint64(_BINS - 1)).astype(np.int64), minlength=_BINS), 65535)

    def _alike(self, i: int, k: int) -> bool:
        """Whether line ``i``, whose set is known, and line ``k`` have a Jaccard similarity of ``least`` or more."""
        a, b = self.lines[i], self.lines[k]
        n = min(len(a), len(b))
        if n >= self.width:
            # all shingles but those of the differing middle are common
            start = _common(a, b, n, False)
            end = _common(a, b, n - start, True)
            common = max(0, start - self.width + 1) + max(0, end - self.width + 1)
            odd_a, odd_b = (len(x) - self.width + 1 - common for x in (a, b))
            if self.sizes[i] - odd_a >= self.least * (self.sizes[i] + odd_b):
                return True
        a, b = self._set(i), self._set(k)
        if min(len(a), len(b)) < self.least * max(len(a), len(b)):
            return False
        common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
        return common >= self.least * (len(a) + len(b) - common)

    def _join(self, me: int, others: np.ndarray, out: list[int]) -> None:
        if len(others) > 8:
            for i in [me, *others[~self.binned[others]].tolist()]:
                self._bin(i)
            mine = self.sizes[me]
            possible = np.empty(len(others), np.int64)
            for at in range(0, len(others), 256):
                possible[at : at + 256] = np.minimum(self.bins[others[at : at + 256]], self.bins[me]).sum(1, dtype=np.int64)
            full = (self.bins[others] == 65535).any(1)  # such a count bounds nothing
            others = others[full | (possible >= self.least * (self.sizes[others] + mine - possible))]
        for i in others.tolist():
            if self.comp[i] != self.comp[me]:
                if not self.sizes[i]:
                    self._set(i)
                if self._alike(i, me):
                    out.append(self.ids[i])
                    n = len(self.ids)
                    self.comp[:n][self.comp[:n] == self.comp[me]] = self.comp[i]

    def add(self, id_: int, line: str) -> list[int]:
        me, out = len(self.ids), []
        if me == len(self.comp):
            self.bins, self.sizes, self.comp, self.led, self.binned = (np.concatenate((x, np.zeros_like(x))) for x in (self.bins, self.sizes, self.comp, self.led, self.binned))
        self.ids.append(id_)
        self.lines.append(line)
        self.sets.append(None)
        self.comp[me] = me
        self._join(me, np.flatnonzero(self.led[:me]), out)
        self._join(me, np.flatnonzero(~self.led[:me] & (self.comp[:me] != self.comp[me])), out)
        self.led[me] = not out
        if out:
            self.sets[me] = None
        return out


def shingle_sets(lines: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each line, hashed together."""
    part = [x if len(x) >= width else x.ljust(width, "\0") for x in lines]
    lengths = np.fromiter(map(len, part), np.int64, len(part))
    hashes = shingle_hashes(np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32), width)
    ends = np.cumsum(lengths)
    starts, stops = ends - lengths, ends - width + 1
    for s, e in zip(starts.tolist(), stops.tolist(), strict=True):
        hashes[s:e].sort()
    new = np.empty(len(hashes), bool)
    np.not_equal(hashes[1:], hashes[:-1], out=new[1:])
    new[starts] = True
    # runs across two lines belong to none
    new[(stops[:-1, None] + np.arange(width - 1)).ravel()] = False
    return np.split(hashes[new], np.cumsum(np.add.reduceat(new, starts, dtype=np.int64))[:-1])


def few_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between the lines of a small group, from their shingles, as :class:`Bucket` finds them: every two in different components are compared."""
    out, comp, led, rest, may = [], list(range(len(sets))), [], [], None
    if len(sets) > 3:
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        bins = np.bincount((np.concatenate(sets) & np.uint64(_BINS - 1)).astype(np.int64) + np.repeat(np.arange(len(sets)) * _BINS, sizes), minlength=len(sets) * _BINS).reshape(-1, _BINS).astype(np.int32)
    for me, b in enumerate(sets):
        alone = True
        if len(sets) > 3:
            # shingles counted by bin bound what two lines have in common
            most = np.minimum(bins[:me], bins[me]).sum(1)
            may = (most >= least * (sizes[:me] + sizes[me] - most)).tolist()
        for k in led + rest:
            if comp[k] == comp[me] or may and not may[k]:
                continue
            a = sets[k]
            if min(len(a), len(b)) < least * max(len(a), len(b)):
                continue
            both = np.concatenate((a, b))
            both.sort()
            common = np.count_nonzero(both[1:] == both[:-1])
            if common >= least * (len(both) - common):
                out.append((k, me))
                old, alone = comp[me], False
                comp = [comp[k] if c == old else c for c in comp]
        (led if alone else rest).append(me)
    return out


def verified(rows: DataFrame, least: float, fine: int | None = None) -> DataFrame:
    """Links (src, dst) from rows (g, id, line) that are sorted by group within a partition. Odd groups are of ``fine`` shingles.

    Groups of up to FEW lines are hashed many at a time; a larger one goes through a :class:`Bucket`, line by line.
    """

    def settled(groups: list[tuple[int, list[int], list[str]]]) -> tuple[list[int], list[int]]:
        src, dst = [], []
        for odd in (0, 1):
            some = [(ids, lines) for g, ids, lines in groups if g & 1 == odd and len(ids) > 1]
            if some:
                sets, at = shingle_sets([x for _, lines in some for x in lines], fine if odd else SHINGLE), 0
                for ids, _ in some:
                    for a, b in few_links(sets[at : at + len(ids)], least):
                        src.append(ids[a])
                        dst.append(ids[b])
                    at += len(ids)
        return src, dst

    def run(batches):
        groups, size, bucket, last = [], 0, None, None
        batch = lambda src, dst: pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])
        for rows in batches:
            src, dst = [], []
            for g, i, line in zip(*(rows.column(j).to_pylist() for j in range(3)), strict=True):
                if g != last:
                    if size >= _BLOCK:
                        yield batch(*settled(groups))
                        groups, size = [], 0
                    groups.append((g, [], []))
                    bucket, last = None, g
                if bucket is None and groups[-1][1] and (len(groups[-1][1]) == FEW or size + len(line) > 8 * _BLOCK):
                    _, ids, lines = groups.pop()
                    yield batch(*settled(groups))
                    groups, size, bucket = [(g, [], [])], 0, Bucket(least, fine if g & 1 else SHINGLE)
                    for k, x in zip(ids, lines, strict=True):
                        found = bucket.add(k, x)
                        src += found
                        dst += [k] * len(found)
                if bucket is None:
                    groups[-1][1].append(i)
                    groups[-1][2].append(line)
                    size += len(line)
                else:
                    found = bucket.add(i, line)
                    src += found
                    dst += [i] * len(found)
            if src:
                yield batch(src, dst)
        yield batch(*settled(groups))

    return rows.select("g", "id", "line").mapInArrow(run, "src long, dst long")


def removals(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = JACCARD, most_in_task: int = 1 << 13, fine: int | None = None) -> DataFrame:
    """Rows (doc_id, row, n_lines, removed): line numbers (from 0) that repeat an earlier line, exactly or fuzzily.

    Lines are compared in plain form (lower case, white space runs as one space), one line
    per 64-bit hash; lines without a word are left alone. Of each component of lines linked
    at Jaccard ``least`` over 10-character shingles, the first by (doc_id, line number)
    stays. With ``fine``, two lines of at most SHORT characters are linked over shingles of
    ``fine`` characters instead, and a longer one only to lines of at least 0.8 * (SHORT -
    SHINGLE) characters. Null and empty texts have no lines and give no row. Rows that
    share a doc_id are told apart by ``row`` (:func:`row_key` of their text), ordered by it
    where doc_id and line number are equal, and never lose a line for one another's sake;
    rows equal in both are one document, with one row here. Null doc_ids come first.
    ``most_in_task`` bounds what a task compares and changes no result.
    """
    scratch = Scratch(df.sparkSession, "lines")
    rows = scratch.cut(scan(df, doc_id, text))
    # the text of a line moves once, to be one of its equals
    distinct = scratch.cut(rows.groupBy("h").agg(F.min(F.struct("doc_id", "line_no", "row")).alias("first"), F.count("*").alias("n"), F.first("line").alias("line")))
    rows = scratch.cut(rows.drop("line"), drop=rows)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = meetings(band_index(distinct, fine), scratch, most_in_task=most_in_task)
    # small groups of one smallest line overlap: together, their pairs are tried once
    few = F.xxhash64("low").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("g").bitwiseAND(F.lit(1)))
    met = scratch.cut(met.select(F.when(F.col("n") <= FEW, few).otherwise(F.col("g")).alias("g"), "id").distinct())
    lines = met.join(distinct.select(F.col("h").alias("id"), "line"), "id")
    edges = scratch.cut(verified(lines.repartition(parts, "g").sortWithinPartitions("g", "id"), least, fine), drop=met)
    comp = components(edges, scratch).select(F.col("id").alias("h"), "component")
    # a line that occurs once and stands alone needs no look-up
    named = distinct.select("h", "first", "n").join(comp, "h", "left").where("n > 1 or component is not null")
    named = scratch.cut(named.select("h", "first", F.coalesce("component", "h").alias("c")), drop=distinct)
    keeper = named.groupBy("c").agg(F.min("first").alias("keeper"))
    shared = scratch.cut(named.join(keeper, "c").select("h", "keeper"), drop=named)
    gone = rows.select("doc_id", "row", "line_no", "h").join(shared, "h").where("not (struct(doc_id, line_no, row) <=> keeper)")
    lost = gone.groupBy(F.col("doc_id").alias("_d"), F.col("row").alias("_r")).agg(F.sort_array(F.collect_set("line_no")).alias("removed"))
    counts = rows.where("n_lines is not null").groupBy("doc_id", "row").agg(F.max("n_lines").alias("n_lines"))
    out = counts.join(lost, F.expr("row = _r and doc_id <=> _d"), "left")
    return scratch.cut(out.select("doc_id", "row", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed")), drop=rows)


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = JACCARD, fine: int | None = None) -> DataFrame:
    """``df`` with the repeated lines taken out of ``text``; all other columns stay, whatever their names; n_chars follows if there is one.

    A row loses its own lines only (see :func:`removals`), whatever others share its doc_id.
    """
    d, r, gone = fresh(df.columns, "_d"), fresh(df.columns, "_row"), fresh(df.columns, "_removed")
    lost = removals(df, doc_id, text, least, fine=fine).where("size(removed) > 0").select(F.col("doc_id").alias(d), F.col("row").alias(r), F.col("removed").alias(gone))
    col = F.col(f"`{text}`")
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = let(F.split(col, "\n", -1), lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n"))
    out = df.join(lost, df[doc_id].eqNullSafe(lost[d]) & (row_key(text) == lost[r]), "left").withColumn(text, F.when(F.col(gone).isNull(), col).otherwise(kept))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(col).cast(df.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
