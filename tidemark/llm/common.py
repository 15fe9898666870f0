"""What the training-data operators share: table access, lineage cuts and distributed union-find."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The words of a text: runs of anything but the six ASCII blanks (a fixed contract of the queries).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes (texts may be very long), free shuffle files when an execution ends, cut plan texts."""
    spark.conf.set("spark.sql.maxPlanStringLength", "20000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def row_key(text: str) -> Column:
    """64 bits that, beside a doc_id, tell rows apart by their text: what is found for a row is applied to that row alone."""
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def fresh(columns: Iterable[str], stem: str) -> str:
    """A column name that none of ``columns`` has, in any case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode, where that is unset (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="tidemark-")
        if not current.isDefined():
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder. They cut lineage, survive lost executors and can be dropped early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = tuned(spark), f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}", 0

    def cut(self, df: DataFrame, drop: DataFrame | None = None) -> DataFrame:
        """Write ``df`` and read it again; ``drop`` is an earlier table of this scratch that nothing needs any more."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidemark_path = path
        if drop is not None:
            self.drop(drop)
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_tidemark_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it often: a lambda variable can't be inlined by the optimizer."""
    return F.element_at(F.transform(F.array(value), body), 1)


def arrow_map(df: DataFrame, columns: list[str], schema: str | T.StructType, work: Callable[[dict], dict], each: bool = False) -> DataFrame:
    """mapInArrow over ``columns``; ``work`` gets Python/Arrow columns of a batch by name and returns output columns. ``each``: a batch per row, for rows that make many."""
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out, timezone="UTC") if any(isinstance(f.dataType, T.TimestampType) for f in out) else to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in ((b.slice(k, 1) for k in range(b.num_rows)) if each else (b,))):
            cols = {n: batch.column(i) for i, n in enumerate(columns)}
            got = work(cols)
            arrays = [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, arrow, strict=True)], schema=arrow)

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, out)


def texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (src, dst): rows (id, component), component being the smallest id.

    Alternating large-star and small-star steps, each a min per node (combined before the
    shuffle) joined back to the edges, so that no neighbourhood is ever gathered in one
    place; a hub's join partition can be split. Each round is written to the shared folder.
    Nodes without an edge are not returned. Self-loops and repeated edges are allowed.
    """
    now = scratch.cut(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = scratch.cut(small)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


#: Of a MinHash sketch of 32 cells of two bits, the most cells that may differ between texts 0.8 alike: beyond it lie 3 such pairs in a million.
SKETCH_MOST = 15
_CELLS = np.uint64(0x5555555555555555)
MET = "g long, id long, low long, before long, code long, n int, big boolean"


def _near(a: np.ndarray, b: np.ndarray, cells: np.ndarray | bool) -> np.ndarray:
    x = a ^ b
    return np.bitwise_count(np.where(cells, (x | (x >> np.uint64(1))) & _CELLS, x))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _spread(code: np.ndarray, cells: bool, most: int) -> np.ndarray:
    """The first row of the component of each row of one group."""
    label, left = np.arange(len(code)), np.arange(len(code))
    while len(left):
        first, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for at in range(0, len(front), 32):
                near |= (_near(code[left][None, :], code[front[at : at + 32]][:, None], cells) <= most).any(0)
            front, left = left[near], left[~near]
            label[front] = first
    return label


def _labels(key: np.ndarray, code: np.ndarray, limit: np.ndarray, few: int = 48) -> np.ndarray:
    """For rows sorted by key, the first row of the component that links inside its key give each row."""
    n = len(key)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, n])
    cells, label = key < 0, np.arange(n)
    for s, size in zip(starts[sizes > few].tolist(), sizes[sizes > few].tolist(), strict=True):
        label[s : s + size] = s + _spread(code[s : s + size], bool(cells[s]), int(limit[s]))
    rest = np.repeat(starts + sizes, sizes) - np.arange(n)  # rows of the key from here on
    at, a, b = np.flatnonzero((rest > 1) & np.repeat(sizes <= few, sizes)), [], []
    for lag in range(1, few):
        if not len(at):
            break
        hit = at[_near(code[at], code[at + lag], cells[at]) <= limit[at]]
        a.append(hit)
        b.append(hit + lag)
        at = at[rest[at] > lag + 1]
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        while len(a):
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            label = label[label]
            off = label[a] != label[b]
            if not off.any():
                break
    return label


def _met(key: np.ndarray, id_: np.ndarray, code: np.ndarray, bits: int, most: int) -> Iterator[tuple]:
    """MET columns for whole keys, sorted."""
    if len(key) < 2:
        return
    same = key[1:] == key[:-1]
    shared = np.r_[same, False] | np.r_[False, same]
    key, id_, code = key[shared], id_[shared], code[shared]
    if not len(key):
        return
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    large = np.repeat(sizes > most, sizes)
    if large.any():
        yield _large(key[large], id_[large], code[large])
        key, id_, code = key[~large], id_[~large], code[~large]
    label = _labels(key, code, np.where(key < 0, SKETCH_MOST, bits)) if len(key) else np.zeros(0, np.int64)
    size = np.bincount(label, minlength=len(label))[label] if len(label) else label
    at = np.flatnonzero(size > 1)
    if not len(at):
        return
    at = at[np.lexsort((id_[at], code[at], label[at]))]
    key, id_, code, label, size = key[at], id_[at], code[at], label[at], size[at]
    head = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
    of = np.repeat(np.arange(len(head)), size[head])
    low = np.minimum.reduceat(id_, head)
    g = _mixed(np.add.reduceat(_mixed(id_.view(np.uint64)), head) + size[head].astype(np.uint64))
    # sign and lowest bit tell the kind of key
    g = (g & np.uint64(0x7FFFFFFFFFFFFFFE)) | (key[head].view(np.uint64) & np.uint64(0x8000000000000001))
    low_code = np.empty(len(head), np.uint64)
    is_low = id_ == low[of]
    low_code[of[is_low]] = code[is_low]
    before, before_code = np.r_[0, id_[:-1]], np.r_[np.uint64(0), code[:-1]]
    no = np.zeros(len(id_), bool)
    no[head] = True
    # the neighbour in order of codes is worth a try only if it is nearer than the smallest id
    no |= _near(code, before_code, key < 0) >= _near(code, low_code[of], key < 0)
    yield g.view(np.int64)[of], id_, low[of], pa.array(before, mask=no), code.view(np.int64), size.astype(np.int32), np.zeros(len(id_), bool)


def _large(key: np.ndarray, id_: np.ndarray, code: np.ndarray) -> tuple:
    n = len(key)
    return key, id_, id_, pa.nulls(n, pa.int64()), code.view(np.int64), np.zeros(n, np.int32), np.ones(n, bool)


def _meet(rows: DataFrame, bits: int, most: int) -> DataFrame:
    """Components inside each key of rows (key, id, code), which are sorted by key within partitions; rows of larger keys come back as ``big``."""
    names = [c.split()[0] for c in MET.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, big = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)], None

        def out(found: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
            for cols in found:
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            cols[2] = cols[2].view(np.uint64)
            if big is not None:
                stop = np.searchsorted(cols[0], big, "right")
                if stop:
                    yield from out([_large(*[c[:stop] for c in cols])])
                cols = [c[stop:] for c in cols]
                if not len(cols[0]):
                    continue
                big = None
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            cut = np.searchsorted(cols[0], cols[0][-1])  # the last key may go on in the next batch
            yield from out(_met(*[c[:cut] for c in cols], bits, most))
            held = [c[cut:] for c in cols]
            if len(held[0]) > most:
                yield from out([_large(*held)])
                held, big = [c[:0] for c in held], held[0][0]
        yield from out(_met(*held, bits, most))

    return rows.select("key", "id", "code").mapInArrow(run, MET)


#: An index in lots: entries (key, id, code) of 24 bytes, those of a lot of like keys together.
LOTS = "lot int, entries binary"
_DEALT, _HELD = 1 << 18, 1 << 21  # entries packed at a time; entries of one lot after which large keys leave it


def dealt(df: DataFrame, work: Callable[[pa.RecordBatch], list[np.ndarray]]) -> DataFrame:
    """An index as LOTS: ``work`` turns a batch of ``df`` into keys, ids and codes (64 bits each).

    A row per entry costs the exchange and its sort more than all else; a lot's entries are
    one row per task and quarter of a million entries. A key is in one lot; there are 32 for
    each shuffle partition up to 16,384, then 4 for each, 65,536 at most.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lots = np.uint64(min(max(min(32 * parts, 1 << 14), 4 * parts), 1 << 16))
    names = [c.split()[0] for c in LOTS.split(", ")]

    def packed(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        key = np.concatenate(held[0])
        lot = ((_mixed(key.view(np.uint64)) >> np.uint64(32)) % lots).astype(np.uint16)
        order = np.argsort(lot, kind="stable")
        entries = np.empty((len(key), 3), np.int64)
        for k, column in enumerate(held):
            entries[:, k] = (np.concatenate(column) if k else key)[order]
        sizes = np.bincount(lot, minlength=int(lots))
        own = np.flatnonzero(sizes)
        ends = np.r_[0, np.cumsum(sizes[own])].astype(np.int32) * 24
        binary = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(entries)])
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), binary], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [[], [], []], 0
        for batch in batches:
            found = work(batch)
            for k, column in enumerate(found):
                held[k].append(column)
            n += len(found[0])
            if n >= _DEALT:
                yield packed(held)
                held, n = [[], [], []], 0
        if n:
            yield packed(held)

    return df.mapInArrow(run, LOTS)


def _meet_lots(index: DataFrame, bits: int, most: int, least_held: int = _HELD) -> DataFrame:
    """As :func:`_meet`, of LOTS that are sorted by lot within partitions. A lot is held as a whole, but for its large keys once it is long."""
    names = [c.split()[0] for c in MET.split(", ")]

    def out(found: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
        for cols in found:
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)

    def by_key(entries: list[np.ndarray]) -> list[np.ndarray]:
        rows = np.concatenate(entries)
        rows = rows[np.argsort(rows[:, 0])]
        return [np.ascontiguousarray(rows[:, 0]), np.ascontiguousarray(rows[:, 1]), np.ascontiguousarray(rows[:, 2]).view(np.uint64)]

    def split(rows: np.ndarray, big: np.ndarray) -> tuple[tuple, np.ndarray]:
        of_big = np.isin(rows[:, 0], big)
        key, id_, code = (np.ascontiguousarray(rows[of_big, k]) for k in range(3))
        return _large(key, id_, code.view(np.uint64)), rows[~of_big]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, room, last, big = [], 0, least_held, None, np.zeros(0, np.int64)
        for batch in batches:
            for lot, entries in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lot != last:
                    if n >= least_held // 16 or len(big):
                        yield from out(_met(*by_key(held), bits, most))
                        held, n = [], 0
                    last, big, room = lot, big[:0], n + least_held
                rows = np.frombuffer(entries.as_buffer(), np.int64).reshape(-1, 3)
                if len(big):
                    large, rows = split(rows, big)
                    yield from out([large])
                held.append(rows.copy())
                n += len(rows)
                if n >= room:
                    rows = np.concatenate(held)
                    keys, sizes = np.unique(rows[:, 0], return_counts=True)
                    more = keys[sizes > most]
                    if len(more):
                        big = np.concatenate((big, more))
                        large, rows = split(rows, more)
                        yield from out([large])
                    held, n = [rows], len(rows)
                    room = n + least_held
        if n:
            yield from out(_met(*by_key(held), bits, most))

    return index.select("lot", "entries").mapInArrow(run, MET)


def meetings(index: DataFrame, scratch: Scratch, bits: int = 0, most_in_task: int = 1 << 13) -> DataFrame:
    """Groups of ids that share a key and have like codes, as a table (g, id, low, before, code, n).

    ``index``: rows (key, id, code), or LOTS of them, shuffled and sorted once. Within a key, ids are linked if
    their codes differ in at most ``bits`` bits or, for keys below zero, in at most SKETCH_MOST
    cells of a sketch; every component of two or more ids is a group ``g``, with its smallest
    id ``low``, its size ``n`` and perhaps ``before``, an id of a nearer code than low's. Equal
    groups of different keys are one; sign and lowest bit of ``g`` are those of its keys. A
    key of over ``most_in_task`` ids is dealt in blocks, each pair of blocks to a task, and
    gives a group per component and pair. So whatever the key, a task holds a bounded number
    of rows, no pair of ids is written, and every two linked ids share a group.
    """
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda rows, by="key": rows.repartition(parts, by).sortWithinPartitions(by)
    lots = "lot" in index.columns
    met = scratch.cut(_meet_lots(deal(index, "lot"), bits, most_in_task) if lots else _meet(deal(index), bits, most_in_task))
    out = met.where("not big").drop("big")
    large = met.where("big").select(F.col("g").alias("key"), "id", "code")
    if not large.isEmpty():
        sizes = large.groupBy("key").agg(F.count("*").alias("n"))
        blocks = F.ceil(2 * F.col("n") / most_in_task)
        own = F.pmod(F.xxhash64("id"), blocks)
        part = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.least(own, j) * blocks + F.greatest(own, j))
        kind = F.lit(-(1 << 63)).bitwiseOR(F.lit(1))
        key = F.xxhash64("key", "part").bitwiseAND(F.lit((1 << 63) - 2)).bitwiseOR(F.col("key").bitwiseAND(kind))
        dealt = large.join(sizes.hint("merge"), "key").withColumn("part", F.explode(part)).select(key.alias("key"), "id", "code")
        out = out.union(scratch.cut(_meet(deal(dealt), bits, 1 << 40)).drop("big"))
    return out.distinct()


def _strangers(known: DataFrame, bits: int) -> DataFrame:
    """Pairs (a, b), a < b, of a stranger and another id of its group that differ in component and are like by code.

    ``known``: rows (g, id, code, c, stranger), sorted by g within partitions; a group is
    bounded (see :func:`meetings`) and compared by bits, some rows at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)]

        def out(g: np.ndarray, id_: np.ndarray, code: np.ndarray, c: np.ndarray, odd: np.ndarray) -> Iterator[pa.RecordBatch]:
            edges = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True]) if len(g) else g
            for s, e in zip(edges, edges[1:], strict=False):
                cells, most, strange = bool(g[s] < 0), SKETCH_MOST if g[s] < 0 else bits, s + np.flatnonzero(odd[s:e])
                for at in range(0, len(strange), 64):
                    some = strange[at : at + 64]
                    near = (_near(code[some][:, None], code[s:e][None, :], cells) <= most) & (c[some][:, None] != c[s:e][None, :])
                    i, j = np.nonzero(near)
                    a, b = id_[some[i]], id_[s + j]
                    once = ~odd[s + j] | (a < b)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[once]), pa.array(np.maximum(a, b)[once])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            cols[2] = cols[2].view(np.uint64)
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            stop = np.searchsorted(cols[0], cols[0][-1])  # the last group may go on in the next batch
            yield from out(*[c[:stop] for c in cols])
            held = [c[stop:] for c in cols]
        yield from out(*held)

    return known.select("g", "id", "code", "c", "stranger").mapInArrow(run, "a long, b long")


def linked(index: DataFrame, links: Callable[[DataFrame], DataFrame], scratch: Scratch, bits: int = 0) -> DataFrame:
    """Components of the graph of ids that meet in ``index`` (see :func:`meetings`) and pass a check.

    ``links`` turns rows (a, b), a <> b, into the pairs (src, dst) that pass. First every id
    is tried against the smallest id of its group, and against a nearer neighbour: at most
    twice as many pairs as rows. In groups of three or more, ids that are not in that smallest
    id's component then ("strangers") are tried against those others of the group that differ
    in component and are like them by code. Two ids of a group that differ in component can't
    both be in the smallest one's, so no link between different components is missed.
    Returns (id, component) for linked ids.
    """
    met = scratch.cut(meetings(index, scratch, bits))
    pair = lambda a, b: met.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = scratch.cut(links(pair("low", "id").union(pair("before", "id")).distinct()))
    comp = scratch.cut(components(edges, scratch))
    known = met.where("n > 2").select("g", "id", "low", "code").join(comp.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    known = known.join(comp.select(F.col("id").alias("low"), F.col("component").alias("lc")), "low", "left").withColumn("lc", F.coalesce("lc", "low"))
    known = known.select("g", "id", "code", "c", (F.col("c") != F.col("lc")).alias("stranger"))
    mixed = known.groupBy("g").agg(F.max("stranger").alias("_any")).where("_any").select("g")
    known = scratch.cut(known.join(mixed.hint("merge"), "g", "left_semi"), drop=met)
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = _strangers(known.repartition(parts, "g").sortWithinPartitions("g"), bits)
    more = links(pairs.distinct())
    both = scratch.cut(edges.union(more), drop=known)
    return components(both, scratch)
