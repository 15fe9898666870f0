"""Rows that share a doc_id: what is found for one is applied to that one."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tidemark.llm import line_dedup, repeats, simhash
from tidemark.llm.common import Scratch, _strangers

SCHEMA = "doc_id long, text string"


def _say(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def _kept(rows, least=100):
    """Brute force: bytes that stay of each row; of a string, the smallest (doc_id, start) is first."""
    first = {}
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - least + 1):
            w = b[i : i + least]
            first[w] = min(first.get(w, (d, i)), (d, i))
    for d, t in rows:
        b, gone = t.encode(), set()
        for i in range(len(b) - least + 1):
            if first[b[i : i + least]] != (d, i):
                gone.update(range(i, i + least))
        yield d, bytes(c for i, c in enumerate(b) if i not in gone)


def test_repeats_leave_an_unrelated_row_alone(spark):
    rng = random.Random(1)
    x, y = _say(rng, 60), _say(rng, 60)
    got = repeats.remove_repeats(spark.createDataFrame([(1, x), (2, x), (2, y)], SCHEMA)).collect()
    assert sorted((r.doc_id, bytes(r.kept)) for r in got) == sorted([(1, x.encode()), (2, b""), (2, y.encode())])


@pytest.mark.parametrize("most_in_task", [2_000, 1])
def test_repeats_of_shared_ids_match_brute_force(spark, most_in_task):
    rng = random.Random(2)
    pool = [_say(rng, 40) for _ in range(12)]
    rows = []
    for _ in range(90):
        parts = [rng.choice(pool)[rng.randrange(60) :] if rng.random() < 0.7 else _say(rng, 10) for _ in range(rng.randrange(1, 4))]
        rows.append((rng.randrange(15), rng.choice(["", pool[0]]) + " ".join(parts)))
    rows += rows[:20] + [(3, pool[1] + "a"), (3, pool[1] + "b"), (1, "x" + pool[1])]
    got = repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA), most_in_task=most_in_task).collect()
    assert sorted((r.doc_id, bytes(r.kept)) for r in got) == sorted(_kept(rows))


def test_line_dedup_removes_lines_of_their_own_row_only(spark):
    rng = random.Random(3)
    a, b, c = _say(rng, 12), _say(rng, 12), _say(rng, 12)
    rows = [(1, a), (2, f"{a}\n{b}"), (2, f"{c}\n{_say(rng, 12)}"), (2, f"{c}\nzz"), (2, f"{c}\nzz")]
    docs = spark.createDataFrame(rows, SCHEMA)
    left = sorted(r.text for r in line_dedup.dedup(docs).collect())
    # one of the two different rows that start with c keeps it; equal rows are one document
    ways = [sorted([a, b, rows[2][1], "zz", "zz"]), sorted([a, b, rows[2][1].split("\n")[1], rows[3][1], rows[3][1]])]
    assert left in ways
    sizes = line_dedup.removals(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_lines").alias("lines")).orderBy("doc_id").collect()
    assert [tuple(r) for r in sizes] == [(1, 1, 1), (2, 3, 6)]


def test_near_duplicates_keep_a_unique_text_of_a_shared_id(spark):
    rng = random.Random(4)
    x, y = _say(rng, 80), _say(rng, 80)
    rows = [(1, x), (2, x), (2, y), (3, y + " more"), (3, _say(rng, 50)), (None, x), (4, None), (4, ""), (5, " ")]
    got = [(r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(1, x), (2, y), rows[4], (None, x), (4, None), (4, "")], key=str)


def test_a_large_group_of_near_copies_is_compared_in_lots(spark):
    rng = random.Random(5)
    words = _say(rng, 100).split()
    texts = [" ".join([*words[:k], "new", *words[k:]]) for k in range(100)] + [_say(rng, 90) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    prints = simhash.signatures(docs, 2, 5).select("doc_id", "row", "h")
    h = {r.doc_id: r.h for r in prints.collect()}
    near = spark.createDataFrame([(h[0], h[k]) for k in range(1, 130)], "src long, dst long")
    want = {(h[0], h[k]) for k in range(1, 130) if (lambda a, b: len(a & b) >= 0.8 * len(a | b))(simhash.shingle_set(texts[0], 5), simhash.shingle_set(texts[k], 5))}
    for together in (4096, 7):
        got = simhash.similar(near, docs, prints, 5, 0.8, Scratch(spark, "lots"), together).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want) > 50


def test_strangers_are_all_pairs_across_components(spark):
    rng = random.Random(6)
    rows = [(rng.choice([-3, 2, 5]), i, rng.getrandbits(63) & ~(rng.getrandbits(63) | rng.getrandbits(63)), rng.randrange(6), rng.random() < 0.5) for i in range(300)]
    frame = spark.createDataFrame(rows, "g long, id long, code long, c long, stranger boolean")
    cells = lambda x: sum(x >> 2 * k & 3 != 0 for k in range(32))
    alike = lambda g, x: cells(x) <= 15 if g < 0 else x.bit_count() <= 8
    want = {(min(a[1], b[1]), max(a[1], b[1])) for a in rows for b in rows if a[0] == b[0] and a[4] and a[3] != b[3] and alike(a[0], a[2] ^ b[2])}
    got = [tuple(r) for r in _strangers(frame.repartition(3, "g").sortWithinPartitions("g"), 8).collect()]
    assert set(got) == want and len(got) == len(want) > 20


def test_the_whole_pipeline_on_awkward_rows_and_on_nothing(spark, awkward, nothing, tmp_path):
    rng = random.Random(7)
    text = ". ".join(_say(rng, 12) for _ in range(8))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    more = spark.createDataFrame([(7, text, "en", "s", 3, "x", 1, None), (8, text, "en", "s", 3, "x", 1, None), (7, ". ".join(_say(rng, 12) for _ in range(8)), None, None, None, None, None, None)], awkward.schema)
    awkward.union(more).write.parquet(f"{tmp_path}/a/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    # the copy's lines all repeat earlier ones: of the texts left without a word, one stays
    assert all(r.n_tokens > 0 for r in out if r.doc_id == 7) and len([r for r in out if r.doc_id == 7]) == 2
    assert sum(r.n_tokens == 0 for r in out) <= 1 and all(r.n_tokens == 0 for r in out if r.doc_id == 8) and all(r.round_trip for r in out)
    nothing.write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
