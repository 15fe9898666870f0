"""Line dedup's index goes in lots, its small groups are hashed together: the same results, in less work."""

import random

import numpy as np
from pyspark.sql import functions as F
from tidemark.llm import common, line_dedup


def _lines(rng, n, size):
    return ["".join(rng.choice("abcdefghij ") for _ in range(size)).strip() for _ in range(n)]


def _groups(met):
    """Groups as sets of ids, of keys that aren't large; entries of those that are."""
    found, large = {}, set()
    for r in met.collect():
        if r.big:
            assert (r.g, r.id, r.code) not in large
            large.add((r.g, r.id, r.code))
        else:
            found.setdefault(r.g, set()).add(r.id)
    return {frozenset(x) for x in found.values()}, large


def test_an_index_moves_as_lots(spark):
    lines = _lines(random.Random(1), 3000, 60)
    rows = spark.createDataFrame(list(enumerate(lines)), "h long, line string").repartition(2)
    lots = line_dedup.band_index(rows, line_dedup.FINE)
    # a row for each lot and task, not one for each of 16 bands of each line
    assert 0 < lots.count() <= 2 * 32 * 4
    assert lots.agg(F.sum(F.length("entries"))).first()[0] == 24 * 16 * len(lines)


def test_lots_meet_as_rows_do(spark):
    rng = np.random.default_rng(2)
    hot = np.r_[np.full(3000, -7), np.full(40, -9)]
    key = np.r_[rng.integers(-400, 400, 3000), hot]
    id_ = np.r_[rng.integers(0, 500, 3000), np.arange(len(hot))]
    code = np.r_[rng.integers(0, 4, 3000), rng.integers(0, 1 << 62, len(hot))]
    rows = spark.createDataFrame([tuple(map(int, x)) for x in {*zip(key.tolist(), id_.tolist(), code.tolist(), strict=True)}], "key long, id long, code long").repartition(5).localCheckpoint()
    plain = rows.repartition(4, "key").sortWithinPartitions("key")
    work = lambda batch: [batch.column(k).to_numpy() for k in range(3)]
    lots = common.dealt(rows, work).repartition(4, "lot").sortWithinPartitions("lot")
    for most in (5, 30, 1 << 13):
        want = _groups(common._meet(plain, 1, most))
        # with little room, large keys leave their lot before it ends
        for held in (1 << 21, 64):
            assert _groups(common._meet_lots(lots, 1, most, held)) == want
    assert want[0] and not want[1]


def test_small_groups_link_as_a_bucket_does():
    rng = random.Random(4)
    for width in (line_dedup.FINE, line_dedup.SHINGLE):
        base, lines = _lines(rng, 30, 90), []
        for _ in range(400):
            s = list(rng.choice(base)[: rng.randrange(1, 90)])
            for _ in range(rng.randrange(4)):
                s[rng.randrange(len(s))] = rng.choice("xyzé😀")
            lines.append("".join(s))
        sets = line_dedup.shingle_sets(lines, width)
        assert [len(s) for s in sets] == [len({x[i : i + width] for i in range(max(1, len(x) - width + 1))}) for x in lines]
        found = 0
        for at in range(0, 400, 40):
            bucket = line_dedup.Bucket(0.8, width)
            want = [(i, j) for j, x in enumerate(lines[at : at + 40]) for i in bucket.add(j, x)]
            assert line_dedup.few_links(sets[at : at + 40], 0.8) == want
            found += len(want)
        assert found


def test_a_pair_at_exactly_the_least_links_in_a_larger_group():
    # 28 * 1.8 < 0.8 * 63 in floating point: the bound that groups of ten or more use ruled out such a pair
    run = lambda at, n: "".join(map(chr, range(at, at + n)))
    a, b = run(0x4E00, 31), run(0x4E00, 38)
    x, y = ({s[i : i + 4] for i in range(len(s) - 3)} for s in (a, b))
    assert len(x & y) == 28 and len(x | y) == 35 and 28 * (1 + 0.8) < 0.8 * 63
    lines = [a, *(run(0x5000 + 50 * k, 34) for k in range(12)), b]
    bucket = line_dedup.Bucket(0.8, 4)
    assert [(i, j) for j, s in enumerate(lines) for i in bucket.add(j, s)] == [(0, 13)]
    assert line_dedup.few_links(line_dedup.shingle_sets(lines, 4), 0.8) == [(0, 13)]


def test_verified_takes_small_large_and_long_groups(spark):
    rng = random.Random(6)
    sizes, rows = [(2, 60), (3, 200), (150, 50), (2, 70_000), (1, 30), (40, 120), (3, 300_000)], []
    for g, (n, size) in enumerate(sizes):
        base = _lines(rng, 1, size)[0]
        for k in range(n):
            at = rng.randrange(len(base))
            rows.append((2 * g, 1000 * g + k, base[:at] + "#" + base[at:]))
    df = spark.createDataFrame(rows, "g long, id long, line string").repartition(1).sortWithinPartitions("g", "id")
    got = [(r.src // 1000, r.dst // 1000) for r in line_dedup.verified(df, 0.3).collect()]
    # a link joins two components, so that n - 1 of them make n lines one
    assert sorted(got) == [(g, g) for g, (n, _) in enumerate(sizes) for _ in range(n - 1)]
