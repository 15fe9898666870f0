"""Personal data, phrases and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import personal, phrases, queries, runs

SF = "/root/testdata/sf0.001"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def _base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255) or (kind == "card" and not (12 <= len(digits) <= 19 and _luhn(digits))) or (kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), k, m.end(), kind))
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


def test_certain_spans_are_those_of_the_patterns(spark):
    rng = random.Random(1)
    bits = ["@", ".", "+", "-", " ", "1", "2", "9", "0", "255", "256", "4", "4032835936481012", "1.2.3.4", "a", "B", "_", "%", "é", "١", "(", ")", "\n", "x@y.z", "+1 (487) 555-7209", "00", "::", "://", "iban ", "account: 1234567", "0.0.0.0.", "4111 1111 1111 1111", "+12", "@@", ".5"]
    for n in [3, 5, 8, 13, 40] * 1500:
        text = "".join(rng.choice(bits) for _ in range(n))
        base, spans = personal.find(text)
        assert base == _base(text), text
        assert [x for x in spans if x[2] in BASE] == base
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op11_anchors(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        base = _base(r.text or "")
        assert [got[r.doc_id][f"n_{k}"] for k in BASE] == [sum(x[2] == k for x in base) for k in BASE]
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("see ftp://bob:pw@files.example.org:21/x", "uri", "ftp://bob:pw@files.example.org:21"),
        ("go to http://10.0.0.7/admin", "uri", "http://10.0.0.7"),
        ("http://example.org/path", "uri", None),
        ("MAILTO:jo.doe@example.org now", "uri", "MAILTO:jo.doe@example.org"),
        ("tel:+44-20-7946-0958 day", "uri", "tel:+44-20-7946-0958"),
        ("write jo.doe (at) example (dot) org", "spelled", "jo.doe (at) example (dot) org"),
        ("IBAN: GB82 WEST 1234 5698 7654 32 THEN", "iban", "GB82 WEST 1234 5698 7654 32"),
        ("IBAN: GB83 WEST 1234 5698 7654 32", "iban", None),
        ("SSN is 219-09-9999.", "ssn", "219-09-9999"),
        ("ssn 000-12-3456", "ssn", None),
        ("account number: 00123456-78, thanks", "account", "00123456-78"),
        ("Konto Nr. 12345678", "account", "12345678"),
        ("accounts 12345678", "account", None),
        ("a client called Jonathan", "account", None),
    ],
)
def test_cues_and_schemes(text, kind, found):
    assert [text[s:e] for s, e, k in personal.find(text)[1] if k == kind] == ([found] if found else [])


def test_personal_of_awkward_rows_and_redaction(spark, awkward, nothing):
    assert personal.personal(awkward).count() == awkward.count()
    assert personal.personal(nothing).count() == 0
    docs = spark.createDataFrame([(1, "a x@y.zz b +1 (487) 555-7209 c", 7), (2, None, 8), (3, "", 9)], "doc_id long, text string, _clean long")
    assert [tuple(r) for r in personal.redacted(docs).orderBy("doc_id").collect()] == [(1, "a [email] b [phone] c", 7), (2, None, 8), (3, "", 9)]
    long = "1 " * 3_000 + "a@" * 2_000 + "+1" * 1_000 + "." * 1_000
    assert personal.find(long)[0] == _base(long)
    assert personal.find(long * 300)[0] == []  # linear: the patterns would take hours


def _runs(words, times=3, least=24):
    n, best = len(words), {}
    for q in range(1, n // times + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e + q - s >= max(least, times * q):
                best.setdefault((s, e + q), q)
            s = e + 1
    return sorted((s, q, e - s) for (s, e), q in best.items())


def test_runs_are_those_of_brute_force():
    rng = random.Random(2)
    lists = []
    for k in range(400):
        alphabet = [b"a", b"b", b"c", b"d"][: rng.randrange(1, 5)] if k % 2 else [b"%d" % i for i in range(50)]
        words = rng.choices(alphabet, k=rng.randrange(0, 200))
        for _ in range(rng.randrange(0, 4)):
            unit = rng.choices(alphabet, k=rng.randrange(1, 30))
            words[rng.randrange(len(words) + 1) : 0] = (unit * 9)[: rng.randrange(1, 150)]
        lists.append(words)
    lists += [[b"x"] * 700, [b"x", b"y"] * 400, [b"%d" % i for i in range(60)] * 3, []]
    # a word that hashes of powers of two don't tell apart
    t = "a"
    while len(t) < 1 << 12:
        t += t.translate(str.maketrans("ab", "ba"))
    lists.append([c.encode() for c in t])
    for words, got in zip(lists, runs.runs_of(lists), strict=True):
        assert [(s, q, n) for s, n, q in got.tolist()] == _runs(words)


def test_runs_of_a_long_text_and_after_hashes_that_agree_by_chance(monkeypatch):
    rng = random.Random(3)
    words = [b"%d" % rng.randrange(40) for _ in range(50_000)]
    words[30_000:30_000] = words[100:9_100] * 4
    words[7:7] = [b"z"] * 5_000
    got = runs.runs_of([words])[0]
    assert [7, 5_000, 1] in got.tolist() and any(q == 9_000 and n >= 36_000 for _, n, q in got.tolist())
    monkeypatch.setattr(runs, "_mixed", lambda x: x & np.uint64(1))  # nearly all hashes agree
    for _ in range(20):
        some = rng.choices([b"a", b"b", b"c"], k=60) + rng.choices([b"a", b"b"], k=7) * 6
        assert [(s, q, n) for s, n, q in runs.runs_of([some])[0].tolist()] == _runs(some)


def test_op13_is_its_contract(spark):
    got = {r.doc_id: r for r in queries.op13_runs(spark, SF).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows, held = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect(), 0
    assert len(rows) == len(got)
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if n > 3_000:
            continue
        found = [(s, m, q) for s, q, m in _runs(words)]
        held += bool(found)
        mine = got[r.doc_id]
        assert mine.n_runs == len(found) and mine.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in found))
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        assert mine.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in gone))
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert (mine.start, mine.length, mine.period, mine.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert held > 5


def test_planted_runs_of_awkward_rows(awkward, nothing):
    out = runs.periodic_runs(queries.planted_runs(awkward)).collect()
    assert len(out) == awkward.count() and all(r.collapsed is not None for r in out)
    assert runs.periodic_runs(nothing).count() == 0


def _phrases(rows, least, share, top):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    longer = [(g, n) for g, n in f.items() if len(g) == 4 and n >= least]
    for g, a in f.items():
        if len(g) < 3 or a < least or (len(g) == 3 and any(100 * n >= share * a and t[0] == g[0] and g[1:] in (t[1:3], t[2:4]) for t, n in longer)):
            continue
        cuts = [(1_000_000 * a * a // (f[g[: k + 1]] * f[(g[0], *g[k + 1 :])]), k) for k in range(1, len(g) - 1)]
        score, k = min(cuts)
        out.append((g[0], -score, -a, " ".join(g[1:]).encode(), f[g[: k + 1]], f[(g[0], *g[k + 1 :])], total[g[0]]))
    out.sort()
    ranks = Counter()
    for x in out:
        ranks[x[0]] += 1
        if ranks[x[0]] <= top:
            yield (x[0], ranks[x[0]], x[3].decode(), -x[2], x[4], x[5], x[6], -x[1])


@pytest.mark.parametrize(("block", "top"), [(1 << 21, 2000), (64, 2000), (500, 7)])
def test_phrases_are_those_of_brute_force(spark, block, top):
    rng = random.Random(4)
    words = ["a", "B", "É", "é", "x y", "\x1f", "d'e", "the", "of", "in"]
    rows = [(rng.choice(["en", "fr", None]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", ":"]) for _ in range(rng.randrange(0, 60)))) for _ in range(150)]
    rows += [("en", None), ("en", ""), (None, " . , \n")] + [("de", "new york city hall")] * 12 + [("de", "new york. new york")] * 5
    docs = spark.createDataFrame([(l, t, 1, 2) for l, t in rows], "lang string, text string, code long, word long")
    got = [tuple(r) for r in phrases.collocations(docs, top=top, block=block).orderBy("lang", "rank").collect()]
    assert got == list(_phrases(rows, 10, 50, top))


def test_phrase_sql_and_awkward_rows(spark, awkward, nothing):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(queries.ORACLE_SQL["op12_phrases"]).fetchall())
    got = sorted(tuple(r) for r in queries.op12_phrases(spark, SF).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == want and got
    assert phrases.collocations(nothing).count() == 0
    assert phrases.collocations(awkward, least=1, share=101).count() > 0


def test_scores_are_exact_beyond_64_bits(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        a = rng.randrange(1, 10 ** rng.randrange(2, 15))
        rows.append((a, rng.randrange(a, 10**15), rng.randrange(a, min(10**15, 3 * a + 2))))
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", phrases.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(x.s == 1_000_000 * x.a**2 // (x.l * x.r) for x in got)


@pytest.mark.parametrize("name", ["quality_counts", "personal_counts", "secret_counts"])
def test_counts_are_those_of_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
