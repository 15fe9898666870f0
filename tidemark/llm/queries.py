"""The queries of the training-data operators. Each callable takes (spark, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cotraining, decontaminate, html_extract, line_dedup, personal, phrases, quality_rules, repeats, runs, secrets, simhash, toxicity
from .common import WORD, let, table, tuned

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path(RANKS)
    done = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    ids = F.array_join(F.transform("token_ids", lambda i: i.cast("string")), ",")
    return done.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(tuned(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(table(tuned(spark), sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    held = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held(F.col("doc_id"))))
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = html_extract.extract(table(tuned(spark), sf_dir, "pages"))
    return done.withColumn("n_chars", F.length("text").cast("long"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(tuned(spark), sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(table(tuned(spark), sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents")
    scored = cotraining.fit_and_score(docs, table(spark, sf_dir, "labels"), ["doc_id"])
    return scored.select("doc_id", "quality_score", (F.col("quality_score") >= 0.5).alias("kept"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.removals(table(tuned(spark), sf_dir, "documents"), fine=line_dedup.FINE)
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    return quality_rules.score(docs, keep=["doc_id"])


def op11_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.personal(table(tuned(spark), sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in personal.BASE], F.sha2(personal.joined("base"), 256).alias("base_sha256"), personal.joined("spans").alias("spans"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(tuned(spark), sf_dir, "documents"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of documents, a tenth of which repeat a stretch of theirs to the end, as the contract of op13 says. Null ids: none."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words):
        n = F.size(words).cast("long")
        return let(F.struct(g % n, 1 + F.floor((n - g % n) / (3 + g % 8))), lambda x: F.array_join(F.transform(words, lambda w, i: F.when(i < x["col1"], w).otherwise(F.get(words, (x["col1"] + (i - x["col1"]) % x["col2"]).cast("int")))), " "))

    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(WORD), let(words, repeat)).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(planted_runs(table(tuned(spark), sf_dir, "documents")))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10 counts, without its verdict: SQL can tell this part."""
    return op10_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def personal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many certain spans op11 finds of each kind."""
    return op11_anchors(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many certain spans op7 finds of each kind."""
    return op7_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_decontamination, op3_prefix_doubling, op4_toxicity, op5_html, op6_simhash, op7_secrets, op8_cotraining, op9_line_dedup, op10_quality_rules, op11_anchors, op12_phrases, op13_runs, quality_counts, personal_counts, secret_counts)}

_OP12 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), listed AS (
  SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces
), spots AS (
  SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM listed
), grams AS (
  SELECT lang, w[i] AS x, CASE WHEN i + 1 <= len(w) THEN w[i + 1] END AS y, CASE WHEN i + 2 <= len(w) THEN w[i + 2] END AS z FROM spots
), total AS (SELECT lang, count(*) AS n FROM grams GROUP BY lang
), one AS (SELECT lang, x, count(*)::HUGEINT AS f FROM grams GROUP BY ALL
), two AS (SELECT lang, x, y, count(*)::HUGEINT AS f FROM grams WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), three AS (SELECT lang, x, y, z, count(*)::HUGEINT AS f FROM grams WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), longer AS (
  SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY ALL
), cuts AS (
  SELECT t.lang, t.x || ' ' || t.y AS phrase, t.f AS a, 1 AS k, p.f AS l, q.f AS r
  FROM two t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN one q ON q.lang = t.lang AND q.x = t.y
  LEFT JOIN longer o ON o.lang = t.lang AND o.x = t.x AND o.y = t.y
  WHERE o.f IS NULL OR 100 * o.f < 50 * t.f
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 1, p.f, q.f
  FROM three t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN two q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, p.f, q.f
  FROM three t JOIN two p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN one q ON q.lang = t.lang AND q.x = t.z
), scored AS (
  SELECT *, (1000000 * a * a) // (l * r) AS score FROM cuts
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

_QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, generate_series(0, 4) s(k) GROUP BY doc_id),
lines AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY doc_id),
c AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
"""

_PERSONAL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
ips AS (SELECT doc_id, k, max(coalesce(try_cast(p AS HUGEINT), 999)) AS top FROM
  (SELECT doc_id, k, unnest(string_split(x, '.')) AS p FROM
    (SELECT doc_id, unnest(m) AS x, unnest(generate_series(1, len(m))) AS k FROM (SELECT doc_id, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS m FROM d))) GROUP BY doc_id, k),
runs AS (SELECT doc_id, unnest(m) AS x, unnest(generate_series(1, len(m))) AS k FROM (SELECT doc_id, regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+') AS m FROM d)),
digits AS (SELECT doc_id, k, regexp_replace(x, '[^0-9]', '', 'g') AS g FROM runs),
luhn AS (SELECT doc_id, k, sum(CASE WHEN i % 2 = 0 THEN v WHEN v > 4 THEN 2 * v - 9 ELSE 2 * v END) AS total FROM
  (SELECT doc_id, k, i, CAST(g[length(g) - i] AS INTEGER) AS v FROM (SELECT doc_id, k, g, unnest(generate_series(0, length(g) - 1)) AS i FROM digits WHERE length(g) BETWEEN 12 AND 19)) GROUP BY doc_id, k),
phones AS (SELECT doc_id, length(regexp_replace(x, '[^0-9]', '', 'g')) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]')) AS x FROM d)),
a AS (SELECT doc_id, count(*) AS n FROM ips WHERE top < 256 GROUP BY doc_id), b AS (SELECT doc_id, count(*) AS n FROM luhn WHERE total % 10 = 0 GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS n FROM phones WHERE n BETWEEN 9 AND 15 GROUP BY doc_id)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email, coalesce(a.n, 0) AS n_ip, coalesce(b.n, 0) AS n_card, coalesce(c.n, 0) AS n_phone
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_SECRETS = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT doc_id, unnest(regexp_extract_all(t, '({_either_case("password|passwd|secret|token|api_?key")})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)) AS m, 'assign' AS kind, 6 AS least FROM d
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(t, 'AKIA[A-Z0-9]+')), 'access', 20 FROM d UNION ALL SELECT doc_id, unnest(regexp_extract_all(t, '[0-9a-f]+')), 'hex', 24 FROM d),
n AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS b, count(*) FILTER (WHERE kind = 'hex') AS c FROM x WHERE length(m) >= least GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex FROM d LEFT JOIN n USING (doc_id)
"""

#: DuckDB SQL where it can express a query on whole tables in reasonable time.
ORACLE_SQL: dict[str, str] = {"op12_phrases": _OP12, "quality_counts": _QUALITY, "personal_counts": _PERSONAL, "secret_counts": _SECRETS}
