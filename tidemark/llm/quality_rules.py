"""Quality rules by weak supervision: rules vote or abstain, EM estimates their accuracies, a posterior decides.

DataFrame functions only. Every feature is computed once, inside the row of its document,
so a pass over the corpus has no shuffle except the count of vote patterns, of which there
are at most 3 to the number of rules.

Documents are a mixture of classes, two of them good (plain texts and texts with refrains)
and one per kind of junk. A class has its own chances that a rule votes bad, votes good or
abstains, so a rule may be right about one kind and mistaken about refrains, and kinds of
junk that exclude one another don't hide one another. The posterior of the good classes
decides: one bad vote doesn't reject a text that is otherwise like the good ones, and weak
votes that no strict rule joins may.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh, let


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains. ``kind``: the junk it is written for; ``weak``: known to misjudge refrains."""

    name: str
    kind: str
    bad: str
    good: str
    weak: bool = False


#: Rules over the features of :func:`features`. A vote is judged by EM, not trusted.
RULES = (
    Rule("length", "fragment", "n_words < 10", "n_words >= 40"),
    Rule("repeats", "repetition", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words and n_words >= 10"),
    Rule("some_repeats", "repetition", "100 * n_repeat_words > 8 * n_words", "100 * n_repeat_words <= 2 * n_words and n_words >= 10", True),
    Rule("lines", "repetition", "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 and n_words >= 10"),
    Rule("symbols", "symbols", "5 * n_symbols > n_words", "50 * n_symbols <= n_words and n_words >= 10"),
    Rule("some_symbols", "symbols", "12 * n_symbols > n_words", "n_symbols = 0 and n_words >= 10", True),
    Rule("word_length", "form", "word_chars < 2 * n_words or word_chars > 14 * n_words", "word_chars >= 3 * n_words and word_chars <= 9 * n_words"),
    Rule("stops", "form", "5 * n_ends < n_lines and n_words >= 10", "2 * n_ends >= n_lines and n_words >= 10"),
)
GOOD = ("plain", "refrain")


@dataclass
class Model:
    """Per class, good ones first: its share, and for each rule the chances that it votes bad, votes good or abstains."""

    classes: list[str]
    share: list[float]
    votes: list[list[float]]


def first_model(rules: tuple[Rule, ...] = RULES) -> Model:
    """What is believed beforehand: most texts are good, a rule catches its own kind of junk and seldom errs otherwise."""
    classes = [*GOOD, *dict.fromkeys(r.kind for r in rules)]
    votes = []
    for c in classes:
        row: list[float] = []
        for r in rules:
            if c == "plain":
                bad, good = 0.01, 0.95
            elif c == "refrain":
                bad, good = ((0.3, 0.3) if r.weak else (0.01, 0.5)) if r.kind == "repetition" else (0.01, 0.9)
            else:
                bad, good = (0.7, 0.1) if c == r.kind else (0.03, 0.6)
            row += [bad, good, 1 - bad - good]
        votes.append(row)
    return Model(classes, [0.7, 0.1] + [0.2 / (len(classes) - 2)] * (len(classes) - 2), votes)


def _repeat_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the text, the first occurrence included."""
    n = F.size(words)

    def hashed(w: Column) -> Column:
        at = lambda i, k: F.get(w, i + k)
        return F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2), at(i, 3), at(i, 4)))

    def covered(p: Column) -> Column:
        last = F.size(p) - 1
        gaps = F.transform(p, lambda x, i: F.when(i < last, F.least(F.lit(5), F.get(p, i + 1) - x)).otherwise(5))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def positions(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda x, i, k: F.get(s, i + k)["h"] == x["h"]
        kept = F.filter(s, lambda x, i: ((i > 0) & same(x, F.greatest(i, F.lit(1)), -1)) | ((i < last) & same(x, F.least(i, last - 1), 1)))
        return F.sort_array(F.transform(kept, lambda x: x["p"]))

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, lambda s: let(positions(s), covered)))

    return F.when(n < 6, F.lit(0).cast("long")).otherwise(let(hashed(words), counted))


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ends")


def features(df: DataFrame, text: str = "text", out: str = "_q") -> DataFrame:
    """Add the struct ``out`` of exact counts over the whole text (null counts as empty). All other columns stay."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def of(w: Column, lines: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.coalesce(F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.filter(lines, lambda x: F.rtrim(x).rlike(r"[.!?:;\"'’”。)]$"))).cast("long").alias("n_ends"),
        )

    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return df.withColumn(out, let(words, lambda w: let(lines, lambda ls: of(w, ls))))


def _votes(q: str, rules: tuple[Rule, ...]) -> Column:
    """The votes of all rules as an array: 3 * rule + 0 for bad, 1 for good, 2 for none."""

    def sql(condition: str) -> Column:
        for name in sorted(FEATURES, key=len, reverse=True):
            condition = condition.replace(name, f"@{FEATURES.index(name)}@")
        for i, name in enumerate(FEATURES):
            condition = condition.replace(f"@{i}@", f"`{q}`.`{name}`")
        return F.expr(condition)

    return F.array(*[F.when(sql(r.bad), 3 * i).when(sql(r.good), 3 * i + 1).otherwise(3 * i + 2) for i, r in enumerate(rules)])


def _shares(logs: Column) -> Column:
    """exp of each, scaled to sum to one."""
    whole = lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))
    return let(F.array_max(logs), lambda m: let(F.transform(logs, lambda x: F.exp(x - m)), whole))


def _posterior(votes: Column, share: Column, chances: Column) -> Column:
    """The chance of each class given the votes."""
    return _shares(F.transform(share, lambda s, k: F.log(s) + F.aggregate(votes, F.lit(0.0), lambda a, j: a + F.log(F.get(F.get(chances, k), j)))))


def measured(df: DataFrame, scratch: Scratch, text: str, keep: list[str], rules: tuple[Rule, ...]) -> tuple[DataFrame, str, str]:
    """A table of the columns ``keep`` with the features and votes of each row, and the names of these two."""
    q, v = fresh(df.columns, "_q"), fresh(df.columns, "_votes")
    made = features(df, text, q).select(*[F.col(f"`{c}`") for c in keep], q)
    return scratch.cut(made.withColumn(v, _votes(q, rules))), q, v


def fit(made: DataFrame, votes: str, rules: tuple[Rule, ...] = RULES, rounds: int = 30, belief: float = 0.05) -> Model:
    """EM over the counts of vote patterns of all rows of ``made``, which has the array ``votes``.

    The patterns (at most 3 to the power of the number of rules, whatever the corpus) fit in
    one row, over which one expression folds the rounds. ``belief``: the model held
    beforehand weighs as much as that share of the corpus (and four documents more), so the
    estimates are alike at every size. An empty corpus gives the first model.
    """
    first = first_model(rules)
    cells, n_rules = range(3 * len(rules)), len(rules)
    patterns = made.groupBy(F.col(f"`{votes}`").alias("c")).agg(F.count("*").cast("double").alias("n"))
    row = patterns.agg(F.collect_list(F.struct("c", "n")).alias("p"), F.sum("n").alias("total"))
    weight = F.col("total") * belief + 4
    numbers = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    start = F.struct(numbers(first.share).alias("share"), F.array(*[numbers(r) for r in first.votes]).alias("votes"))
    before = F.array(*[numbers(s * x for x in r) for s, r in zip(first.share, first.votes, strict=True)])

    def step(m: Column, _: Column) -> Column:
        seen = F.transform("p", lambda p: F.struct(p["c"].alias("c"), p["n"].alias("n"), _posterior(p["c"], m["share"], m["votes"]).alias("r")))

        def again(w: Column) -> Column:
            mass = lambda k: F.aggregate(w, F.lit(0.0), lambda a, x: a + x["n"] * F.get(x["r"], k))
            cell = lambda k, j: F.aggregate(w, F.lit(0.0), lambda a, x: a + F.when(F.get(x["c"], F.lit(j // 3)) == j, x["n"] * F.get(x["r"], k)).otherwise(0.0))
            share = F.transform(numbers(first.share), lambda s, k: (mass(k) + weight * s) / (F.col("total") + weight))
            counts = F.transform(before, lambda b, k: F.array(*[cell(k, j) + weight * F.get(b, F.lit(j)) for j in cells]))
            scaled = lambda c: F.array(*[F.get(c, F.lit(j)) / sum((F.get(c, F.lit(3 * (j // 3) + v)) for v in range(3)), F.lit(0.0)) for j in cells])
            return F.struct(share.alias("share"), F.transform(counts, scaled).alias("votes"))

        return let(seen, again)

    found = row.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("m")).where("total > 0").first() if n_rules else None
    return Model(first.classes, list(found["m"]["share"]), [list(r) for r in found["m"]["votes"]]) if found else first


def judged(made: DataFrame, q: str, v: str, model: Model, threshold: float, prefix: str) -> DataFrame:
    """Add counts, ``base_failed``, ``quality`` and ``kept`` to a table of :func:`measured`."""
    f = lambda n: F.col(f"`{q}`.`{n}`")
    failed = (f("n_words") < 10) | (100 * f("n_repeat_words") > 20 * f("n_words"))
    # log-odds of each class against the first, over literals
    logs = [F.lit(math.log(s)) for s in model.share]
    for i in range(len(model.votes[0]) // 3):
        cell = F.get(F.col(f"`{v}`"), F.lit(i)) - 3 * i
        logs = [x + F.when(cell == 0, math.log(r[3 * i])).when(cell == 1, math.log(r[3 * i + 1])).otherwise(math.log(r[3 * i + 2])) for x, r in zip(logs, model.votes, strict=True)]
    good = F.aggregate(F.slice(_shares(F.array(*logs)), 1, len(GOOD)), F.lit(0.0), lambda a, x: a + x)
    made = made.withColumns({f"{prefix}{n}": f(n) for n in FEATURES[:5]} | {f"{prefix}base_failed": failed, f"{prefix}quality": good})
    return made.withColumn(f"{prefix}kept", ~F.col(f"`{prefix}base_failed`") & (F.col(f"`{prefix}quality`") >= threshold)).drop(q, v)


def score(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, model: Model | None = None, prefix: str = "", keep: list[str] | None = None) -> DataFrame:
    """Add word counts, ``base_failed``, ``quality`` (posterior of good) and ``kept`` to every row.

    Null texts count as empty: no words, so ``base_failed`` and not kept. Repeated rows are
    scored alike. Columns of the input that clash with the added ones are replaced; give a
    ``prefix`` to keep both. ``keep``: the columns of ``df`` to return, all by default. An
    empty table stays empty.
    """
    made, q, v = measured(df, Scratch(df.sparkSession, "rules"), text, df.columns if keep is None else keep, rules)
    return judged(made, q, v, model or fit(made, v, rules), threshold, prefix)


def keep(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose documents the rules keep, with the columns of ``df``."""
    prefix = "_rules_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return score(df, text, prefix=prefix).where(f"`{prefix}kept`").select(*[F.col(f"`{n}`") for n in df.columns])
