"""Secret scans with multipart credential linking.

Certain secrets are found by pattern. Weak candidates (an opaque string, an endpoint, a
short access name) are reported only where complementary parts lie in one scope: an
interval join over the parts of each document pairs them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, texts

#: Fixed patterns of the base kinds: pattern, group whose length counts, least length.
BASE = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
#: Weak parts, as whole tokens of any length (possessive, so linear): reported only when linked. An opaque string mixes letters and digits over 16 or more characters.
PARTS = (
    ("opaque", re.compile(r"(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_-]{16,}+)={0,2}+(?![A-Za-z0-9+/_=-])")),
    ("endpoint", re.compile(r"(?:https?|s3|gs|jdbc:[a-z]++|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}+")),
    ("user", re.compile(r"(?:user(?:name)?|login|client_?id|access_?key(?:_?id)?)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9_.@-]{3,}+", re.A | re.I)),
)
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
#: Role of each kind in a credential. Two different roles within a scope complement one another.
ROLE = {"access": "id", "user": "id", "assign": "secret", "hex": "secret", "opaque": "secret", "endpoint": "place"}
WEAK = {"opaque", "endpoint", "user"}
_KIND = {k: i for i, k in enumerate(["assign", "access", "hex", "opaque", "endpoint", "user"])}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed; leftmost, non-overlapping per kind."""
    found = [(*m.span(), kind) for kind, pattern, group, least in BASE for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found, key=lambda x: (x[0], _KIND[x[2]]))


def weak_parts(text: str) -> Iterator[tuple[int, int, str]]:
    """Weak candidates of a text. Each pattern runs only where a character it needs occurs."""
    if "://" in text:
        yield from ((*m.span(), "endpoint") for m in PARTS[1][1].finditer(text))
    if ("=" in text or ":" in text) and re.search("user|login|client|access", text, re.I):
        yield from ((*m.span(), "user") for m in PARTS[2][1].finditer(text))
    if _DIGIT.search(text):
        yield from ((*m.span(), "opaque") for m in PARTS[0][1].finditer(text) if _DIGIT.search(m[1]) and _LETTER.search(m[1]))


class Taken:
    """Certain spans by start, with how far those that start no later reach: a weak part asks by bisection."""

    def __init__(self, found: list[tuple[int, int, str]]):
        self.starts, self.ends, top = [s for s, _, _ in found], [], 0
        for _, e, _ in found:
            top = max(top, e)
            self.ends.append(top)

    def apart(self, part: tuple[int, int, str]) -> bool:
        """Whether a weak part isn't reported by certain spans: it overlaps none, or is an endpoint that has more than the span it holds."""
        start, end, kind = part
        k = bisect_right(self.starts, start) if kind == "endpoint" else bisect_left(self.starts, end)
        return not k or (self.ends[k - 1] < end if kind == "endpoint" else self.ends[k - 1] <= start)


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, row, base, weak): spans found in each whole text. ``row`` tells repeated rows apart."""
    kind = df.schema[doc_id].dataType.simpleString()
    span = "array<struct<s:int,e:int,kind:string>>"

    def spans(found) -> list[dict]:
        return [{"s": s, "e": e, "kind": k} for s, e, k in found]

    def work(c: dict) -> dict:
        all_texts = texts(c[text])
        base = [base_spans(t) for t in all_texts]
        weak = []
        for t, known in zip(all_texts, base, strict=True):
            taken = Taken(known)
            weak.append([x for x in weak_parts(t) if taken.apart(x)])
        return {"doc_id": c[doc_id], "row": [hashlib.md5(t.encode()).hexdigest() for t in all_texts], "base": list(map(spans, base)), "weak": list(map(spans, weak))}

    return arrow_map(df, [doc_id, text], f"doc_id {kind}, row string, base {span}, weak {span}", work)


def linked_parts(found: DataFrame, scope: int) -> DataFrame:
    """Rows (doc_id, row, parts): weak parts with a complementary part at most ``scope`` code points away.

    Parts are keyed by document and by the cells of ``scope`` that they touch, so that a
    document with many parts is spread; the join keeps pairs that are near and differ in role.
    """
    role = F.create_map(*[x for k, v in ROLE.items() for x in (F.lit(k), F.lit(v))])
    parts = found.where("size(weak) > 0 and size(base) + size(weak) > 1").select("doc_id", "row", F.explode(F.concat("base", "weak")).alias("p"))
    parts = parts.select("doc_id", "row", "p", role[F.col("p.kind")].alias("role")).distinct()
    weak = parts.where(F.col("p.kind").isin(sorted(WEAK)))
    cells = lambda c, by: F.explode(F.sequence(F.floor((F.col(f"{c}.s") - by) / scope), F.floor((F.col(f"{c}.e") + by) / scope)))
    left = weak.select("doc_id", "row", F.col("p").alias("a"), F.col("role").alias("ra")).withColumn("cell", cells("a", scope))
    right = parts.select("doc_id", "row", F.col("p").alias("b"), F.col("role").alias("rb")).withColumn("cell", cells("b", 0))
    same = "l.doc_id <=> r.doc_id and l.row = r.row and l.cell = r.cell and l.ra <> r.rb"
    hits = left.alias("l").join(right.alias("r"), F.expr(f"{same} and l.a.s < r.b.e + {scope} and r.b.s < l.a.e + {scope}"), "left_semi")
    return hits.select("doc_id", "row", "a").distinct().groupBy("doc_id", "row").agg(F.collect_list("a").alias("parts"))


def secrets(df: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = 300) -> DataFrame:
    """Rows (doc_id, base, spans): one per input row.

    ``base``: spans of the certain kinds. ``spans``: these and the weak parts that are
    linked, by start. Null and empty texts have none; repeated rows are scanned alike;
    other columns are not read. A weak part alone is never reported.
    """
    scratch = Scratch(df.sparkSession, "secrets")
    found = scratch.cut(scan(df, doc_id, text))
    more = linked_parts(found, scope).select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "parts")
    rank = F.create_map(*[x for k, v in _KIND.items() for x in (F.lit(k), F.lit(v))])
    both = found.join(more, F.expr("doc_id <=> d and row = r"), "left").withColumn("all", F.concat("base", F.coalesce("parts", F.expr("slice(weak, 1, 0)"))))
    order = F.array_sort(F.transform("all", lambda x: F.struct(x["s"].alias("s"), rank[x["kind"]].alias("k"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return both.select("doc_id", "base", F.transform(order, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))).alias("spans"))


def joined(spans: str):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
