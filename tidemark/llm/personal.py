"""Personal data by anchor expansion.

One automaton (Aho-Corasick) finds anchors in a text: at-signs, a plus or a dot before a
digit, pairs of digits, schemes and identifier cues. Around each anchor a small parser reads
as far as its kind of datum goes and checks what it has read. A parser never reads again
what an earlier anchor of its kind has read, so the work is linear in the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh, texts, tuned

#: Certain kinds, in the order in which equal starts are told, then those that the cues add.
BASE = ("email", "ip", "card", "phone")
ADDED = ("uri", "spelled", "iban", "ssn", "account")
_KIND = {k: i for i, k in enumerate(BASE + ADDED)}
#: Words that announce an identifier (English, French, German, Spanish), by the parser they call.
CUES = {
    "iban": ("iban",),
    "ssn": ("ssn", "social security"),
    "account": ("account", "acct", "passport", "customer", "member", "compte", "passeport", "client", "konto", "kunde", "reisepass", "cuenta", "pasaporte", "cliente"),
}
SPELLED_AT = ("(at)", "[at]", "{at}", "<at>")
_DIGITS, _LOCAL = frozenset("0123456789"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = _LOCAL - frozenset("_%")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)++")
_SPACED = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_DIAL = re.compile(r"[\x20().0-9-]*+")
_AUTHORITY = re.compile(r"[^\s/?#\"'<>]++")
_TEL = re.compile(r"\+?[0-9().-]++")
_SPELLED = re.compile(r"\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[{<]dot[)\]}>]\x20?)[A-Za-z0-9-]++)++", re.A | re.I)
#: What may stand between a cue and its value.
_FILLER = re.compile(r"(?:[\x20\t]*+(?:numbers?|num(?:mer|[eé]ro)?|nr|no|id|code|is|est|ist|es|[n#][°º]|[#:=.-]))*+[\x20\t]*+", re.I)
_SSN = re.compile(r"([0-9]{3})[\x20-]?([0-9]{2})[\x20-]?([0-9]{4})(?![0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9])++")
_TOKEN = re.compile(r"[A-Za-z0-9]++(?:-[A-Za-z0-9]++)*+")

Found = tuple[int, int] | None


def luhn(digits: str) -> bool:
    """Whether a string of digits has a right check digit."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _left(text: str, at: int, allowed: frozenset, low: int) -> int:
    """Where the run of ``allowed`` characters that ends at ``at`` starts, not before ``low``."""
    while at > low and text[at - 1] in allowed:
        at -= 1
    return at


# A parser gets the text, where its anchor starts, its length, and where its kind has read
# to. It returns the spans found and how far it has read.


def _email(text: str, at: int, n: int, low: int) -> tuple[list, int]:
    start = _left(text, at, _LOCAL, low)
    domain = _DOMAIN.match(text, at + 1)
    if start == at or not domain or "." not in domain[0]:
        return [], low
    return [(start, domain.end())], domain.end()


def _ip(text: str, at: int, n: int, low: int) -> tuple[list, int]:
    start = _left(text, at, _DIGITS, low)
    chain = _DOTTED.match(text, start) if start < at else None
    if not chain:
        return [], low
    out, parts = [], chain[0].split(".")
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        end = start + sum(map(len, four)) + 3
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in four):
            out.append((start, end))
        start = end + 1
    return out, chain.end()


def _card(text: str, at: int, n: int, low: int) -> tuple[list, int]:
    run = _SPACED.match(text, at)
    digits = run[0].replace(" ", "").replace("-", "")
    return [run.span()] if 12 <= len(digits) <= 19 and luhn(digits) else [], run.end()


def _phone(text: str, at: int, n: int, low: int) -> tuple[list, int]:
    rest = _DIAL.match(text, at + 2)[0].rstrip(" ().-")
    end = at + 2 + len(rest)
    if len(rest) < 2:
        return [], end
    return [(at, end)] if 9 <= sum(c in _DIGITS for c in rest) + 1 <= 15 else [], end


def _uri(text: str, at: int, n: int, low: int) -> tuple[list, int]:
    """A network address that tells who or where: with a user before its host, or a host given by number; mailto and tel."""
    name = text[at : at + n]
    if name != "://":
        value = re.compile(r"[A-Za-z0-9._+-]++(?:@|%40)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++").match(text, at + n) if name[0] in "mM" else _TEL.match(text, at + n)
        right = value and (name[0] in "mM" or 7 <= sum(c in _DIGITS for c in value[0]) <= 15)
        return ([(at, value.end())], value.end()) if right else ([], low)
    start = _left(text, at, _SCHEME, low)
    while start < at and not text[start].isalpha():
        start += 1
    authority = _AUTHORITY.match(text, at + 3)
    if start == at or not authority:
        return [], low
    user, _, host = authority[0].rpartition("@")
    named = _DOMAIN.match(host)
    if not named or not (user or (re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", named[0]) and all(len(p) < 4 and int(p) < 256 for p in named[0].split(".")))):
        return [], low
    end = authority.end() - len(host) + named.end()
    port = re.compile(r":[0-9]{1,5}").match(text, end)
    end = port.end() if port else end
    return [(start, end)], end


def _spelled(text: str, at: int, n: int, low: int) -> tuple[list, int]:
    """An address whose at-sign is written out: name (at) host (dot) tld."""
    stop = at - 1 if at > low and text[at - 1] == " " else at
    start, domain = _left(text, stop, _LOCAL, low), _SPELLED.match(text, at + n)
    return ([(start, domain.end())], domain.end()) if start < stop and domain else ([], low)


def _value(text: str, at: int, n: int) -> int | None:
    """Where the value of a cue starts; None if the cue is part of a word."""
    if (at and text[at - 1].isalnum()) or (at + n < len(text) and text[at + n].isalpha()):
        return None
    return _FILLER.match(text, at + n).end()


def _ssn(text: str, at: int, n: int, low: int) -> tuple[list, int]:
    start = _value(text, at, n)
    m = _SSN.match(text, start) if start is not None else None
    right = m and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"
    return ([m.span()], m.end()) if right else ([], low)


def _iban(text: str, at: int, n: int, low: int) -> tuple[list, int]:
    start = _value(text, at, n)
    m = _IBAN.match(text, start) if start is not None else None
    best, value, end = None, "", start or 0
    for c in (m[0] if m else "")[:50]:  # at most 34 characters and the spaces between them
        end += 1
        if c == " ":
            continue
        value += c
        if 15 <= len(value) <= 34 and int("".join(str(int(x, 36)) for x in value[4:] + value[:4])) % 97 == 1 and not text[end : end + 1].isalnum():
            best = end
    return ([(start, best)], best) if best else ([], low)


def _account(text: str, at: int, n: int, low: int) -> tuple[list, int]:
    """A token of 6 to 34 letters and digits, 4 digits or more."""
    start = _value(text, at, n)
    m = _TOKEN.match(text, start) if start is not None else None
    size = len(m[0].replace("-", "")) if m else 0
    return ([m.span()], m.end()) if 6 <= size <= 34 and sum(c in _DIGITS for c in m[0]) >= 4 else ([], low)


PARSERS: dict[str, Callable] = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "uri": _uri, "spelled": _spelled, "iban": _iban, "ssn": _ssn, "account": _account}


@cache
def automaton() -> ahocorasick.Automaton:
    """The automaton of all anchors, made once per process: each leads to its kind and its length."""
    anchors = {"@": "email", "://": "uri"} | {f"+{d}": "phone" for d in range(10)} | {f".{d}": "ip" for d in range(10)}
    anchors |= {f"{a}{sep}{b}": "card" for a in range(10) for b in range(10) for sep in ("", " ", "-")}
    cased = lambda x: (x, x.upper(), x.capitalize())
    anchors |= {c: "uri" for x in ("mailto:", "tel:") for c in cased(x)} | {c: "spelled" for x in SPELLED_AT for c in cased(x)}
    anchors |= {c: kind for kind, words in CUES.items() for x in words for c in cased(x)}
    made = ahocorasick.Automaton()
    for word, kind in anchors.items():
        made.add_word(word, (kind, len(word), PARSERS[kind]))
    made.make_automaton()
    return made


def _by_place(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(found, key=lambda x: (x[0], _KIND[x[2]]))


def find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(certain spans, all spans) of a text as (start, end, kind) in code points, by start, then kind as listed.

    Spans of one kind don't overlap. An added span that a certain one touches goes, but for
    a uri, which may hold one.
    """
    read = dict.fromkeys(_KIND, 0)
    base, added = [], []
    for last, (kind, n, parse) in automaton().iter(text):
        at = last + 1 - n
        low = read[kind]
        if at < low:
            continue
        found, read[kind] = parse(text, at, n, low)
        if found:
            (base if kind in BASE else added).extend((s, e, kind) for s, e in found)
    base = _by_place(base)
    if added and base:
        ends, starts, top = [], [x[0] for x in base], 0
        for x in base:
            top = max(top, x[1])
            ends.append(top)
        # the certain spans that start before an added one ends must all have ended where it starts
        clear = lambda s, e: not (k := bisect_right(starts, e - 1)) or ends[k - 1] <= s
        added = [x for x in added if x[2] == "uri" or clear(x[0], x[1])]
    return base, _by_place(base + added)


def personal(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, base, spans), one per input row: the certain spans of each whole text, and all of them.

    Null and empty texts have none; null and repeated doc_ids, repeated rows and ties are
    told row by row; an empty table gives no rows; other columns are not read. One pass,
    without a shuffle.
    """
    tuned(df.sparkSession)
    span = "array<struct<s:int,e:int,kind:string>>"

    def work(c: dict) -> dict:
        rows = [find(t) for t in texts(c[text])]
        told = [[[{"s": s, "e": e, "kind": k} for s, e, k in spans] for spans in kind] for kind in zip(*rows, strict=True)] or [[], []]
        return {"doc_id": c[doc_id], "base": told[0], "spans": told[1]}

    return arrow_map(df, [doc_id, text], f"doc_id {df.schema[doc_id].dataType.simpleString()}, base {span}, spans {span}", work)


def redacted(df: DataFrame, text: str = "text", mark: str = "[{}]") -> DataFrame:
    """``df`` with every span in ``text`` replaced by its kind in ``mark``; of spans that overlap, the first and longest.

    Null and empty texts stay as they are; other columns stay, whatever their names.
    """
    tuned(df.sparkSession)

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        out, at = [], 0
        for s, e, kind in sorted(find(t)[1], key=lambda x: (x[0], -x[1])):
            if s >= at:
                out += [t[at:s], mark.format(kind)]
                at = e
        return "".join([*out, t[at:]])

    @F.arrow_udf("string")
    def cleaned(column: pa.Array) -> pa.Array:
        return pa.array([clean(t) for t in column.to_pylist()], pa.string())

    new = fresh(df.columns, "_clean")
    out = df.withColumn(new, cleaned(F.col(f"`{text}`")))
    return out.select(*[F.col(f"`{new}`").alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
