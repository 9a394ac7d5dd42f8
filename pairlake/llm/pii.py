"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, URL
schemes, plus signs, digits, and cues of identifiers. From each anchor a
local parser expands to the left and right, and validates what it found. The
parsers look at the neighbourhood only; the result does not depend on how the
table is partitioned.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairlake.llm.common import fresh

#: Kinds of the base rules in their order, then those that the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "account")
#: Anchors. A cue has to be followed by its identifier.
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
ACCOUNT_CUES = ("account no", "account number", "acct", "kontonummer", "numéro de compte", "número de cuenta")
IBAN_CUES = ("iban",)

Span = tuple[int, int]
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_RUN = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\x20\x09-\x0D\"'<>|]+")
_IBAN = re.compile(r"[\x20:#.=]{0,3}([A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"[\x20:#.=]{0,3}([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9])")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _only_digits(part: str) -> str:
    return "".join(c for c in part if "0" <= c <= "9")


def _valid_card(part: str) -> bool:
    digits = _only_digits(part)
    return 13 <= len(digits) <= 19 and luhn(digits)


def _valid_iban(part: str) -> bool:
    plain = part.replace(" ", "").upper()
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    """Anchors with (kind of anchor, length)."""
    found = ahocorasick.Automaton()
    for kind, words in (
        ("at", "@"), ("plus", "+"), ("digit", "0123456789"), ("url", SCHEMES), ("iban", IBAN_CUES), ("account", ACCOUNT_CUES)
    ):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def _email(text: str, at: int, least: int) -> tuple[Span | None, int]:
    """Expands an at-sign: the local part to the left, not before ``least``, the domain to the right."""
    start = at
    while start > least and text[start - 1] in _LOCAL_CHARS:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return ((start, domain.end()), domain.end()) if domain else (None, least)


def _digits_rule(rule: re.Pattern, valid: Callable[[str], bool]):
    def parse(text: str, at: int, least: int) -> tuple[Span | None, int]:
        m = rule.match(text, at)
        if not m:
            return None, least
        return ((at, m.end()) if valid(m[0]) else None), m.end()

    return parse


def _valid_ip(part: str) -> bool:
    short = [n.lstrip("0") or "0" for n in part.split(".")]
    return all(len(n) <= 3 and int(n) <= 255 for n in short)


def _ip(text: str, at: int, least: int) -> tuple[Span | None, int]:
    m = _IP.match(text, at)
    if m:
        return ((at, m.end()) if _valid_ip(m[0]) else None), m.end()
    # what fails at a digit fails at all later ones of its run
    return None, _RUN.match(text, at).end()



_card = _digits_rule(_CARD, _valid_card)
_phone = _digits_rule(_PHONE, lambda part: 9 <= len(_only_digits(part)) <= 15)


def _url(text: str, start: int, after: int, least: int) -> tuple[Span | None, int]:
    rest = _URL.match(text, after)
    if not rest or start < least:
        return None, least
    end = after + len(rest[0].rstrip(".,;:!?)]}"))
    return ((start, end), end) if end > after else (None, least)


def _after_cue(rule: re.Pattern, valid: Callable[[str], bool]):
    def parse(text: str, start: int, after: int, least: int) -> tuple[Span | None, int]:
        m = rule.match(text, after)
        while m and m.start(1) >= least:
            part = m[1]
            if valid(part):
                return m.span(1), m.end(1)
            if " " not in part:  # a word too many may have been taken: give back the last one
                break
            cut = part.rindex(" ")
            m = rule.match(text, after, m.start(1) + cut)
        return None, least

    return parse


_iban = _after_cue(_IBAN, _valid_iban)
_account = _after_cue(_ACCOUNT, lambda part: 6 <= len(_only_digits(part)) <= 17)


def find(text: str, anchors: ahocorasick.Automaton) -> dict[str, list[Span]]:
    """Spans per kind, in code points, end exclusive, ascending and without overlap inside a kind.

    ``least`` is the end of a kind's last match, valid or not: matches do not
    overlap, and there is no second try inside a match that failed.
    """
    spans: dict[str, list[Span]] = {k: [] for k in BASE + ADDED}
    least = dict.fromkeys(BASE + ADDED, 0)

    def take(kind: str, result: tuple[Span | None, int]) -> None:
        span, least[kind] = result
        if span:
            spans[kind].append(span)

    # cues are written in either case; lowering may change the length of a text, then only ASCII is lowered
    lowered = text.lower()
    if len(lowered) != len(text):
        lowered = text.translate(_ASCII_LOWER)
    for last, (kind, size) in anchors.iter(lowered):
        start = last - size + 1
        if kind == "digit":
            if start >= least["ip"]:
                take("ip", _ip(text, start, least["ip"]))
            if start >= least["card"]:
                take("card", _card(text, start, least["card"]))
        elif kind == "at":
            if start >= least["email"]:
                take("email", _email(text, start, least["email"]))
        elif kind == "plus":
            if start >= least["phone"]:
                take("phone", _phone(text, start, least["phone"]))
        elif kind == "url":
            take("url", _url(text, start, last + 1, least["url"]))
        elif kind == "iban":
            take("iban", _iban(text, start, last + 1, least["iban"]))
        else:
            take("account", _account(text, start, last + 1, least["account"]))
    return spans


_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def spans_of(text: str = "text") -> Column:
    """array<struct<kind, start, end, part>>: all personal data of each whole text, by kind, then start."""

    @F.arrow_udf("array<struct<kind: string, start: long, end: long, part: string>>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        anchors = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("part", pa.string())]))
        for batch in texts:
            out = []
            for value in batch:
                whole = value.as_py() or ""
                out.append([
                    {"kind": k, "start": a, "end": b, "part": whole[a:b]} for k, s in find(whole, anchors).items() for a, b in s
                ])
            yield pa.array(out, kind)

    return run(F.col(text))


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the array ``pii`` (underscores put before if there is such a column).

    One row for each row given, repeated rows alike; null and empty texts have
    an empty array; other columns and an empty table pass through.
    """
    (name,) = fresh(docs, "pii")
    return docs.withColumn(name, spans_of(text))


def _number(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(found: DataFrame, key: str, spans: str) -> DataFrame:
    """(key, counts per base kind, base_sha256, spans): what a check needs of ``detect``."""
    show = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return found.select(
        F.col(key),
        *[_number(spans, k).alias(f"n_{k}") for k in BASE],
        F.sha2(show(base), 256).alias("base_sha256"),
        show(F.col(spans)).alias("spans"),
    )


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; overlapping spans become one."""

    @F.arrow_udf("string")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        anchors = automaton()
        for batch in texts:
            out = []
            for value in batch:
                whole = value.as_py()
                parts, upto = [], 0
                spans = sorted((a, -b, k) for k, s in find(whole or "", anchors).items() for a, b in s)
                for a, b, k in spans:
                    if a >= upto:
                        parts += [whole[upto:a], f"[{k}]"]
                    upto = max(upto, -b)
                out.append(None if whole is None else "".join(parts) + whole[upto:])
            yield pa.array(out, pa.string())

    return docs.withColumn(text, run(F.col(text)))
