"""The steps of ``perturb`` on texts inside Arrow batches: the same rules, at a fraction of the cost per token.

An array of tokens is interpreted element by element by the JVM; here a text is cut in one
call, and a name of a row becomes its new one once, however often the row's texts have it.
Letters and numbers outside ``lexing.SAME`` are those that the JVM told of (``foreign``).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from pairlake.functions import lexing
from pairlake.functions.draws import DRAW_BITS

try:  # without the detour by OpenSSL, which takes longer than a short text
    from _md5 import md5
except ImportError:
    md5 = hashlib.md5

DIGITS = DRAW_BITS // 4
_FOREIGN = "".join(f"\\x{{{ord(a):x}}}-\\x{{{ord(b):x}}}" for a, _, b in lexing.SAME)


def foreign(*texts: Column) -> Column:
    """struct(letters, numbers): the characters of a row's texts outside ``lexing.SAME`` that the JVM takes for such; null if all are inside."""
    whole = F.concat(*[F.coalesce(t, F.lit("")) for t in texts])
    of = lambda kind: F.array_join(F.array_distinct(F.regexp_extract_all(whole, F.lit(f"[\\p{{{kind}}}&&[^{_FOREIGN}]]"), F.lit(0))), "")
    some = lexing.odd(texts[0])
    for t in texts[1:]:
        some = some | lexing.odd(t)
    return F.when(some, F.struct(of("L").alias("letters"), of("N").alias("numbers")))


class Grammar:
    """The patterns of ``lexer`` for the letters and numbers known so far."""

    def __init__(self):
        self.letters, self.numbers = set(), set()
        self._build()

    def learn(self, letters: str, numbers: str) -> None:
        """The kind of a character is the same in all texts, so what one row tells holds for the others."""
        if not (self.letters.issuperset(letters) and self.numbers.issuperset(numbers)):
            self.letters.update(letters)
            self.numbers.update(numbers)
            self._build()

    def _build(self) -> None:
        letter = lexing.LETTER + "".join(map(re.escape, sorted(self.letters)))
        number = lexing.NUMBER + "".join(map(re.escape, sorted(self.numbers)))
        self.initials = lexing.INITIALS | self.letters
        name, string = f"[{letter}_$][{letter}{number}_$]*", r"\"[^\"\n]*\"|'[^'\n]*'"
        rest = r"[0-9]+(?:\.[0-9]+)?|===|!==|==|!=|<=|>=|<<|>>>|>>|\+\+|--|[^ \t\n\x0b\f\r]"
        self.names = re.compile(rf"({string}|{name})").split
        self.name_parts = re.compile(rf"{string}|{name}|[^\"'{letter}_$]+|[\"']").findall
        self.tokens = re.compile(rf"{string}|{name}|{rest}").findall
        self.kinds = lexing.Known(lambda token: json_text(lexing.token_class(token)))
        self.all_tokens = re.compile(rf"{string}|{name}|{rest}|[ \t\n\x0b\f\r]+").findall


class Row:
    """What the steps of one row share: its key, the text that dead lines come from, the names given, lines renamed and places drawn so far."""

    __slots__ = ("start", "donor", "grammar", "named", "lines", "drawn")

    def __init__(self, seed_no: int, keys: Sequence[str | None], donor: str | None, grammar: Grammar):
        self.start, self.donor, self.grammar = [str(seed_no), *(k for k in keys if k is not None)], donor, grammar
        self.named: dict[str, str] = {}
        self.lines: dict[str, str] = {}
        self.drawn: dict[str, list[int]] = {}

    def name_all(self, names: set[str]) -> dict[str, str]:
        """The names given so far, with those of ``names`` among them (``perturb.new_name``)."""
        new = names.difference(self.named)
        if new:
            start = "|".join([*self.start, ""]).encode()
            self.named.update([(n, "_0x" + md5(start + n.encode()).hexdigest()[:16]) for n in new])
        return self.named

    def draws(self, salt: str, n: int) -> list[int]:
        """``draws.draw`` for the places 0 to n - 1; more places of the same salt go on from there."""
        known = self.drawn.setdefault(salt, [])
        if len(known) < n:
            start = "|".join([self.start[0], salt, *self.start[1:], ""]).encode()
            known.extend([int(md5(start + b"%d" % i).hexdigest()[:DIGITS], 16) for i in range(len(known), n)])
        return known

    def draw(self, salt: str, *more: str) -> int:
        return int(md5("|".join([self.start[0], salt, *self.start[1:], *more]).encode()).hexdigest()[:DIGITS], 16)


#: A text, not null, and its row to the new text.
Rule = Callable[[str, Row], str]


def _share(drawn: int, fraction: float) -> bool:
    return drawn % 10000 < round(fraction * 10000)


def _is_string(token: str) -> bool:
    return token[0] in "\"'" and len(token) > 1


def inject(seed: str | None, base: str | None, drawn: int) -> str | None:
    """``perturb.inject``."""
    if base is None:
        return None
    lines = base.split("\n")
    at = drawn % (len(lines) + 1)
    return "\n".join([*lines[:at], *([] if seed is None else [seed]), *lines[at:]])


def rename(text: str, row: Row) -> str:
    """``perturb.rename`` without reserved names. No name or literal spans a line, and a line comes in several texts of a row."""
    lines, known = text.split("\n"), row.lines
    new = list(set(lines).difference(known))
    if new:
        parts = row.grammar.names("\n".join(new))
        found = set(parts[1::2])
        strings = {t for t in found if t[0] in "\"'"} if '"' in text or "'" in text else set()
        become = row.name_all(found - strings) if strings else row.name_all(found)
        become = become | {t: t for t in strings} if strings else become
        parts[1::2] = map(become.__getitem__, parts[1::2])
        known.update(zip(new, "".join(parts).split("\n")))
    return "\n".join(map(known.__getitem__, lines))


_colon_behind = re.compile(r"[ \t\n\x0b\f\r]*:").match


def rename_keys(text: str, row: Row) -> str:
    """``perturb.rename_text_keys``."""
    if ":" not in text:
        return text
    parts, initials = row.grammar.name_parts(text), row.grammar.initials
    for i in [i for i, t in enumerate(parts[1:]) if _colon_behind(t)]:
        t = parts[i]
        if t[0] in initials:
            parts[i] = row.name_all({t})[t]
        elif _is_string(t) and len(t) > 2:
            parts[i] = t[0] + row.name_all({t[1:-1]})[t[1:-1]] + t[0]
    return "".join(parts)


def numbers(text: str, row: Row) -> str:
    """``perturb.number_expressions``."""
    tokens = row.grammar.all_tokens(text)
    for i, t in enumerate(tokens):
        if "0" <= t[0] <= "9" and "." not in t:
            at = row.draw("number", str(i)) % (len(t) + 1)
            a, b = t[:at] + "0" * (len(t) - at), t[at:]
            tokens[i] = f"({a.lstrip('0') or '0'}+{b.lstrip('0') or '0'})"
    return "".join(tokens)


_literal_parts = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|[^\"']+|[\"']").findall


def literal_parts(text: str) -> list[str]:
    """``lexer.literal_parts``."""
    return _literal_parts(text) if '"' in text or "'" in text else [text] if text else []


_control = {c: f"\\u{c:04X}" for c in range(32)} | {ord(k): v for k, v in {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", '"': '\\"', "\\": "\\\\"}.items()}
_to_escape = re.compile(r"[\x00-\x1f\"\\]").search


def json_text(text: str) -> str:
    """``to_json`` of a string."""
    return '"' + (text.translate(_control) if _to_escape(text) else text) + '"'


def _base64(text: str) -> str:
    """``base64`` of the JVM, in lines of 76."""
    code = base64.b64encode(text.encode()).decode()
    return "\r\n".join([code[i : i + 76] for i in range(0, len(code), 76)])


_reference = re.compile(r"_s(_*)\(0x")


def with_dictionary(header: str, threshold: float, rotate: bool, shuffle: bool, free: bool, encoding: str) -> Rule:
    """``perturb.with_dictionary`` of ``perturb.string_dictionary``; ``free``: no literal is reserved, else all are."""

    def run(text: str, row: Row) -> str:
        parts = literal_parts(text)
        words = [t for t in dict.fromkeys(parts) if _is_string(t) and _share(row.draw("literal", t), threshold)] if free else []
        if shuffle:
            words = [t for _, t in sorted((row.draw("place", t), t) for t in words)]
        if rotate:
            by = row.draw("rotate") % max(len(words), 1)
            words = words[by:] + words[:by]
        places = {t: f"_s(0x{i:x})" for i, t in enumerate(words)}
        shown = list(map(_base64, words)) if encoding == "base64" else words
        body = [places[t] if t in places else _reference.sub(r"_s_\1(0x", t) if "_s" in t else t for t in parts]
        return f"{header}[{','.join(map(json_text, shown))}]\n" + "".join(body)

    return run


def behind(header: str, rule: Rule) -> Rule:
    """The rule on a text without its dictionary line, see ``perturb.parted``."""

    def run(text: str, row: Row) -> str:
        end = text.find("\n") + 1
        return text[:end] + rule(text[end:], row) if end and text.startswith(header) else rule(text, row)

    return run


# the JVM's '$', which also stands before a last line break
_lone_plus = re.compile(r"\+ *(?:\r\n|[\n\r\x85\u2028\u2029])?").fullmatch


def split_literals(n: int, free: bool) -> Rule:
    """``perturb.split_literals``; ``free``: no literal is reserved, else all are."""

    def one(t: str) -> str:
        if free and _is_string(t) and len(t) > 2:
            return "+".join([t[0] + t[i : min(i + n, len(t) - 1)] + t[0] for i in range(1, len(t) - 1, n)])
        return "+ " + t[1:] if t[0] == "+" and _lone_plus(t) else t

    return lambda text, row: "".join([one(t) for t in literal_parts(text)])


def permute(threshold: float) -> Rule:
    """``perturb.permute_lines`` without the order."""

    def run(text: str, row: Row) -> str:
        if not _share(row.draw("permute"), threshold):
            return text
        lines = text.split("\n")
        places = row.draws("line", len(lines))
        return "\n".join([lines[i] for i in sorted(range(len(lines)), key=places.__getitem__)])

    return run


def dead(threshold: float) -> Rule:
    """``perturb.dead_from`` the row's donor."""

    def run(text: str, row: Row) -> str:
        lines = text.split("\n")
        chosen, places = row.draws("dead", len(lines)), row.draws("dead_line", len(lines))
        if row.donor is None:  # a line that gets nothing behind it is none
            return "\n".join([x for x, c in zip(lines, chosen) if not _share(c, threshold)])
        pool = row.donor.split("\n")
        return "\n".join([f"{x}\n{pool[p % len(pool)]}" if _share(c, threshold) else x for x, c, p in zip(lines, chosen, places)])

    return run


_comment_parts = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|/\*[\s\S]*?\*/|://|//[^\n]*|[^\"'/:]+|[\"'/:]").findall
# runs of blanks that are not a single one already
_blanks = re.compile(r"[ \t]{2,}|\t").sub


def _collapsed(text: str) -> str:
    first, *rest = _blanks(" ", text).split("\n")
    if not rest:
        return first
    return "\n".join([first.rstrip(" "), *filter(None, [x.strip(" ") for x in rest[:-1]]), rest[-1].lstrip(" ")])


def _trimmed(text: str) -> str:
    """Without the blanks and line breaks at the ends; the JVM's '$' also stands before a last line break of any kind."""
    text = text.lstrip(" \n")
    last = 2 if text.endswith("\r\n") else 1 if text.endswith(("\r", "\x85", "\u2028", "\u2029")) else 0
    return text[: len(text) - last].rstrip(" \n") + text[len(text) - last :].rstrip("\n")


def compact(text: str, row: Row) -> str:
    """``text.compact``."""
    if "/" in text:
        text = "".join([" " if t.startswith("/*") and len(t) > 2 else "" if t.startswith("//") else t for t in _comment_parts(text)])
    return _trimmed("".join([t if _is_string(t) else _collapsed(t) for t in literal_parts(text)]))


def as_tree(text: str, row: Row) -> str:
    """``perturb.as_tree``."""
    tokens, initials, kinds = row.grammar.tokens, row.grammar.initials, row.grammar.kinds
    lines = [",".join(['"name"' if t[0] in initials else kinds[t] for t in tokens(line)]) for line in text.split("\n")]
    return "[" + ",".join([f"[{line}]" for line in lines]) + "]"
