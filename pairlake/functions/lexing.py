"""Whole texts lexed inside Arrow batches: the rules of ``lexer``, at a fraction of the cost per token.

A regular expression of the JVM gives an array of strings, and each rule on its elements is
interpreted; here a text is cut in one call and what a token becomes is remembered. Only texts
of ``SAME`` characters are cut here, those whose letters and numbers are certainly the
JVM's; all others come with the tokens that ``lexer`` makes of them.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from pairlake.functions import lexer

# Characters whose categories have not changed since Unicode 5.
SAME = ("\x00-ɏ", "Ѐ-ӿ", "‐-‧", "‰-⁞", "₠-₵", "　-〩", "ぁ-ゖ",
        "ァ-ヾ", "一-龥", "가-힣", "！-｠")
#: Tokens that a task remembers, and the length up to which it does.
REMEMBERED, SHORT = 200_000, 64
# Fixed value: the characters that ``js_escape`` leaves alone.
PLAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@*_+-./")
LABELS = {m: label for label, members in lexer.OPERATOR_GROUPS.items() for m in members}


def _category(kind: str) -> str:
    """The characters of ``SAME`` in a category, as ranges of a character class."""
    found: list[list[int]] = []
    for first, _, last in SAME:
        for code in range(ord(first), ord(last) + 1):
            if unicodedata.category(chr(code))[0] == kind:
                if found and found[-1][1] == code - 1:
                    found[-1][1] = code
                else:
                    found.append([code, code])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in found)


LETTER, NUMBER = _category("L"), _category("N")
# ``lexer.GRAMMAR``; the alternatives begin with different characters or none holds more than the one before it, so frequent ones may come first
cut = re.compile(
    rf"""[ \t\n\x0b\f\r]*([{LETTER}_$][{LETTER}{NUMBER}_$]*|[0-9]+(?:\.[0-9]+)?|\"[^\"\n]*\"|'[^'\n]*'"""
    r"""|[=!]==?|[<>]=|<<|>>>?|\+\+|--|[^ \t\n\x0b\f\r])"""
).findall
#: The characters that a name begins with.
INITIALS = frozenset(re.findall(f"[{LETTER}_$]", "".join(chr(c) for a, _, b in SAME for c in range(ord(a), ord(b) + 1))))


def odd(text: Column) -> Column:
    """Whether a text has characters that only the JVM may judge."""
    ranges = [f"\\x{{{ord(a):x}}}-\\x{{{ord(b):x}}}" for a, _, b in SAME[1:]]
    # one comparison decides on a character of the first range; a union of all of them costs some twenty times as much
    return text.rlike(f"[\\x{{{ord(SAME[0][2]) + 1:x}}}-\\x{{10ffff}}&&[^{''.join(ranges)}]]")


def escaped(text: str) -> str:
    """``lexer.js_escape``."""
    units = text.encode("utf-16-be")
    codes = [units[i] << 8 | units[i + 1] for i in range(0, len(units), 2)]
    return "".join(chr(c) if chr(c) in PLAIN else f"%{c:02X}" if c < 256 else f"%u{c:04X}" for c in codes)


class Known(dict):
    """What a token becomes, remembered up to a bound. Names are too many to be remembered, and their rules are simple."""

    def __init__(self, rule):
        super().__init__()
        self.rule = rule

    def __missing__(self, token: str):
        found = self.rule(token)
        if len(token) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = found
        return found


def _is_number(token: str) -> bool:
    return "0" <= token[0] <= "9"


def _is_string(token: str) -> bool:
    return token[0] in "\"'" and len(token) > 1


def token_class(token: str) -> str:
    """``lexer.token_class``."""
    if token[0] in INITIALS:
        return "name"
    return "num" if _is_number(token) else "string" if _is_string(token) else LABELS.get(token, token)


def token_value(token: str) -> str:
    """``lexer.token_value``."""
    if token[0] in INITIALS or token in LABELS:
        return token
    return "num" if _is_number(token) else escaped(token[1:-1]) if _is_string(token) else token


def class_letter(token: str) -> str:
    """``lexer.class_letter``."""
    label = token_class(token)
    return lexer.CLASS_LETTERS.get(label, label if "\x21" <= label[0] <= "\x7e" else "u")


def no_size() -> Column:
    """The size of no array, which sessions differ on."""
    return F.size(F.lit(None).cast("array<string>"))


def token_text(text: Column, mode: str = "class") -> Column:
    """struct(tokens, n): the blank-joined ``lexer.tokens`` of a text and their number; two nulls for null."""
    if mode not in ("class", "value"):
        raise ValueError(f"unknown mode {mode!r}")
    known = Known(token_class if mode == "class" else token_value)
    if mode == "class":
        become = lambda found: ["name" if t[0] in INITIALS else known[t] for t in found]
    else:
        become = lambda found: [t if t[0] in INITIALS else known[t] for t in found]

    @F.pandas_udf("tokens string, n int")
    def run(texts: pd.Series, given: pd.Series) -> pd.DataFrame:
        rows = []
        for whole, ready in zip(texts, given):
            if whole is None:
                rows.append((None, None))
                continue
            made = become(cut(whole)) if ready is None else ready
            rows.append((" ".join(made), len(made)))
        out = pd.DataFrame(rows, columns=["tokens", "n"], dtype=object)
        return out.assign(n=out["n"].astype("Int32"))

    return run(text, F.when(odd(text), lexer.tokens(text, mode)))


# ---- lexed texts: the lines kept, their tokens joined by blanks, each behind its class letter ----

_blank, _coded = re.compile(r"[\s%]"), re.compile("%([0-9a-f]+);")


def _packed(token: str) -> str:
    """A token without blanks, the reverse of ``_unpacked``."""
    return _blank.sub(lambda m: f"%{ord(m[0]):x};", token)


def _unpacked(token: str) -> str:
    return _coded.sub(lambda m: chr(int(m[1], 16)), token) if "%" in token else token


def lexed_lines(text: Column) -> Column:
    """A text in lexed form. No token spans a line, so texts mixed by lines can be lexed once per document and mixed in this form."""
    known = Known(lambda token: class_letter(token) + _packed(token))

    @F.pandas_udf("string")
    def run(texts: pd.Series, raw: pd.Series, classes: pd.Series) -> pd.Series:
        out = []
        for whole, tokens, lines in zip(texts, raw, classes):
            if whole is None:
                out.append(None)
            elif tokens is None:
                lines = [cut(line) for line in whole.split("\n")]
                out.append("\n".join([" ".join(["n" + t if t[0] in INITIALS else known[t] for t in line]) for line in lines]))
            else:
                rest = iter(tokens)
                out.append("\n".join([" ".join([c + _packed(next(rest)) for c in line]) for line in lines.split("\n")]))
        return pd.Series(out, dtype=object)

    is_odd = odd(text)
    return run(text, F.when(is_odd, lexer.raw_tokens(text)), F.when(is_odd, lexer.class_lines(text)))


def _value(token: str) -> str:
    """``lexer.token_value`` of a token in lexed form."""
    kind, token = token[0], _unpacked(token[1:])
    return "num" if kind == "d" else escaped(token[1:-1]) if kind == "s" else token


def token_counts(lexed: Column, ids: dict[str, int]) -> Column:
    """array<struct<id, n>>: how often each value of ``ids`` occurs among the tokens (mode 'value') of a lexed text, by id; null for null."""
    names, known = {"n" + value: i for value, i in ids.items()}, Known(lambda token: ids.get(_value(token), -1))

    @F.pandas_udf("array<struct<id: int, n: int>>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for whole in texts:
            if whole is None:
                out.append(None)
                continue
            codes = [names.get(t, -1) if t[0] == "n" else known[t] for t in whole.split()]
            found, counts = np.unique(np.array(codes, np.int64), return_counts=True)
            out.append([{"id": i, "n": n} for i, n in zip(found.tolist(), counts.tolist()) if i >= 0])
        return pd.Series(out, dtype=object)

    return run(lexed)


def compared(seed: Column, target: Column, letters: str) -> Column:
    """struct(a, b, ca, cb, own, shared, either) of two lexed texts: their class strings, how often each of ``letters`` occurs
    in them, the number of distinct tokens of the first, of both, and of either; null where a text is missing."""
    codes = np.frombuffer(letters.encode(), np.uint8)

    def one(whole):
        if whole is None:
            return None, None, None
        found = whole.split()
        text = "".join([token[0] for token in found])
        counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=128)[codes]
        return text, counts.astype(float), set(found)

    @F.pandas_udf("a string, b string, ca array<double>, cb array<double>, own int, shared int, either int")
    def run(first: pd.Series, second: pd.Series) -> pd.DataFrame:
        rows = []
        for s, t in zip(first, second):
            (a, ca, p), (b, cb, q) = one(s), one(t)
            shared = None if p is None or q is None else len(p & q)
            rows.append((a, b, ca, cb, None if p is None else len(p), shared, None if shared is None else len(p) + len(q) - shared))
        out = pd.DataFrame(rows, columns=["a", "b", "ca", "cb", "own", "shared", "either"], dtype=object)
        return out.assign(**{c: out[c].astype("Int32") for c in ("own", "shared", "either")})

    return run(seed, target)
