"""Tokens of a text as array columns; one regular expression, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: the token grammar, alternatives in order of preference.
GRAMMAR = (
    r"""\"[^\"\n]*\"|'[^'\n]*'|[\p{L}_$][\p{L}\p{N}_$]*|[0-9]+(?:\.[0-9]+)?"""
    r"""|===|!==|==|!=|<=|>=|<<|>>>|>>|\+\+|--|[^\s]"""
)
# The same with runs of blanks as tokens, so that joining them gives the text back.
GRAMMAR_WITH_BLANKS = GRAMMAR + r"|\s+"

# String literals and the runs between them. No other token holds a quote, so the literals
# are the same as those of the full grammar, at a fraction of the pieces.
LITERAL_PARTS = r"""\"[^\"\n]*\"|'[^'\n]*'|[^\"']+|[\"']"""

# String literals, names, and the runs between them. A name begins at the first letter that no
# literal or name holds, so both are those of the full grammar, at half of the pieces.
NAME_PARTS = r"""\"[^\"\n]*\"|'[^'\n]*'|[\p{L}_$][\p{L}\p{N}_$]*|[^\"'\p{L}_$]+|[\"']"""

# Operator groups, whose label is also the name of the class.
OPERATOR_GROUPS = {
    "+/-": ("+", "-"),
    "</>/<=/>=": ("<", ">", "<=", ">="),
    "!/~": ("!", "~"),
    "==/!=/===/!==": ("==", "!=", "===", "!=="),
    "++/--": ("++", "--"),
    "<</>>/>>>": ("<<", ">>", ">>>"),
}
# One letter per class; single punctuation marks stand for themselves.
CLASS_LETTERS = {
    "name": "n",
    "num": "d",
    "string": "s",
    "+/-": "a",
    "</>/<=/>=": "c",
    "!/~": "b",
    "==/!=/===/!==": "e",
    "++/--": "i",
    "<</>>/>>>": "h",
}


def raw_tokens(text: Column, blanks: bool = False) -> Column:
    pattern = GRAMMAR_WITH_BLANKS if blanks else GRAMMAR
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def literal_parts(text: Column) -> Column:
    """The text cut in string literals and whatever lies between them."""
    return F.regexp_extract_all(text, F.lit(LITERAL_PARTS), F.lit(0))


def name_parts(text: Column) -> Column:
    """The text cut in string literals, names and whatever lies between them."""
    return F.regexp_extract_all(text, F.lit(NAME_PARTS), F.lit(0))


def is_name(token: Column) -> Column:
    return token.rlike(r"^[\p{L}_$]")


def is_string(token: Column) -> Column:
    return F.substring(token, 1, 1).isin('"', "'") & (F.length(token) > 1)


def is_integer(token: Column) -> Column:
    return token.rlike(r"^[0-9]+$")


def token_class(token: Column) -> Column:
    """name, num, string, an operator group, or the character itself."""
    out = F.when(is_name(token), "name").when(token.rlike("^[0-9]"), "num").when(is_string(token), "string")
    for label, members in OPERATOR_GROUPS.items():
        out = out.when(token.isin(*members), label)
    return out.otherwise(token)


def token_value(token: Column) -> Column:
    """Names and operators keep their text, strings are escaped, the rest is its class."""
    members = [m for group in OPERATOR_GROUPS.values() for m in group]
    return (
        F.when(is_name(token) | token.isin(*members), token)
        .when(token.rlike("^[0-9]"), "num")
        .when(is_string(token), js_escape(F.substr(token, F.lit(2), F.length(token) - 2)))
        .otherwise(token)
    )


def class_letter(token: Column) -> Column:
    """The class as one ASCII character ('u' for marks outside ASCII)."""
    out = F.when(is_name(token), CLASS_LETTERS["name"]).when(token.rlike("^[0-9]"), CLASS_LETTERS["num"])
    out = out.when(is_string(token), CLASS_LETTERS["string"])
    for label, members in OPERATOR_GROUPS.items():
        out = out.when(token.isin(*members), CLASS_LETTERS[label])
    return out.when(token.rlike(r"^[\x21-\x7E]"), token).otherwise("u")


def js_escape(text: Column) -> Column:
    """A blank-free form: A-Z a-z 0-9 @*_+-./ stay, else %XX, above 0xFF %uXXXX per UTF-16 unit."""

    def one(c: Column) -> Column:
        code = F.hex(F.encode(c, "UTF-16BE"))
        return (
            F.when(c.rlike(r"^[A-Za-z0-9@*_+\-./]"), c)
            .when(code.startswith("00"), F.concat(F.lit("%"), F.substring(code, 3, 2)))
            .otherwise(F.regexp_replace(code, "(.{4})", r"%u$1"))
        )

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), one), "")


def tokens(text: Column, mode: str = "class") -> Column:
    """Array of class labels (mode 'class') or of kept values (mode 'value')."""
    if mode not in ("class", "value"):
        raise ValueError(f"unknown mode {mode!r}")
    return F.transform(raw_tokens(text), token_class if mode == "class" else token_value)


def class_string(text: Column) -> Column:
    """One letter per token: a compact form for class-level distances."""
    return F.array_join(F.transform(raw_tokens(text), class_letter), "")


def class_lines(text: Column) -> Column:
    """``class_string`` with the line breaks kept. No token spans a line, so texts mixed by
    lines can be lexed once per document and mixed in this form."""
    return F.array_join(F.transform(F.split(text, "\n"), class_string), "\n")


def join_tokens(toks: Column) -> Column:
    return F.array_join(toks, " ")


def lex(df: DataFrame, keys: list[str], text: str = "text", mode: str = "class") -> DataFrame:
    """Token table (keys.., pos, class, value), one narrow stage."""
    raw = df.select(*keys, F.posexplode(raw_tokens(F.col(text))).alias("pos", "_raw"))
    value = F.col("_raw") if mode == "class" else token_value(F.col("_raw"))
    return raw.select(*keys, "pos", token_class(F.col("_raw")).alias("class"), value.alias("value"))
