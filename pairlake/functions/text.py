"""Text, name and JSON column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairlake.functions.lexer import LITERAL_PARTS

LINE_BREAKS = "\r\n|\r|\n| | "


def sanitise_key(text: Column) -> Column:
    """File-name form of a text: trimmed, blanks to '_', only letters, digits, '_', '-', '.' stay."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.regexp_replace(F.replace(trimmed, F.lit(" "), F.lit("_")), r"[^-\p{L}\p{N}_.]", "")


def flatten_key(text: Column) -> Column:
    """Every '-', '.' and non-word character becomes '_'."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_]", "_")


def target_name(seed: Column, base: Column, label: Column) -> Column:
    """``seed.base.label.js``"""
    return F.concat_ws(".", seed.cast("string"), base.cast("string"), label.cast("string"), F.lit("js"))


def parse_target(name: Column) -> Column:
    """The three parts of a target name, as a struct of strings."""
    part = lambda i: F.split_part(name, F.lit("."), F.lit(i))
    return F.struct(part(1).alias("seed"), part(2).alias("base"), part(3).alias("label"))


def line_count(text: Column) -> Column:
    return F.size(F.split(text, LINE_BREAKS, -1))


def truncate(text: Column, n: int = 1024) -> Column:
    return F.substring(text, 1, n)


def length_bin(length: Column, width: int) -> Column:
    """ceil(length / width)."""
    return F.ceil(length / F.lit(width)).cast("bigint")


# String literals, both kinds of comments, the marks of an address, and what lies between.
COMMENT_PARTS = r"""\"[^\"\n]*\"|'[^'\n]*'|/\*[\s\S]*?\*/|://|//[^\n]*|[^\"'/:]+|[\"'/:]"""


def compact(text: Column) -> Column:
    """Without comments and with runs of blanks collapsed, but for those in string literals."""
    parts = lambda t, pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    joined = lambda t, pattern, one: F.array_join(F.transform(parts(t, pattern), one), "")
    out = joined(text, COMMENT_PARTS, lambda t: F.when(t.startswith("/*") & (F.length(t) > 2), " ").when(t.startswith("//"), "").otherwise(t))
    blanks = lambda t: F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" *\n[ \n]*", "\n")
    literal = lambda t: F.substring(t, 1, 1).isin('"', "'") & (F.length(t) > 1)
    out = joined(out, LITERAL_PARTS, lambda t: F.when(literal(t), t).otherwise(blanks(t)))
    return F.regexp_replace(out, r"^[ \n]+|[ \n]+$", "")


def canonical_lines(text: Column) -> Column:
    """One statement per line: lines trimmed, empty lines removed."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def to_record_json(df: DataFrame, big: tuple[str, ...] = (), name: str = "record") -> DataFrame:
    """One JSON text per row; columns in ``big`` (beyond 2**53) are written as strings."""
    cols = [F.col(c).cast("string").alias(c) if c in big else F.col(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*cols)).alias(name))


def from_record_json(df: DataFrame, schema, name: str = "record") -> DataFrame:
    return df.select(F.from_json(name, schema).alias("r")).select("r.*")
