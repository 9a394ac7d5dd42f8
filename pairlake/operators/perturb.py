"""Corpus transformations: mixing two texts, renaming, literals, line order, dead lines.

A text is a list of lines (its statements). Almost every step is an expression
on one row, so a corpus is transformed in the scan stage, without a shuffle.
The steps marked reversible have their inverse in ``restore``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pairlake.functions import rewriting
from pairlake.functions.bind import let
from pairlake.functions.draws import draw, share, step_past
from pairlake.functions.lexer import is_integer, is_name, is_string, literal_parts, name_parts, raw_tokens, tokens
from pairlake.functions.text import compact
from pairlake.operators.extend import STEPS
from pairlake.operators.grid import DEFAULT_FLAGS, EXPERIMENT_FLAGS, EXPERIMENTS, MIXES, profile_rows
from pairlake.operators.ranks import shuffled_rank
from pairlake.session import by_key

# The wrapper that an appended text is put in.
WRAP_OPEN = "\n(function () {\n"
WRAP_CLOSE = "\n})();\n"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def inject(seed: Column, base: Column, drawn: Column) -> Column:
    """The seed whole, before, between or after the lines of the base."""
    def put(lines: Column) -> Column:
        at = F.pmod(drawn, F.size(lines) + 1).cast("int")
        tail = F.slice(lines, at + 1, F.size(lines))
        return F.array_join(F.concat(F.slice(lines, F.lit(1), at), F.array(seed), tail), "\n")

    return let(lines_of(base), put)


def interleave(seed: Column, base: Column, seed_no: int, *keys) -> Column:
    """Every seed line at a random place of the base; the order of both is kept."""
    entry = lambda at, side, i, x: F.struct(at.cast("int").alias("at"), F.lit(side).alias("side"), i.alias("i"), x.alias("x"))

    def mix(mine: Column, other: Column) -> Column:
        spots = F.size(other) + 1
        places = F.transform(mine, lambda x, j: F.pmod(draw(seed_no, "mix", *keys, j + 1), spots).cast("int"))
        placed = F.arrays_zip(F.array_sort(places).alias("at"), mine.alias("x"))
        rows = F.concat(
            F.transform(placed, lambda z, i: entry(z["at"], 0, i, z["x"])),
            F.transform(other, lambda x, i: entry(i, 1, i, x)),
        )
        return F.array_join(F.transform(F.array_sort(rows), lambda r: r["x"]), "\n")

    return let(lines_of(seed), lambda mine: let(lines_of(base), lambda other: mix(mine, other)))


def append_wrapped(first: Column, second: Column) -> Column:
    return F.concat(first, F.lit(WRAP_OPEN), second, F.lit(WRAP_CLOSE))


def new_name(seed_no: int, name: Column, *keys) -> Column:
    """The generated name of a name in one document (64 bits of a seeded hash)."""
    parts = [F.lit(str(seed_no)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys], name]
    return F.concat(F.lit("_0x"), F.substring(F.md5(F.concat_ws("|", *parts)), 1, 16))


def _free(token: Column, reserved: Sequence[str]) -> Column:
    free = F.lit(True)
    for pattern in reserved:
        free = free & ~token.rlike(pattern)
    return free


def rename(text: Column, seed_no: int, *keys, reserved: Sequence[str] = ()) -> Column:
    """Names replaced by generated ones, the same for equal names of one document (reversible)."""
    one = lambda t: F.when(is_name(t) & _free(t, reserved), new_name(seed_no, t, *keys)).otherwise(t)
    return F.array_join(F.transform(name_parts(text), one), "")


def rename_map(df: DataFrame, key: str, text: str, seed_no: int, reserved: Sequence[str] = ()) -> DataFrame:
    """(key, name, new): one row per distinct name of a document.

    Texts are dealt by key before, so what is then gathered by document shuffles no names.
    """
    names = F.array_distinct(F.filter(name_parts(F.col(text)), lambda t: is_name(t) & _free(t, reserved)))
    out = by_key(df.select(key, text), key).select(key, F.explode(names).alias("name"))
    return out.withColumn("new", new_name(seed_no, F.col("name"), key))


# Fixed value: JSON tokens with blanks kept.
JSON_PARTS = r"""\"(?:[^\"\\]|\\.)*\"|[{}\[\],:]|\s+|[^\s{}\[\],:\"]+"""


def rename_keys(json: Column, seed_no: int, *keys) -> Column:
    """Object keys of a JSON text, at any depth, replaced; values stay as written (reversible)."""
    parts = F.filter(F.regexp_extract_all(json, F.lit(JSON_PARTS), F.lit(0)), lambda t: F.trim(t) != "")

    def recode(solid: Column) -> Column:
        new = lambda t: new_name(seed_no, F.substr(t, F.lit(2), F.length(t) - 2), *keys)
        one = lambda t, i: F.when(
            t.startswith('"') & (F.get(solid, i + 1) == ":"), F.concat(F.lit('"'), new(t), F.lit('"'))
        ).otherwise(t)
        return F.array_join(F.transform(solid, one), "")

    return let(parts, recode)


def rename_text_keys(text: Column, seed_no: int, *keys) -> Column:
    """Names and string literals before a ':' replaced, in any text; equal keys alike, quotes stay."""

    def recode(toks: Column) -> Column:
        before_colon = lambda i: F.coalesce(F.get(toks, i + 1), F.lit("")).rlike(r"^\s*:")
        inner = lambda t: F.substr(t, F.lit(2), F.length(t) - 2)
        quote = lambda t: F.substring(t, 1, 1)
        one = lambda t, i: F.when(is_name(t) & before_colon(i), new_name(seed_no, t, *keys)).when(
            is_string(t) & (F.length(t) > 2) & before_colon(i), F.concat(quote(t), new_name(seed_no, inner(t), *keys), quote(t))
        ).otherwise(t)
        return F.array_join(F.transform(toks, one), "")

    return let(name_parts(text), recode)


def eligible_literals(df: DataFrame, key: str, text: str = "text", reserved: Sequence[str] = ()) -> DataFrame:
    """(key, pos, literal): string literals that match no reserved pattern."""
    toks = df.select(key, F.posexplode(raw_tokens(F.col(text))).alias("pos", "literal"))
    return toks.where(is_string(F.col("literal")) & _free(F.col("literal"), reserved))


def string_dictionary(
    text: Column, threshold: float, seed_no: int, *keys,
    rotate: bool = False, shuffle: bool = False, reserved: Sequence[str] = (),
) -> Column:
    """The chosen distinct literals of one document, in first-use, shuffled or rotated order."""
    chosen = lambda t: is_string(t) & _free(t, reserved) & share(draw(seed_no, "literal", *keys, t), threshold)
    out = F.array_distinct(F.filter(literal_parts(text), chosen))
    if shuffle:
        tagged = F.transform(out, lambda t: F.struct(draw(seed_no, "place", *keys, t).alias("h"), t.alias("t")))
        out = F.transform(F.array_sort(tagged), lambda r: r["t"])
    if rotate:
        by = lambda w: F.pmod(draw(seed_no, "rotate", *keys), F.greatest(F.size(w), F.lit(1))).cast("int")
        out = let(out, lambda w: F.concat(F.slice(w, by(w) + 1, F.size(w)), F.slice(w, F.lit(1), by(w))))
    return out


def reference_literals(text: Column, dictionary: Column, shift: int = 0) -> Column:
    """The text with each dictionary literal replaced by its index (reversible).

    What looks like a reference in the text already gets one more underscore.
    """
    def recode(words: Column) -> Column:
        at = lambda t: F.array_position(words, t)
        reference = lambda t: F.concat(F.lit("_s(0x"), F.lower(F.hex(at(t) - 1 + shift)), F.lit(")"))
        other = lambda t: F.regexp_replace(t, r"_s(_*)\(0x", r"_s_$1(0x")
        one = lambda t: F.when(is_string(t) & (at(t) > 0), reference(t)).otherwise(other(t))
        return F.array_join(F.transform(literal_parts(text), one), "")

    return let(dictionary, recode)


def encode_dictionary(dictionary: Column, encoding: str = "none") -> Column:
    if encoding == "none":
        return dictionary
    if encoding == "base64":
        return F.transform(dictionary, lambda t: F.base64(F.encode(t, "UTF-8")))
    raise ValueError(f"unknown encoding {encoding!r}")


def split_literals(text: Column, n: int, reserved: Sequence[str] = ()) -> Column:
    """String literals cut in chunks of n characters joined by '+' (reversible).

    A '+' that stands alone between two literals of the text gets one more
    blank behind it, so that a bare one is always a cut.
    """

    def one(t: Column) -> Column:
        quote = F.substring(t, 1, 1)
        chunks = F.regexp_extract_all(F.substr(t, F.lit(2), F.length(t) - 2), F.lit(f"(?s).{{1,{n}}}"), F.lit(0))
        joined = F.array_join(F.transform(chunks, lambda c: F.concat(quote, c, quote)), "+")
        cuttable = is_string(t) & (F.length(t) > 2) & _free(t, reserved)
        return F.when(cuttable, joined).when(t.rlike(r"^\+ *$"), F.regexp_replace(t, r"^\+", "+ ")).otherwise(t)

    return F.array_join(F.transform(literal_parts(text), one), "")


def _permuted(text: Column, threshold: float, seed_no: int, *keys) -> Column:
    """The lines as array<struct(h, i, x)> in their new order."""
    place = lambda moved, i: F.when(moved, draw(seed_no, "line", *keys, i)).otherwise(i.cast("bigint"))
    return let(
        share(draw(seed_no, "permute", *keys), threshold),
        lambda moved: F.array_sort(
            F.transform(lines_of(text), lambda x, i: F.struct(place(moved, i).alias("h"), i.alias("i"), x.alias("x")))
        ),
    )


def _joined(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: r["x"]), "\n")


def permute_lines(text: Column, threshold: float, seed_no: int, *keys) -> Column:
    """struct(text, line_order): the lines of a share of documents in random order (reversible)."""
    return let(
        _permuted(text, threshold, seed_no, *keys),
        lambda rows: F.struct(
            _joined(rows).alias("text"),
            F.array_join(F.transform(rows, lambda r: r["i"].cast("string")), ",").alias("line_order"),
        ),
    )


def number_expressions(text: Column, seed_no: int, *keys) -> Column:
    """Whole numbers n written as (a+b) with a + b = n.

    b has the last digits of n, from a drawn place on, and a the others with
    zeros behind: exact for numbers of any length.
    """

    def one(t: Column, i: Column) -> Column:
        at = F.pmod(draw(seed_no, "number", *keys, i), F.length(t) + 1).cast("int")
        plain = lambda c: F.regexp_replace(F.concat(F.lit("0"), c), "^0+(?=[0-9])", "")
        a = plain(F.concat(F.substr(t, F.lit(1), at), F.repeat(F.lit("0"), F.length(t) - at)))
        b = plain(F.substr(t, at + 1, F.length(t) - at))
        return F.when(is_integer(t), F.concat(F.lit("("), a, F.lit("+"), b, F.lit(")"))).otherwise(t)

    return F.array_join(F.transform(raw_tokens(text, blanks=True), one), "")


def dead_from(text: Column, donor: Column, threshold: float, seed_no: int, *keys) -> Column:
    """After a share of the lines, one line of a second text that the row already holds."""
    def put(pool: Column) -> Column:
        extra = lambda i: F.get(pool, F.pmod(draw(seed_no, "dead_line", *keys, i), F.size(pool)).cast("int"))
        chosen = lambda i: share(draw(seed_no, "dead", *keys, i), threshold)
        one = lambda x, i: F.when(chosen(i), F.concat(x, F.lit("\n"), extra(i))).otherwise(x)
        return F.array_join(F.transform(lines_of(text), one), "\n")

    return let(lines_of(donor), put)


def inject_dead(df: DataFrame, key: str, text: str, threshold: float, seed_no: int) -> DataFrame:
    """(key, text, dead_after): lines of other documents put in after a share of the lines.

    Each chosen place draws its own donor by rank and a line of it; the lines
    come by an equi-join on (donor, line number), so places, not texts, are
    shuffled. ``dead_after`` lists the lines that have a foreign line behind.
    """
    ranks = shuffled_rank(df, key, seed_no)
    shapes = df.select(key, F.size(lines_of(F.col(text))).alias("size"))
    places = shapes.select(key, F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("line"))
    places = places.where(share(draw(seed_no, "dead", key, "line"), threshold))
    places = places.join(ranks, key).withColumn(
        "donor_rank", step_past(draw(seed_no, "donor", key, "line"), F.col("n"), F.col("rank"))
    )
    donors = ranks.select(F.col(key).alias("donor"), F.col("rank").alias("donor_rank"))
    donors = donors.join(shapes.select(F.col(key).alias("donor"), "size"), "donor")
    places = places.join(donors, "donor_rank").withColumn(
        "donor_line", F.pmod(draw(seed_no, "dead_line", key, "line"), F.col("size")).cast("int")
    )
    pool = df.select(F.col(key).alias("donor"), F.posexplode(lines_of(F.col(text))).alias("donor_line", "foreign"))
    found = places.join(pool, ["donor", "donor_line"]).groupBy(key).agg(
        F.collect_list(F.struct("line", "foreign")).alias("dead")  # at most one per line of the document
    )
    row = lambda i, side, x: F.struct(i.alias("i"), F.lit(side).alias("side"), x.alias("x"))
    merged = F.array_sort(
        F.concat(
            F.transform(lines_of(F.col(text)), lambda x, i: row(i, 0, x)),
            F.transform(F.coalesce("dead", F.array()), lambda r: row(r["line"], 1, r["foreign"])),
        )
    )
    return df.select(key, text).join(found, key, "left").select(
        key,
        F.array_join(F.transform(merged, lambda r: r["x"]), "\n").alias(text),
        F.array_join(F.transform(F.filter(merged, lambda r: r["side"] == 1), lambda r: r["i"].cast("string")), ",").alias("dead_after"),
    )


# ---- the way back ---------------------------------------------------------


def unpermute(text: Column, line_order: Column) -> Column:
    # an empty text has one empty line and the order '0'
    places = F.transform(F.split(line_order, ","), lambda i: i.cast("int"))
    rows = F.array_sort(F.arrays_zip(places.alias("i"), lines_of(text).alias("x")))
    return F.array_join(F.transform(rows, lambda r: r["x"]), "\n")


def fold_literals(text: Column) -> Column:
    """Cut literals in one piece again; other '+' lose the blank that ``split_literals`` put behind."""

    def fold(parts: Column) -> Column:
        at = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
        quote = lambda t: F.substring(t, 1, 1)
        # the cut before part i, if there is one
        joint = lambda i: (i > 0) & (at(i) == "+") & is_string(at(i - 1)) & is_string(at(i + 1)) & (quote(at(i - 1)) == quote(at(i + 1)))
        shut = lambda t, i: F.when(joint(i + 1), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t)
        opened = lambda t, i: F.when((i > 1) & joint(i - 1), F.substr(t, F.lit(2), F.length(t))).otherwise(t)
        one = lambda t, i: (
            F.when(is_string(t), opened(shut(t, i), i)).when(joint(i), "")
            .when(t.rlike(r"^\+ +$"), F.regexp_replace(t, r"^\+ ", "+")).otherwise(t)
        )
        return F.array_join(F.transform(parts, one), "")

    return let(literal_parts(text), fold)


def inline_literals(text: Column, dictionary: Column, shift: int = 0) -> Column:
    """Index references back to the literals; references beyond the dictionary stay.

    Places in an array have fewer than 15 hex digits, whatever the shift.
    """
    parts = F.regexp_extract_all(text, F.lit(r"(?s)_s\(0x[0-9a-f]+\)|_s_+\(0x|[^_]+|_"), F.lit(0))
    at = lambda t: F.conv(F.regexp_extract(t, r"0x([0-9a-f]+)\)$", 1), 16, 10).cast("bigint") - shift
    inside = lambda words, t: (at(t) >= 0) & (at(t) < F.size(words))
    word = lambda words, t: F.when(
        t.rlike(r"^_s\(0x[0-9a-f]{1,15}\)$"), F.when(inside(words, t), F.get(words, at(t).cast("int"))).otherwise(t)
    ).when(t.startswith("_s_"), F.regexp_replace(t, "^_s_", "_s")).otherwise(t)
    return let(dictionary, lambda words: F.array_join(F.transform(parts, lambda t: word(words, t)), ""))


# Fixed value: what a generated name looks like. It may follow a number directly.
GENERATED = r"_0x[0-9a-f]{16}"


@F.pandas_udf(T.StringType())
def _names_back(texts: pd.Series, new: pd.Series, name: pd.Series) -> pd.Series:
    def one(text, coded, plain):
        if text is None or coded is None:
            return text
        back = dict(zip(coded, plain))
        return re.sub(GENERATED, lambda m: back.get(m[0], m[0]), text)

    return pd.Series([one(*row) for row in zip(texts, new, name)], dtype=object)


def undo_rename(df: DataFrame, key: str, columns: Sequence[str], mapping: DataFrame) -> DataFrame:
    """``df`` with generated names turned back in the given text columns.

    The mapping of a document, as long as its distinct names, meets the text by
    one join on the document; tokens are never exploded.
    """
    names = mapping.groupBy(key).agg(F.collect_list(F.struct("new", "name")).alias("_m"))
    joined = df.join(names, key, "left")
    back = {c: _names_back(F.col(c), F.col("_m.new"), F.col("_m.name")) for c in columns}
    return joined.withColumns(back).drop("_m")


def restore(
    df: DataFrame, key: str, text: str, digest: str,
    dictionary: str | None = None, line_order: str | None = None, mapping: DataFrame | None = None, shift: int = 0,
) -> DataFrame:
    """(key, text, status): transformations undone; the status says how far that went.

    strict: line order, references, names undone and the digest of the original
    is met; loose: met only after also folding split literals; failed: the digest
    is not met, the best attempt is kept.
    """
    now = F.col(text)
    if line_order:
        now = unpermute(now, F.col(line_order))
    step = df.select(key, now.alias("_plain"), F.col(digest).alias("_want"), *([dictionary] if dictionary else []))
    inline = lambda c: inline_literals(c, F.col(dictionary), shift) if dictionary else c
    step = step.select(
        key, "_want", inline(F.col("_plain")).alias("_strict"), inline(fold_literals(F.col("_plain"))).alias("_loose")
    )
    if mapping is not None:
        step = undo_rename(step, key, ["_strict", "_loose"], mapping)
    met = lambda c: F.md5(c) == F.col("_want")
    return step.select(
        key,
        F.when(met("_strict"), F.col("_strict")).otherwise(F.col("_loose")).alias(text),
        F.when(met("_strict"), "strict").when(met("_loose"), "loose").otherwise("failed").alias("status"),
    )


# ---- all cells of the grid ------------------------------------------------


Step = tuple[str, Callable[[Column], Column]]


# Fixed value: how the first line of a text with a literal dictionary begins.
HEADER = "_s="


def with_dictionary(text: Column, dictionary: Column, encoding: str = "none") -> Column:
    """The text with its dictionary literals referenced, and a first line that holds them as JSON (reversible)."""
    body = lambda words: F.concat(F.lit(HEADER), F.to_json(encode_dictionary(words, encoding)), F.lit("\n"), reference_literals(text, words))
    return let(dictionary, body)


def parted(text: Column) -> Column:
    """struct(header, body): the dictionary line with its end, or '', and the rest."""
    end = F.locate("\n", text)
    return F.when(
        text.startswith(HEADER) & (end > 0),
        F.struct(F.substr(text, F.lit(1), end).alias("header"), F.substr(text, end + 1, F.length(text)).alias("body")),
    ).otherwise(F.struct(F.lit("").alias("header"), text.alias("body")))


def without_dictionary(text: Column, encoding: str = "none") -> Column:
    """The inverse of ``with_dictionary``."""
    def back(p: Column) -> Column:
        words = F.from_json(F.substr(p["header"], F.lit(len(HEADER) + 1), F.length(p["header"])), "array<string>")
        if encoding == "base64":
            words = F.transform(words, lambda w: F.decode(F.unbase64(w), "UTF-8"))
        return F.when(p["header"] != "", inline_literals(p["body"], words)).otherwise(p["body"])

    return let(parted(text), back)


def as_tree(text: Column) -> Column:
    """A text as JSON: a list of its lines, each the list of its token classes."""
    return F.to_json(F.transform(lines_of(text), lambda x: tokens(x)))


def _known_steps(
    flags: dict[str, str], seed_no: int, keys: Sequence[str], donor: Column, to_ast: bool
) -> list[tuple[str, Callable[[Column], Column], rewriting.Rule | None]]:
    """The steps that the flags of a profile switch on, in order, as columns and, where there is one, as the rule for texts in batches.

    Equal steps have equal names. Steps after the string dictionary leave its line alone.
    """
    on = lambda name: flags[name] == "true"
    reserved = [p for p in [flags["reserved_strings"]] if p]
    words_share, chunk = float(flags["string_array_threshold"]), int(flags["split_length"])
    moved, dead, coding = float(flags["permute_threshold"]), float(flags["dead_threshold"]), flags["encoding"]
    rotate, shuffle = on("rotate"), on("shuffle")
    array = on("string_array") and words_share > 0
    words = lambda t: string_dictionary(t, words_share, seed_no, *keys, rotate=rotate, shuffle=shuffle, reserved=reserved)
    after = lambda step: (lambda t: let(parted(t), lambda p: F.concat(p["header"], step(p["body"])))) if array else step
    later = lambda rule: rewriting.behind(HEADER, rule) if array else rule
    # patterns are the JVM's, but for those that hold no literal or every one
    free, plain = not reserved, reserved in ([], [".*"])
    listed = rewriting.with_dictionary(HEADER, words_share, rotate, shuffle, free, coding) if plain and coding in ("none", "base64") else None
    known: list[tuple[bool, str, Callable[[Column], Column], rewriting.Rule | None]] = [
        (on("rename"), "rename", lambda t: rename(t, seed_no, *keys), rewriting.rename),
        (on("rename_keys"), "keys", lambda t: rename_text_keys(t, seed_no, *keys), rewriting.rename_keys),
        (on("numbers"), "numbers", lambda t: number_expressions(t, seed_no, *keys), rewriting.numbers),
        (array, f"words {words_share} {rotate} {shuffle} {reserved} {coding}", lambda t: with_dictionary(t, words(t), coding), listed),
        (on("split_strings"), f"split {chunk} {reserved}", after(lambda t: split_literals(t, chunk, reserved)),
         later(rewriting.split_literals(chunk, free)) if plain else None),
        (on("permute"), f"permute {moved}", after(lambda t: _joined(_permuted(t, moved, seed_no, *keys))), later(rewriting.permute(moved))),
        (on("dead"), f"dead {dead}", after(lambda t: dead_from(t, donor, dead, seed_no, *keys)), later(rewriting.dead(dead))),
        (on("compact"), "compact", after(compact), later(rewriting.compact)),
    ]
    # registered steps, in the order of the flag, before a text becomes a tree
    known += [(True, f"own {name}", after(STEPS[name]), None) for name in flags.get("own_steps", "").split(",") if name]
    known.append((to_ast, "tree", as_tree, rewriting.as_tree))
    return [found for wanted, *found in known if wanted]


def steps_of(flags: dict[str, str], seed_no: int, keys: Sequence[str], donor: Column, to_ast: bool = False) -> list[Step]:
    """The steps that the flags of a profile switch on, in order; equal steps have equal names.

    Steps after the string dictionary leave its line alone.
    """
    return [(name, step) for name, step, _ in _known_steps(flags, seed_no, keys, donor, to_ast)]


#: What a cell is made of: its tags, the column it starts from, its steps, and what is done with the text at the end.
Recipe = tuple[dict[str, str], str, Sequence[Step], Callable[[Column], Column]]


@dataclass(frozen=True)
class Made:
    """Something made of a text: as a column, and the same in Python with its type in Arrow."""

    column: Callable[[Column], Column]
    plain: Callable[[str], Any]
    kind: pa.DataType

    def __call__(self, text: Column) -> Column:
        return self.column(text)


#: What is handed on of a finished text, by name.
Outputs = dict[str, Callable[[Column], Column]]
WHOLE: Outputs = {"target_text": Made(lambda text: text, lambda text: text, pa.string())}
DIGEST = Made(F.md5, lambda text: rewriting.md5(text.encode()).hexdigest(), pa.string())
CHARS = Made(lambda text: F.length(text).cast("bigint"), len, pa.int64())


def run_recipes(df: DataFrame, recipes: Sequence[Recipe], keep: Sequence[str], outputs: Outputs = WHOLE) -> DataFrame:
    """One row per row and recipe: the columns ``keep``, the tags, the outputs.

    All recipes are projections of the row, which is not shuffled. Steps are told
    by their names: what several recipes begin with, from the same column, is done
    once. Only the outputs are held beside each other, so a caller that wants a
    digest or a length of the texts does not hold the texts.
    """
    columns = {(start,): start for _, start, _, _ in recipes}  # steps taken so far -> column
    trails = [(start,) for _, start, _, _ in recipes]
    for depth in range(max((len(steps) for _, _, steps, _ in recipes), default=0)):
        new = {}
        for c, (_, _, steps, _) in enumerate(recipes):
            if depth < len(steps):
                name, step = steps[depth]
                before, trails[c] = trails[c], (*trails[c], name)
                if trails[c] not in columns:
                    columns[trails[c]] = f"_step{len(columns)}"
                    new[columns[trails[c]]] = step(F.col(columns[before]))
        df = df.withColumns(new)
    rows = []
    for (tags, _, _, finish), trail in zip(recipes, trails):
        shown = lambda text: F.struct(*[make(text).alias(name) for name, make in outputs.items()])
        done = finish(F.col(columns[trail]))
        made = shown(done) if len(outputs) == 1 else let(done, shown)
        rows.append(F.struct(*[F.lit(v).alias(k) for k, v in tags.items()], made.alias("_made")))
    out = df.select(*keep, F.explode(F.array(*rows)).alias("_cell"))
    return out.select(*keep, *[f"_cell.{t}" for t in recipes[0][0]], *[f"_cell._made.{o}" for o in outputs])


def compose(
    df: DataFrame, text: str, recipes: dict[str, Sequence[str]], steps: dict[str, Callable[[Column], Column]] | None = None,
    outputs: Outputs = WHOLE,
) -> DataFrame:
    """``df`` without its text, once per recipe: ``recipe`` and the outputs of its text.

    A recipe lists steps by name: those given, else those that ``extend.register_step`` knows.
    """
    known = {**STEPS, **(steps or {})}
    made = [({"recipe": r}, text, [(n, known[n]) for n in names], lambda t: t) for r, names in recipes.items()]
    return run_recipes(df, made, [c for c in df.columns if c != text], outputs)


Cell = tuple[dict[str, str], dict[str, str], bool, bool, bool]  # tags, flags, partial, mixed, to_ast


#: Characters of texts that a task makes of some rows before it hands them on, and rows of a batch that it takes at a time.
HANDED_ON, ROWS = 4 << 20, 500


def _rewritten(
    seed_no: int, keep: int, tags: dict[str, list[str]], recipes: Sequence[tuple[bool, bool, Sequence[tuple[str, rewriting.Rule]]]],
    outputs: Sequence[Callable[[str], Any]], schema: pa.Schema,
) -> Callable:
    """Rows (kept columns.., key, alt text, base text, foreign characters) to their cells; a recipe tells whether it is mixed before, or after its steps."""
    trails = [(early, *(name for name, _ in steps)) for early, _, steps in recipes]

    def cells(grammar: rewriting.Grammar, key: str | None, alt: str | None, base: str | None, told: dict | None) -> list[str | None]:
        if told:
            grammar.learn(told["letters"], told["numbers"])
        row = rewriting.Row(seed_no, [key], base, grammar)
        at = row.draw("inject")
        made = {(False,): alt}  # steps taken so far -> text
        if any(early for early, _, _ in recipes):
            made[True,] = rewriting.inject(alt, base, at)
        out = []
        for trail, (_, late, steps) in zip(trails, recipes):
            text = made[trail[:1]]
            for depth, (_, step) in enumerate(steps, 2):
                if trail[:depth] not in made:
                    made[trail[:depth]] = None if text is None else step(text, row)
                text = made[trail[:depth]]
            out.append(rewriting.inject(text, base, at) if late else text)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = rewriting.Grammar()

        def handed_on(batch: pa.RecordBatch, first: int, made: list[list]) -> pa.RecordBatch:
            rows = len(made[0]) // len(recipes)
            places = pa.array([i for i in range(first, first + rows) for _ in recipes], pa.int64())
            kept = [c.take(places) for c in batch.columns[:keep]]
            return pa.RecordBatch.from_arrays([*kept, *[pa.array(v * rows) for v in tags.values()], *[pa.array(v, f.type) for v, f in zip(made, list(schema)[-len(outputs) :])]], schema=schema_of(kept))

        def schema_of(kept: list[pa.Array]) -> pa.Schema:
            # the types as they came: Spark's own names of nested fields
            return pa.schema([*[pa.field(f.name, c.type) for f, c in zip(schema, kept)], *list(schema)[keep:]])

        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, len(whole), ROWS)):
            sides = [c.to_pylist() for c in batch.columns[keep:]]
            first, size, made = 0, 0, [[] for _ in outputs]
            for i, row in enumerate(zip(*sides)):
                found = cells(grammar, *row)
                for column, make in zip(made, outputs):
                    column.extend([None if text is None else make(text) for text in found])
                size += sum(len(text) for text in found if text is not None)
                if size >= HANDED_ON:
                    yield handed_on(batch, first, made)
                    first, size, made = i + 1, 0, [[] for _ in outputs]
            if first < len(batch):
                yield handed_on(batch, first, made)

    return run


def run_cells(pairs: DataFrame, seed_no: int, cells: Sequence[Cell], outputs: Outputs = WHOLE, keep: Sequence[str] | None = None) -> DataFrame:
    """One row per pair and cell: the pair columns (or those of ``keep``), the tags of the cell, the outputs (``target_text``).

    A cell transforms the alt text, mixed in the base before (``mixed``), after the
    transformation (``mixed`` and ``partial``) or not at all. The texts are shuffled once, by the attach step.
    Cells are made in Arrow batches, a step that several of them begin with once a row; with registered
    steps, reserved patterns or outputs that are columns only, they are projections (``run_recipes``).
    """
    keep = list(pairs.columns if keep is None else keep)
    place, base = draw(seed_no, "inject", "pair_id"), F.col("base_text")
    known = [_known_steps(flags, seed_no, ["pair_id"], base, to_ast) for _, flags, _, _, to_ast in cells]
    if all(rule for steps in known for _, _, rule in steps) and all(isinstance(make, Made) for make in outputs.values()):
        alt = F.col("alt_text")
        work = pairs.select(*keep, F.col("pair_id").cast("string").alias("_key"), alt.alias("_alt"), base.alias("_base"), rewriting.foreign(alt, base).alias("_foreign"))
        recipes = [(mixed and not partial, mixed and partial, [(name, rule) for name, _, rule in steps]) for (_, _, partial, mixed, _), steps in zip(cells, known)]
        tags = {t: [tags[t] for tags, *_ in cells] for t in cells[0][0]}
        shown = T.StructType([*pairs.select(*keep).schema, *[T.StructField(t, T.StringType()) for t in tags],
                              *[T.StructField(o, {pa.string(): T.StringType(), pa.int64(): T.LongType()}[make.kind]) for o, make in outputs.items()]])
        made = pa.schema([*[pa.field(c, pa.null()) for c in keep], *[pa.field(t, pa.string()) for t in tags], *[pa.field(o, make.kind) for o, make in outputs.items()]])
        return work.mapInArrow(_rewritten(seed_no, len(keep), tags, recipes, [make.plain for make in outputs.values()], made), shown)
    work = pairs.withColumn("_plain", F.col("alt_text"))
    if any(mixed and not partial for _, _, partial, mixed, _ in cells):
        work = work.withColumn("_mixed", inject(F.col("alt_text"), base, place))
    late = lambda text: inject(text, base, place)
    recipes = [
        (tags, "_mixed" if mixed and not partial else "_plain", [(name, step) for name, step, _ in steps], late if mixed and partial else lambda text: text)
        for (tags, _, partial, mixed, _), steps in zip(cells, known)
    ]
    return run_recipes(work, recipes, keep, outputs)


def apply_profiles(
    pairs: DataFrame, seed_no: int, exps: Sequence[str] = EXPERIMENTS, mixes: Sequence[str] = MIXES, partial: bool = False,
    outputs: Outputs = WHOLE, keep: Sequence[str] | None = None,
) -> DataFrame:
    """The grid of experiments: M1 transforms the alt text alone, M2 mixes it in the base
    first, M3 adds dead lines of the base. ``partial`` transforms before mixing."""
    flags = lambda exp, mix: {**DEFAULT_FLAGS, **EXPERIMENT_FLAGS[exp], "dead": str(mix == "M3").lower()}
    return run_cells(pairs, seed_no, [({"exp": e, "mix": m}, flags(e, m), partial, m != "M1", False) for e in exps for m in mixes], outputs, keep)


def apply_modes(pairs: DataFrame, seed_no: int, names: Sequence[str], outputs: Outputs = WHOLE, keep: Sequence[str] | None = None) -> DataFrame:
    """The same for profiles given by name or mode word; adds ``mode``."""
    rows = {key: r for r in profile_rows() for key in (r["mode"], r["name"])}
    cells = [({"mode": n}, {**DEFAULT_FLAGS, **rows[n]["over"]}, rows[n]["partial"], rows[n]["mixed"], rows[n]["to_ast"]) for n in names]
    return run_cells(pairs, seed_no, cells, outputs, keep)
