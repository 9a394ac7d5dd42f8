"""Secret scans: fixed rules, and character Markov models of random strings and identifiers.

Runs of token characters are scored under two first-order Markov models, one
trained on samples of secrets, one on samples of ordinary tokens; the ratio of
their likelihoods decides. Everything is column functions; to the driver come
the transition counts only, of which there are at most twice the square of the
alphabet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from pairlake.functions.bind import let
from pairlake.functions.draws import draw
from pairlake.llm.common import first_by, fresh, row_text

#: The base rules. Each matches first and is checked for length after.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"  # whole runs only, so the same as matching any run and dropping the short ones
KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]
#: Characters of tokens; their places are the states, 0 is any other character.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"[A-Za-z0-9+/_=-]{4,}"
SAMPLE, SMOOTHING, UNIFORM, THRESHOLD, SEED = 4000, 10.0, 0.25, 10.0, 42
MARK = "\x01"
#: Elements of a block of ``_before``; behind all places.
BLOCK, BEHIND = 512, 1 << 60


def _before(values: Column, start: int, combine) -> Column:
    """For each of an array of longs all values before it, combined (an associative operation), from ``start`` on.

    In blocks, whose own results are combined first: an array that grows by one element
    is copied each time, so it must stay short.
    """
    nothing = F.array().cast("array<bigint>")
    first = F.lit(start).cast("bigint")

    def inside(some: Column, begin: Column) -> Column:
        step = lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["found"], F.array(acc["at"])).alias("found"))
        return F.aggregate(some, F.struct(begin.alias("at"), nothing.alias("found")), step, lambda acc: acc["found"])

    def whole(blocks: Column) -> Column:
        each = F.transform(blocks, lambda b: F.aggregate(b, first, lambda x, y: combine(x, y)))
        return F.flatten(F.zip_with(blocks, inside(each, first), inside))

    parts = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
    return let(values, lambda v: F.when(F.size(v) > 0, let(parts(v), whole)).otherwise(nothing))


def spans(text: Column, rule: str) -> Column:
    """array<struct<start, end, part>> of the leftmost matches of ``rule``; in code points, end exclusive.

    The matches are parted from the rest by a mark that no rule matches (in
    the text it is replaced by another such character), so every second piece is a
    match, and the lengths of the pieces give the places.
    """
    nothing = F.array().cast("array<struct<start: bigint, end: bigint, part: string>>")
    pieces = F.split(F.regexp_replace(F.translate(text, MARK, "\x02"), rule, f"{MARK}$0{MARK}"), MARK, -1)

    def placed(parts: Column) -> Column:
        starts = _before(F.transform(parts, lambda p: F.length(p).cast("bigint")), 0, lambda a, b: a + b)
        each = F.zip_with(parts, starts, lambda p, at: F.struct(at.alias("start"), (at + F.length(p)).alias("end"), p.alias("part")))
        return F.filter(each, lambda s, i: i % 2 == 1)

    return F.when(text.rlike(rule), let(pieces, placed)).otherwise(nothing)


def _of_kind(found: Column, kind: str, fine=None) -> Column:
    """(start, place of the kind, end, kind, part): sorts by start, then kind."""
    kept = found if fine is None else F.filter(found, fine)
    return F.transform(
        kept,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind"),
            s["part"].alias("part"),
        ),
    )


def base_spans(text: Column) -> Column:
    """The spans of the base rules, sorted."""
    return F.array_sort(F.concat(
        _of_kind(spans(text, ASSIGN), "assign", lambda s: F.length(F.regexp_extract(s["part"], ASSIGN, 2)) >= 6),
        _of_kind(spans(text, ACCESS), "access", lambda s: F.length(s["part"]) >= 20),
        _of_kind(spans(text, HEX), "hex"),
    ))


def samples(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(value, label): at most ``size`` values that the base rules find (1) and the ordinary tokens of ``size`` texts (0).

    Both are the first by a seeded hash. Ordinary tokens are those left when
    the base rules' matches are taken out.
    """
    (order,) = fresh(docs, "_order")
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"), draw(seed, "sample", row_text(key, text)).alias(order))
    values = F.transform(F.filter(base_spans(F.col("t")), lambda s: F.length(s["part"]) >= 6), lambda s: s["part"])
    secret = rows.where(F.col("t").rlike(f"{ASSIGN}|{ACCESS}|{HEX}")).select(order, F.explode(values).alias("value"))
    secret = first_by(secret, order, size, "value")
    # of an assignment only the value is random
    secret = secret.select(F.regexp_replace("value", r"^.*[\"'\x20:=](?=[A-Za-z0-9+/_.=-]{6,}$)", "").alias("value"), F.lit(1).alias("label"))
    plain = F.regexp_replace("t", f"{ASSIGN}|{ACCESS}|{HEX}", " ")
    ordinary = first_by(rows, order, size, "t").select(F.explode(F.regexp_extract_all(plain, F.lit(ORDINARY), F.lit(0))).alias("value"))
    return secret.unionByName(ordinary.withColumn("label", F.lit(0)))


def _states(value: Column) -> Column:
    """The places of the characters in the alphabet."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c))


def fit(labelled: DataFrame, value: str = "value", label: str = "label", smoothing: float = SMOOTHING, uniform: float = UNIFORM) -> list[float]:
    """log(P(next | char, secret) / P(next | char, ordinary)) at place char * n + next, from (value, label 0 or 1).

    Transitions are smoothed towards how often the next character occurs at all.
    Random strings may come from any alphabet, so a share ``uniform`` of their model
    is the uniform one; with no secrets at all it is uniform as a whole. Other
    labels, null ones and null values are left out.
    """
    n = len(ALPHABET) + 1
    steps = let(
        _states(F.col(value)),
        lambda s: F.transform(
            F.when(F.size(s) > 1, F.sequence(F.lit(1), F.size(s) - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.element_at(s, i) * n + F.element_at(s, i + 1),
        ),
    )
    seen = labelled.where(F.col(label).isin(0, 1) & F.col(value).isNotNull()).select(F.col(label).cast("int").alias("l"), F.explode(steps).alias("at"))
    counts = [[0.0] * (n * n) for _ in range(2)]
    for row in seen.groupBy("l", "at").agg(F.count("*").alias("c")).collect():  # at most 2 n^2 rows
        counts[row["l"]][row["at"]] += row["c"]
    shares = []
    for c in counts:
        totals, whole = [sum(c[a * n : (a + 1) * n]) for a in range(n)], sum(c)
        often = [(sum(c[b::n]) + 0.5) / (whole + 0.5 * n) for b in range(n)]
        shares.append([(c[at] + smoothing * often[at % n]) / (totals[at // n] + smoothing) for at in range(n * n)])
    shares[1] = [(1 - uniform) * s + uniform / n for s in shares[1]]
    return [math.log(s / o) for s, o in zip(shares[1], shares[0])]


def ratio(value: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a string, in linear time."""
    n = len(ALPHABET) + 1
    known = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")  # folded into one constant
    return let(
        _states(value),
        lambda s: F.aggregate(
            F.when(F.size(s) > 1, F.sequence(F.lit(1), F.size(s) - 1)).otherwise(F.array().cast("array<int>")),
            F.lit(0.0),
            lambda acc, i: acc + F.element_at(known, F.element_at(s, i) * n + F.element_at(s, i + 1) + 1),
        ),
    )


def scan(
    docs: DataFrame, model: list[float] | None = None, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` with the array ``secrets`` of (start, place, end, kind, part), sorted by start, then kind.

    The base kinds are always kept; a run of 16 or more token characters that
    meets no base span and whose likelihood ratio reaches ``threshold`` is added
    as ``random``. Without ``model`` one is fitted on ``samples(docs)``. One row for
    each row given, repeated rows alike; null and empty texts have an empty array;
    other columns (and names) and an empty table pass through. No shuffle.
    """
    if model is None:
        model = fit(samples(docs, key, text))
    whole, name = fresh(docs, "_whole", "secrets")
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    candidates = _of_kind(spans(F.col(whole), CANDIDATE), "random")
    random = lambda s: s["place"] == len(BASE)

    def chosen(found: Column) -> Column:
        """Of all spans, sorted, the base ones and the candidates that meet none of them and look random."""
        ends = _before(F.transform(found, lambda s: F.when(random(s), 0).otherwise(s["end"])), 0, F.greatest)
        starts = F.reverse(F.transform(found, lambda s: F.when(random(s), BEHIND).otherwise(s["start"])))
        next_ = F.reverse(_before(starts, BEHIND, F.least))
        met = F.zip_with(F.zip_with(found, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), next_, lambda x, n: F.struct(
            x["s"].alias("s"), (~random(x["s"]) | ((x["e"] <= x["s"]["start"]) & (n >= x["s"]["end"]))).alias("apart")))
        kept = F.filter(met, lambda x: x["apart"] & F.when(random(x["s"]), ratio(x["s"]["part"], model) >= threshold).otherwise(True))
        return F.transform(kept, lambda x: x["s"])

    return rows.select(*own, let(F.array_sort(F.concat(base_spans(F.col(whole)), candidates)), chosen).alias(name))


def _number(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(found: DataFrame, key: str, name: str) -> DataFrame:
    """(key, counts per base kind, base_sha256, spans): what a check needs of ``scan``."""
    show = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        F.col(key),
        *[_number(name, k).alias(f"n_{k}") for k in BASE],
        F.sha2(show(F.filter(name, lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        show(F.col(name)).alias("spans"),
    )
