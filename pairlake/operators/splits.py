"""Subset, shuffle, exact three-way split, shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairlake.functions.draws import DRAW_BITS, draw
from pairlake.operators.ranks import BUCKET_BITS, shuffled_rank

# Fixed value: names of the three stages, in order.
STAGES = ("train", "validation", "test")


def subset(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows by key (a distributed top-n, no full sort)."""
    return df.orderBy(order).limit(n)


def _cut_points(df: DataFrame, key: str, seed: int, fractions: Sequence[float], bits: int) -> DataFrame:
    """One row: an array with the (draw, key) found at each rank floor(f*n).

    Bucket sizes tell which bucket holds the rank; only those buckets are
    ranked, which are a few of ``2**bits``.
    """
    keys = df.select(F.col(key).alias("k"), draw(seed, "shuffle", key).alias("h"))
    keys = keys.withColumn("b", F.shiftright("h", DRAW_BITS - bits).cast("int"))
    sizes = keys.groupBy("b").agg(F.count("*").alias("c"))  # at most 2**bits rows
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        "b", "c", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off"),
        F.sum("c").over(Window.partitionBy()).alias("n"),
    )
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(f)).alias("f")) for i, f in enumerate(fractions)])
    spots = sizes.select("*", F.explode(wanted).alias("w")).select(
        "b", "off", F.col("w.i").alias("i"), F.floor(F.col("w.f") * F.col("n")).alias("at"), "c"
    ).where((F.col("at") >= F.col("off")) & (F.col("at") < F.col("off") + F.col("c")))
    hit = keys.join(F.broadcast(spots), "b")  # one row per fraction
    ranked = hit.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("h", "k")) - 1 + F.col("off"))
    return ranked.where("r = at").agg(
        F.map_from_entries(F.collect_list(F.struct("i", F.struct("h", "k")))).alias("cuts")
    )


def with_stage(
    df: DataFrame,
    key: str,
    seed: int,
    fractions: Sequence[float] = (0.8, 0.9),
    overlap: bool = False,
    bits: int = BUCKET_BITS,
) -> DataFrame:
    """Adds ``stage``: the first floor(f1*n) rows of a shuffle, up to floor(f2*n), the rest.

    The order of the shuffle is (draw, key), so membership is a comparison
    with two cut points. They come from a scalar subquery over keys only; the
    rows with the text are neither sorted, ranked nor shuffled.

    ``overlap=True`` gives the older form in which the test set is everything
    from the first cut on, so validation rows appear in both.
    """
    cuts = _cut_points(df, key, seed, fractions, bits).scalar()
    here = F.struct(draw(seed, "shuffle", key).alias("h"), F.col(key).alias("k"))
    # a cut at rank n lies behind all rows: no entry, everything is before it
    before = lambda i: F.coalesce(here < F.try_element_at(F.col("_cuts"), F.lit(i)), F.lit(True))
    known = df.withColumn("_cuts", cuts)
    if not overlap:
        stage: Column = (
            F.when(before(0), F.lit(STAGES[0])).when(before(1), F.lit(STAGES[1])).otherwise(F.lit(STAGES[2]))
        )
    else:
        stage = F.explode(
            F.when(before(0), F.array(F.lit(STAGES[0])))
            .when(before(1), F.array(F.lit(STAGES[1]), F.lit(STAGES[2])))
            .otherwise(F.array(F.lit(STAGES[2])))
        )
    return known.withColumn("stage", stage).drop("_cuts")


def leaked_keys(staged: DataFrame, key: str) -> DataFrame:
    """(key, stages): keys in more than one stage, with the names of these in order."""
    seen = staged.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("stage")), ",").alias("stages"))
    return seen.where(F.contains("stages", F.lit(",")))


def leaked_texts(staged: DataFrame, text: str) -> DataFrame:
    """(text, stages, rows): equal texts in more than one stage.

    Texts meet by their digest; copies are added up before the shuffle, and
    never paired.
    """
    digest = F.sha2(F.col(text), 256).alias("_d")
    per = staged.groupBy(digest, "stage").agg(F.count("*").alias("c"), F.min(text).alias("_t"))
    found = per.groupBy("_d").agg(
        F.array_join(F.array_sort(F.collect_set("stage")), ",").alias("stages"), F.sum("c").alias("rows"), F.min("_t").alias(text)
    )
    return found.where(F.contains("stages", F.lit(","))).select(text, "stages", "rows")


def shard(df: DataFrame, key: str, total: int, index: int, seed: int = 0) -> DataFrame:
    """Keys whose place in the shuffle is ``index`` modulo ``total``."""
    ranked = shuffled_rank(df, key, seed)
    return ranked.where(F.pmod("rank", F.lit(total)) == index)
