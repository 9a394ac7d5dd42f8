"""Global ranks, running totals and exact quantiles without a one-task window.

``row_number()`` over a whole table sorts it in a single task. Here rows are
first cut in many buckets, a small table of bucket sizes is accumulated, and
the window only runs inside a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairlake.functions.draws import DRAW_BITS, draw
from pairlake.session import cut

BUCKET_BITS = 12


def shuffled_rank(
    df: DataFrame,
    key: str,
    seed: int,
    salt: str = "shuffle",
    by: Sequence[str] = (),
    bits: int = BUCKET_BITS,
) -> DataFrame:
    """(by.., key, rank, n): the place of each key in a seeded shuffle, from 0.

    Only ``by`` and the key travel, never the text. A bucket is the leading
    bits of the draw, so even a group with most of all rows is spread over
    ``2**bits`` window partitions.
    """
    by = list(by)
    keys = df.select(*by, key, draw(seed, salt, key).alias("_h"))
    keys = keys.withColumn("_b", F.shiftright("_h", DRAW_BITS - bits).cast("int"))
    sizes = keys.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    # without ``by`` this window has at most 2**bits rows
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *by,
        "_b",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
        F.sum("_c").over(whole).alias("n"),
    )
    inside = Window.partitionBy(*by, "_b").orderBy("_h", key)
    ranked = keys.withColumn("_r", F.row_number().over(inside) - 1)
    side = sizes if by else F.broadcast(sizes)  # bounded by 2**bits rows
    return ranked.join(side, [*by, "_b"]).select(
        *by, key, (F.col("_r") + F.col("_off")).alias("rank"), "n"
    )


def running(
    df: DataFrame,
    order: Sequence[str],
    totals: dict[str, Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Adds, per name in ``totals``, the sum over earlier rows and own row in ``order``.

    Rows are range-partitioned on ``by`` + ``order``, so a group with most of
    the rows is split over tasks. The partition number is fixed by a
    checkpoint before it is used twice. ``order`` must be unique within ``by``.
    """
    by, order, names = list(by), list(order), list(totals)
    placed = df.select("*", *[c.alias(f"_v_{k}") for k, c in totals.items()])
    placed = placed.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id())
    placed = cut(placed)
    sums = placed.groupBy(*by, "_p").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in names])
    # at most one row per shuffle partition and group border
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *by, "_p", *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in names]
    )
    inside = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.select("*", *[F.sum(f"_v_{k}").over(inside).alias(f"_i_{k}") for k in names])
    joined = placed.join(offsets, [*by, "_p"])
    return joined.select(
        *df.columns, *[(F.col(f"_i_{k}") + F.col(f"_o_{k}")).alias(k) for k in names]
    )


def value_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, value, c, upto): the distinct values of several columns, their counts, and the running counts."""
    parts = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    long = df.selectExpr(f"stack({len(columns)}, {parts}) as (name, value)").where("value is not null")
    counts = long.groupBy("name", "value").agg(F.count("*").alias("c"))
    return running(counts, ["value"], {"upto": F.col("c")}, by=["name"])


def exact_quantiles(df: DataFrame, columns: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """(name, fraction, value): interpolated exact quantiles of several columns.

    Values are pre-aggregated to distinct values, then located by running
    counts; no buffer with all distinct values exists in any task.
    """
    return quantiles_of(value_ranks(df, columns), fractions)


def quantiles_of(seen: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """The same from a table of ``value_ranks``."""
    total = seen.groupBy("name").agg(F.sum("c").alias("n"))  # one row per column name
    wanted = F.explode(F.array(*[F.lit(float(f)) for f in fractions]))
    spots = total.select("name", "n", wanted.alias("fraction")).withColumn(
        "spot", F.col("fraction") * (F.col("n") - 1)
    )
    at = seen.join(F.broadcast(spots), "name")  # names x fractions rows
    low, high = F.floor("spot"), F.ceil("spot")
    covers = lambda i: (i >= F.col("upto") - F.col("c")) & (i < F.col("upto"))
    at = at.where(covers(low) | covers(high))
    return at.groupBy("name", "fraction", "spot").agg(
        F.max(F.when(covers(F.floor("spot")), F.col("value"))).alias("lo"),
        F.max(F.when(covers(F.ceil("spot")), F.col("value"))).alias("hi"),
    ).select(
        "name",
        "fraction",
        (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("spot") - F.floor("spot"))).alias("value"),
    )


def join_hot(left: DataFrame, right: DataFrame, on: Sequence[str], weight: str, parts: int = 1000) -> DataFrame:
    """Inner join on the unique keys of ``right``, where some keys may hold most of ``left``.

    ``weight`` says how many left rows a key has. Keys with more than 1/``parts``
    of all rows, of which there are fewer than ``parts``, are broadcast, so their
    rows stay where they are; the others are joined by a shuffle.
    """
    on = list(on)
    heavy = F.col(weight) * parts > right.agg(F.sum(weight)).scalar()
    hot = right.where(heavy).drop(weight)
    cold = right.where(~heavy).drop(weight)
    values = [c for c in hot.columns if c not in on]
    tagged = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    done = tagged.where("_hot").drop("_hot")
    rest = tagged.where("_hot is null").drop("_hot", *values).join(cold, on)
    return done.unionByName(rest)
