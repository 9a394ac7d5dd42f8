"""Scores over positions, best segments, early stop, weighted choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairlake.functions.bind import let
from pairlake.functions.draws import draw, unit
from pairlake.functions.vectors import softmax


def window_score(seq: Column, kernel: Sequence[float]) -> Column:
    """Weighted sum around each position, zeros outside; an even kernel has its extra cell on the right."""
    left = (len(kernel) - 1) // 2

    def at(values: Column, i: Column) -> Column:
        terms = [
            F.lit(float(w)) * F.coalesce(F.get(values, i + (j - left)), F.lit(0)).cast("double")
            for j, w in enumerate(kernel) if w
        ]
        out = terms[0] if terms else F.lit(0.0)
        for term in terms[1:]:
            out = out + term
        return out

    return let(seq, lambda values: F.transform(values, lambda x, i: at(values, i)))


def peak(scores: Column) -> Column:
    """struct(top, at): the maximum and its first position (from 0)."""
    return let(scores, lambda v: let(F.array_max(v), lambda top: F.struct(
        top.alias("top"), (F.array_position(v, top) - 1).cast("int").alias("at"))))


def best_segments(seq: Column, peaks: Sequence[Column], length: int) -> Column:
    """``length`` items from each peak on, joined; a start near the end moves back, a
    sequence shorter than ``length`` repeats its last item."""

    def segment(values: Column, start: Column) -> Column:
        last = F.size(values) - 1
        first = F.least(start, F.greatest(F.size(values) - length, F.lit(0)))
        return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda o: F.get(values, F.least(first + o, last)))

    return let(seq, lambda values: F.concat(*[segment(values, p) for p in peaks]))


def select_segments(df: DataFrame, key: str, seq: str, kernels: Sequence[Sequence[float]], length: int) -> DataFrame:
    """(key, peaks, probs, selected): per kernel softmax over positions, its peak, the segments found.

    One row per sequence all the way: no explode and no shuffle.
    """
    soft = df.select(key, seq, *[softmax(window_score(F.col(seq), k)).alias(f"_s{i}") for i, k in enumerate(kernels)])
    tops = soft.select(key, seq, *[peak(F.col(f"_s{i}")).alias(f"_p{i}") for i in range(len(kernels))])
    at = [F.col(f"_p{i}.at") for i in range(len(kernels))]
    return tops.select(
        key, F.array(*at).alias("peaks"), F.array(*[F.col(f"_p{i}.top") for i in range(len(kernels))]).alias("probs"),
        best_segments(F.col(seq), at, length).alias("selected"),
    )


def early_stop(history: DataFrame, epoch: str, value: str, patience: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """(by.., best_epoch, best_value, stop_epoch): where training would stop and what it would restore.

    A stop comes ``patience`` epochs after the last improvement (-1: none). The
    window holds one series, as long as the number of epochs.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy(epoch)
    h = history.select(*by, epoch, value, (F.row_number().over(w) - 1).alias("_i"))
    h = h.withColumn("_before", F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    better = F.col("_before").isNull() | (F.col(value) < F.col("_before"))
    h = h.withColumn("_best", F.last(F.when(better, F.col("_i")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    h = h.withColumn("_stop", (F.col("_i") - F.col("_best")) >= patience)
    stops = h.withColumn("_first", F.min(F.when(F.col("_stop"), F.col("_i"))).over(Window.partitionBy(*by)))
    ran = stops.where(F.col("_first").isNull() | (F.col("_i") <= F.col("_first")))
    best = F.min(F.struct(F.col(value).alias("v"), F.col("_i").alias("i"), F.col(epoch).alias("e")))
    return ran.groupBy(*by).agg(best.alias("b"), F.max(F.when(F.col("_stop"), F.col(epoch))).alias("s")).select(
        *by, F.col("b.e").alias("best_epoch"), F.col("b.v").alias("best_value"), F.col("s").alias("stop_epoch")
    )


def gumbel(drawn: Column) -> Column:
    return -F.log(-F.log(unit(drawn)))


def gumbel_sample(df: DataFrame, key: str, weight: str, k: int, seed: int) -> DataFrame:
    """k rows drawn without replacement, with chances given by ``weight`` (a distributed top-k)."""
    positive = df.where(F.col(weight) > 0)
    score = F.log(F.col(weight).cast("double")) + gumbel(draw(seed, "gumbel", key))
    return positive.withColumn("score", score).orderBy(F.desc("score"), key).limit(k)


def gumbel_softmax(logits: Column, seed: int, *keys, temperature: float = 1.0) -> Column:
    """Logits with noise, as a tempered softmax."""
    noisy = F.transform(logits, lambda x, i: (x.cast("double") + gumbel(draw(seed, "soft", *keys, i))) / temperature)
    return softmax(noisy)
