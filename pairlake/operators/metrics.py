"""Binary classification metrics over (score, label) tables, per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pairlake.functions.vectors import total
from pairlake.operators.ranks import running

# Added to denominators, clipping of scores, added inside the logarithm.
EPS = 1e-5
CLIP = 1e-7
LOG_EPS = 1e-10


def _counts(label: Column, predicted: Column) -> list[Column]:
    cell = lambda l, p: F.count_if((label == l) & (predicted == p))
    return [cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn")]


def confusion(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """(by.., tp, fp, fn, tn)"""
    return df.groupBy(*by).agg(*_counts(F.col(label), F.col(predicted)))


def classification_metrics(cm: DataFrame) -> DataFrame:
    """Accuracy in percent, precision, recall and F1 with 1e-5 in each denominator."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    p, r = F.col("precision"), F.col("recall")
    return (
        cm.withColumn("accuracy", F.try_divide(100 * (tp + tn), tp + fp + fn + tn))
        .withColumn("precision", tp / (tp + fp + EPS))
        .withColumn("recall", tp / (tp + fn + EPS))
        .withColumn("f1", 2 * p * r / (p + r + EPS))
    )


def by_score(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by.., s, p, c, upto): per distinct score its positives, its rows, and the rows up to it.

    All metrics of this module follow from this table, so the scored rows are
    computed once. Rows are added up per score before they are ranked by running
    counts over range partitions, so neither many copies of one score nor a
    crowded score range ends in one task.
    """
    by = list(by)
    counts = df.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.count("*").alias("c"))
    return running(counts, ["s"], {"upto": F.col("c")}, by=by)


def _auc() -> Column:
    """Aggregate over ``by_score``: exact area with ties averaged; null if a class is missing."""
    twice_rank = (2 * F.col("upto") - F.col("c") + 1).cast("double")
    ranks, pos = F.sum(F.col("p") * twice_rank) / 2, F.sum("p").cast("double")
    return F.try_divide(ranks - pos * (pos + 1) / 2, pos * (F.sum("c").cast("double") - pos))


def _cells(predicted: Column) -> list[Column]:
    """Aggregates over ``by_score``: the four counts."""
    hit = lambda on, n: F.coalesce(F.sum(F.when(predicted == on, n)), F.lit(0)).cast("bigint")
    pos, neg = F.col("p"), F.col("c") - F.col("p")
    return [hit(1, pos).alias("tp"), hit(1, neg).alias("fp"), hit(0, pos).alias("fn"), hit(0, neg).alias("tn")]


def _loss() -> Column:
    """Aggregate over ``by_score``: the cross-entropy of ``bce``."""
    s = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), F.col("s")))
    known = F.when(F.col("s").isNotNull(), F.col("c"))
    return -F.sum(F.col("p") * F.log(s) + (F.col("c") - F.col("p")) * F.log(1 - s)) / F.sum(known)


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by.., auc): exact area with ties averaged; null if a class is missing."""
    return by_score(df, score, label, by).groupBy(*by).agg(_auc().alias("auc"))


def evaluate(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by.., tp, fp, fn, tn, accuracy, precision, recall, f1, loss, auc); predicted by rounding, half to even."""
    sums = by_score(df, score, label, by).groupBy(*by).agg(*_cells(F.rint("s")), _loss().alias("loss"), _auc().alias("auc"))
    order = [*by, "tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1", "loss", "auc"]
    return classification_metrics(sums).select(*order)


def bce(score: Column, label: Column) -> Column:
    """Aggregate: binary cross-entropy of scores kept in [1e-7, 1 - 1e-7]."""
    p = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), score))
    return -F.avg(label * F.log(p) + (1 - label) * F.log(1 - p))


def threshold_metrics(df: DataFrame, score: str, label: str, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """(by.., accuracy, precision, recall, loss, auc); predicted positive above the threshold."""
    by = list(by)
    above = (F.col("s") > threshold).cast("int")
    sums = by_score(df, score, label, by).groupBy(*by).agg(*_cells(above), _loss().alias("loss"), _auc().alias("auc"))
    zero = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    return sums.select(
        *by, F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"),
        zero("tp", "fp").alias("precision"), zero("tp", "fn").alias("recall"), "loss", "auc",
    )


def reward(score: Column, label: Column) -> Column:
    """+1 where the rounded score (half to even) is the label, else -1."""
    return F.when(F.rint(score) == label, 1.0).otherwise(-1.0)


def likelihood_loss(score: Column, label: Column, probs: Column) -> Column:
    """Aggregate: mean over rows of the reward-weighted sum of -ln(p + 1e-10)."""
    row = total(F.transform(probs, lambda p: -F.log(p.cast("double") + LOG_EPS)))
    return F.avg(row * reward(score, label))


# Weights of cross-entropy, likelihood and overlap terms.
LOSS_WEIGHTS = (0.2, 0.8, 0.4)


def weighted_loss(score: Column, label: Column, probs: Column, overlap: Column | None = None) -> Column:
    """Aggregate: the composite loss; the overlap term is its mean square (target 0)."""
    out = LOSS_WEIGHTS[0] * bce(score, label) + LOSS_WEIGHTS[1] * likelihood_loss(score, label, probs)
    return out if overlap is None else out + LOSS_WEIGHTS[2] * F.avg(overlap * overlap)
