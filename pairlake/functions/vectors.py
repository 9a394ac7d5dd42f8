"""Functions on vectors held as array columns (computed in double)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from pairlake.functions.bind import let


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def cosine01(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2, kept in [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine(a, b) + 1) / 2))


def l2_normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    scale = lambda size: F.transform(_double(v), lambda x: F.when(size > 0, x / size).otherwise(x))
    return let(norm(v), scale)


def to_label(score: Column, rule: str = "cosine") -> Column:
    """0/1 from a score. 'cosine': 0 below zero; 'round': half to even, so 0.5 gives 0."""
    if rule == "cosine":
        return F.when(score < 0, 0).otherwise(1)
    if rule == "round":
        return F.rint(score).cast("int")
    raise ValueError(f"unknown rule {rule!r}")


def softmax(v: Column) -> Column:
    powers = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return let(powers, lambda p: let(total(p), lambda t: F.transform(p, lambda x: x / t)))


# Fixed value: probabilities are kept away from 0 by this much.
FLOOR = 1e-7


def kl_divergence(p: Column, q: Column) -> Column:
    """Sum of p * ln(p / q), both kept in [1e-7, 1]."""
    keep = lambda x: F.greatest(F.lit(FLOOR), F.least(F.lit(1.0), x))
    return total(F.zip_with(_double(p), _double(q), lambda x, y: keep(x) * F.log(keep(x) / keep(y))))


def overlap_penalty(p: Column, q: Column, i: Column, j: Column) -> Column:
    """1 - divergence of two different filters; 0 for a filter with itself."""
    return F.when(i != j, 1 - kl_divergence(p, q)).otherwise(F.lit(0.0))


def sparse_cosine(a: Column, b: Column) -> Column:
    """Cosine of two sparse vectors, arrays of (id, n) without repeated ids; 0 where one is empty or null."""

    @F.arrow_udf("double")
    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for sides in pairs:
            flat = [(x.offsets.to_numpy(), x.values.field(0).to_numpy(), x.values.field(1).to_numpy().astype(np.float64)) for x in sides]
            out = np.zeros(len(sides[0]))
            for k in range(len(out)):
                (i, m), (j, n) = ((ids[at[k] : at[k + 1]], counts[at[k] : at[k + 1]]) for at, ids, counts in flat)
                _, p, q = np.intersect1d(i, j, True, return_indices=True)
                size = np.sqrt((m * m).sum() * (n * n).sum())
                out[k] = m[p] @ n[q] / size if size else 0.0
            yield pa.array(out)

    nothing = F.array().cast("array<struct<id: int, n: int>>")
    return run(F.coalesce(a, nothing), F.coalesce(b, nothing))
