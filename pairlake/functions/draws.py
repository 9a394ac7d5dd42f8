"""Reproducible random numbers: one seeded hash instead of a random generator.

Task retries, partition counts and engine versions do not change a draw, and
60 bits keep draws usable for corpora of many billions of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DRAW_BITS = 60


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def draw(seed: int, salt: str, *keys) -> Column:
    """A uniform integer in [0, 2**60) from seed, salt and key columns."""
    parts = [F.lit(str(seed)), F.lit(salt), *[_col(k).cast("string") for k in keys]]
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, DRAW_BITS // 4)
    return F.conv(digits, 16, 10).cast("bigint")


def share(drawn: Column, fraction: float) -> Column:
    """True for ``fraction`` of the draws, in steps of 1/10000, in integers only."""
    return F.pmod(drawn, F.lit(10000)) < F.lit(int(round(fraction * 10000)))


def unit(drawn: Column) -> Column:
    """The draw as a number strictly between 0 and 1."""
    return (drawn.cast("double") + F.lit(0.5)) / F.lit(float(1 << DRAW_BITS))


def step_past(drawn: Column, n: Column, *avoid: Column) -> Column:
    """A uniform rank in 0..n-1 that equals none of ``avoid`` (1 or 2, distinct).

    Draws in 0..n-k-1 and steps past the avoided ranks in ascending order.
    Fails where n <= k, since then no rank may be left.
    """
    k = len(avoid)
    safe = F.when(n > k, n - k).otherwise(
        F.raise_error(F.lit("not enough targets for the avoid list")).cast("bigint")
    )
    picked = F.pmod(drawn, safe)
    ordered = avoid if k == 1 else (F.least(*avoid), F.greatest(*avoid))
    for taken in ordered:
        picked = picked + F.when(picked >= taken, 1).otherwise(0)
    return picked
