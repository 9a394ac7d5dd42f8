"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairlake.functions.draws import DRAW_BITS

#: Blanks of the word rule, and the word rule itself.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names that ``df`` does not have yet, whatever the case: ``wanted`` with underscores put before."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_text(key: str, text: str) -> Column:
    """What tells rows apart in hashes: the key, and the digest of the text. Null and absent differ from empty."""
    shown = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    return F.concat_ws("|", shown(F.col(key)), F.md5(shown(F.col(text))))


def first_by(df: DataFrame, order: str, size: int, *ties: str, bits: int = 12) -> DataFrame:
    """The first ``size`` rows by the 60-bit hash in column ``order``, then by ``ties``.

    Rows are counted by the leading bits of the hash, and by further bits where
    they are still too many, to find a bound that few more than ``size`` rows
    meet; so no task gathers the first rows of all others. To the driver come
    ``2**bits`` counts at a time.
    """
    low, shift, wanted = 0, DRAW_BITS, size
    while True:
        shift = max(0, shift - bits)
        here = df.where(F.col(order) >= low).where(F.shiftright(order, shift) < (low >> shift) + (1 << bits))
        counts = sorted(map(tuple, here.groupBy(F.shiftright(order, shift).alias("b")).agg(F.count("*").alias("c")).collect()))
        last, seen = None, 0
        for last, c in counts:
            seen += c
            if seen >= wanted:
                break
        if last is None:
            return df.limit(0) if low == 0 else df.where(F.col(order) < low)
        bound = (last + 1) << shift
        if shift == 0 or c <= 4 * size or seen < wanted:
            return df.where(F.col(order) < bound).orderBy(order, *ties).limit(size)
        wanted -= seen - c
        low = last << shift


def buckets(text: str, bits: int, step: int = 1 << 20) -> Iterator[np.ndarray]:
    """Hashed character trigrams of a whole text, in blocks of bounded memory; shorter texts have none.

    A block overlaps the one before by two characters, so every trigram comes up once.
    """
    for at in range(0, max(len(text) - 2, 0), step):
        codes = np.frombuffer(text[at : at + step + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        mixed = (codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1]) * np.uint32(0x85EBCA6B) + codes[2:]
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35)
        yield mixed >> np.uint32(32 - bits)


def counts(text: str, bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, np.int64)
    for block in buckets(text, bits):
        out += np.bincount(block, minlength=1 << bits)
    return out
