"""Texts compressed one by one, as they travel through shuffles.

The codec of the shuffle sees blocks of some 32 KB and is made for speed; short texts
packed each by zstd take some two thirds of what it leaves of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, functions as F

LEVEL = 3


def packed(text: Column) -> Column:
    """A text as packed bytes, the same for equal texts; null for null."""

    @F.arrow_udf("binary")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        press = zstandard.ZstdCompressor(LEVEL).compress
        for batch in parts:
            yield pa.array([None if v is None else press(v) for v in batch.cast(pa.binary()).to_pylist()], pa.binary())

    return run(text)


def greatest_unpacked(packs: Column) -> Column:
    """The greatest of an array of packed texts, by their bytes as ``max`` has it; null for an empty or null array."""

    @F.arrow_udf("string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in parts:
            texts = [max(map(unpack, found)) if found else None for found in batch.to_pylist()]
            yield pa.array(texts, pa.binary()).view(pa.string())

    return run(packs)
