"""Quality rules: base counts, and a likelihood ratio of hashed n-grams.

Two multinomials over hashed character trigrams are counted: one over a trusted
target (documents labelled good), one over the raw corpus. A document's score
is the mean, over its trigrams, of log(target / raw), so long and short texts
compare. Every document is held against one fixed threshold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairlake.functions.draws import draw
from pairlake.llm.common import WORD, buckets, counts, first_by, fresh

BITS, SMOOTHING, THRESHOLD, MAX_TRUSTED, MIN_WORDS, SEED = 16, 0.5, -0.5, 20_000, 50, 42
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(text: str, find=re.compile(WORD).findall) -> tuple[int, int, int, int, int]:
    """``MEASURES`` of a whole text."""
    words = find(text)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, upto = Counter(windows), 0
        for at, window in enumerate(windows):
            if seen[window] > 1:
                repeated += at + 3 - max(upto, at)
                upto = at + 3
    lines, again = set(), 0
    for line in text.split("\n"):
        if line in lines:
            again += 1
        elif find(line):
            lines.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), again, repeated


def _gram_counts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_rows, trusted = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0), batch.column(1)):
                here = counts(text.as_py() or "", bits)
                all_rows += here
                if good.as_py():
                    trusted += here
        some = np.flatnonzero(all_rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(all_rows[some]), pa.array(trusted[some])], ["bucket", "raw", "target"]
        )

    return run


def fit(
    docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS,
    smoothing: float = SMOOTHING, max_trusted: int = MAX_TRUSTED, seed: int = SEED,
) -> np.ndarray:
    """log(target / raw) of each of the ``2**bits`` buckets.

    The raw counts cover all rows of ``docs``. The target is fitted on those
    rows whose key is in ``trusted`` (a table with the column ``key``), of which
    at most ``max_trusted`` distinct ones are taken, the first by a seeded hash;
    that bound makes their broadcast safe. Both are smoothed in proportion to
    their size, so a bucket that neither has says nothing. One pass; what comes
    to the driver are ``2**bits`` sums.
    """
    good, mark = fresh(docs, "_good", "_mark")
    ids = trusted.select(F.col(key).alias(good)).where(F.col(good).isNotNull()).distinct().withColumn("h", draw(seed, "trusted", good))
    ids = first_by(ids, "h", max_trusted, good).select(good, F.lit(True).alias(mark))
    marked = docs.join(F.broadcast(ids), F.col(key) == F.col(good), "left").select(text, mark)
    found = marked.mapInArrow(_gram_counts(bits), "bucket int, raw long, target long")
    sums = found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    for bucket, r, t in sums:
        raw[bucket], target[bucket] = r, t
    if not raw.sum() or not target.sum():
        return np.zeros(1 << bits)  # nothing to compare: no text is rejected by the ratio
    share = lambda c: (c + smoothing * c.sum() / len(c)) / (c.sum() * (1 + smoothing))
    return np.log(share(target)) - np.log(share(raw))


def measure(docs: DataFrame, ratios: np.ndarray, text: str = "text") -> Column:
    """A struct of ``MEASURES`` and ``score`` (0 for texts under three characters) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # 2**bits numbers
    bits = len(ratios).bit_length() - 1
    fields = ", ".join(f"{m} long" for m in MEASURES) + ", score double"

    @F.arrow_udf(fields)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = []
            for value in batch:
                whole = value.as_py() or ""
                total = sum(float(shared.value[block].sum()) for block in buckets(whole, bits))
                rows.append((*base_counts(whole), total / max(len(whole) - 2, 1)))
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64()] * 5 + [pa.float64()]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*MEASURES, "score"])

    return run(F.col(text))


def judge(
    docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
    ratios: np.ndarray | None = None, **options,
) -> DataFrame:
    """``docs`` with ``MEASURES``, ``score``, ``base_failed`` and ``kept`` (underscores put before names it has).

    ``base_failed``: fewer than 50 words, or more than half of them in repeated
    three-word windows. ``kept``: not base_failed, and score >= ``threshold``.
    Null texts count as empty; so these and blank ones fail. One row for each
    row given, repeated rows alike; null keys are never trusted. An empty table
    stays empty; without trusted rows the ratio rejects nothing.
    """
    ratios = fit(docs, trusted, key, text, **options) if ratios is None else ratios
    names = fresh(docs, *MEASURES, "score", "base_failed", "kept", "_m")
    m, given = names[-1], [F.col(f"`{c}`") for c in docs.columns]
    wide = docs.withColumn(m, measure(docs, ratios, text)).select(
        *given, *[F.col(m)[f].alias(n) for f, n in zip((*MEASURES, "score"), names)]
    )
    words, repeated, score, failed, kept = names[0], names[4], names[5], names[6], names[7]
    wide = wide.withColumn(failed, (F.col(words) < MIN_WORDS) | (100 * F.col(repeated) > 50 * F.col(words)))
    return wide.withColumn(kept, ~F.col(failed) & (F.col(score) >= threshold))
