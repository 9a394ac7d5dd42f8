"""Quality classifier: votes of the nearest labelled documents in a latent space.

Texts become hashed character trigrams, damped, weighted by rarity and
projected on the leading singular directions of the labelled sample (latent
semantic vectors). The sample's vectors are broadcast. Every document gets its
exact cosine with all of them, in blocks, and its score is the mean label of
the nearest, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairlake.functions.draws import draw
from pairlake.llm.common import counts, first_by

BITS, DIMENSIONS, SAMPLE, NEIGHBOURS, SHARPNESS, BLOCK, SEED = 11, 48, 2000, 15, 4, 256, 42


def _damped(text: str, bits: int) -> np.ndarray:
    return np.log1p(counts(text, bits)).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


@dataclass
class Model:
    """What is broadcast: bounded by the sample size, the buckets and the dimensions."""

    bits: int
    rarity: np.ndarray
    directions: np.ndarray  # buckets x dimensions
    vectors: np.ndarray  # sample x dimensions, of length 1 or 0
    labels: np.ndarray
    neighbours: int
    prior: float

    def project(self, damped: np.ndarray) -> np.ndarray:
        return _unit(_unit(damped * self.rarity) @ self.directions)

    def score(self, damped: np.ndarray) -> np.ndarray:
        """Weighted votes of a block of documents; the prior where nothing is similar."""
        if not len(self.labels):
            return np.full(len(damped), self.prior)
        near = np.round((self.project(damped) @ self.vectors.T).astype(np.float64), 5)
        k = min(self.neighbours, len(self.labels))
        # ties go to the earlier sample row; keys are distinct, so the choice is exact
        keys = np.round(near * 1e5).astype(np.int64) * len(self.labels) - np.arange(len(self.labels))
        chosen = np.argpartition(-keys, k - 1, axis=1)[:, :k]
        chosen.sort(axis=1)
        weights = np.maximum(np.take_along_axis(near, chosen, 1), 0) ** SHARPNESS
        total = weights.sum(1)
        votes = (weights * self.labels[chosen]).sum(1)
        return np.where(total > 0, votes / np.where(total > 0, total, 1), self.prior)


def _features(bits: int):
    @F.arrow_udf("binary")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([_damped(t.as_py() or "", bits).astype(np.float16).tobytes() for t in batch], pa.binary())

    return run


def fit(
    labelled: DataFrame, text: str = "text", label: str = "label", order: str = "doc_id", bits: int = BITS,
    dimensions: int = DIMENSIONS, sample: int = SAMPLE, neighbours: int = NEIGHBOURS, seed: int = SEED,
) -> Model:
    """The model of a bounded sample of (text, label 0 or 1).

    ``sample`` rows at most, half of them of each label, the first by a seeded
    hash of ``order``; so a rare label gets an equal say. Other labels and null
    ones are left out, null texts count as empty.
    """
    kinds = [
        labelled.where(F.col(label) == k).orderBy(draw(seed, "sample", order), F.col(order)).limit(sample // 2) for k in (0, 1)
    ]
    chosen = kinds[0].unionByName(kinds[1])
    # at most ``sample`` rows of 2**(bits + 1) bytes
    rows = chosen.select(F.col(order), F.col(label).cast("int"), _features(bits)(F.col(text))).collect()
    rows.sort(key=lambda r: (r[1], str(r[0]), r[2]))
    labels = np.array([r[1] for r in rows], np.float64)
    damped = np.array([np.frombuffer(r[2], np.float16) for r in rows], np.float32).reshape(len(rows), 1 << bits)
    rarity = np.log((1 + len(rows)) / (1 + (damped > 0).sum(0))).astype(np.float32) + np.float32(1)
    weighted = _unit(damped * rarity)
    directions = np.zeros((1 << bits, dimensions), np.float32)
    if len(rows):
        values, found = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
        best = np.argsort(-values)[:dimensions]
        directions[:, : len(best)] = found[:, best]
    model = Model(bits, rarity, directions, np.zeros((0, dimensions), np.float32), labels, neighbours,
                  float(labels.mean()) if len(rows) else 0.5)
    model.vectors = model.project(damped)
    return model


def scored(docs: DataFrame, model: Model, text: str = "text", block: int = BLOCK) -> Column:
    """The score of each whole text, 0 to 1; of an empty or null one the model's prior."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain arrays: workers need not have this package

    @F.arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Model(**shared.value)
        for batch in texts:
            parts = [
                known.score(np.array([_damped(t.as_py() or "", known.bits) for t in batch[at : at + block]]))
                for at in range(0, len(batch), block)
            ]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return run(F.col(text))


def held_out(key: str) -> Column:
    """True for the fold that is never learnt from: crc32 of the key as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(3)) == 1, F.lit(False))


def classify(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", model: Model | None = None,
    **options,
) -> DataFrame:
    """(key, held_out, score, predicted) for each row of ``docs``.

    Learns from rows of ``labels`` outside the held-out fold; a null key is in
    no fold and has no label. ``predicted`` is 1 from a score of 0.5. Repeated
    rows get equal scores. Without any label every score is 0.5. Only ``key``
    and ``text`` are read, so other columns do not matter.
    """
    if model is None:
        own = labels.where(~held_out(key)).select(F.col(key).alias("_key"), F.col(label).alias("_label"))
        own = own.where("_label is not null").distinct()
        limit = options.get("sample", SAMPLE) // 2
        seed = options.get("seed", SEED)
        # the sample is bounded before the texts are touched; twice the size, as some keys may have no text
        own = own.withColumn("_h", draw(seed, "sample", "_key"))
        kinds = [first_by(own.where(F.col("_label") == k), "_h", 2 * limit, "_key").drop("_h") for k in (0, 1)]
        few = F.broadcast(kinds[0].unionByName(kinds[1]))
        labelled = docs.select(F.col(key).alias("_k"), F.col(text).alias("_text")).join(few, F.col("_k") == F.col("_key"))
        model = fit(labelled, "_text", "_label", "_key", **options)
    out = docs.select(F.col(key), held_out(key).alias("held_out"), scored(docs, model, text).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
