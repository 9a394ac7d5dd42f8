"""Pair classifiers from distributed features, evaluation, storage, pluggable encoders."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pairlake.functions.edit import string_distance
from pairlake.functions.lexing import compared, lexed_lines, no_size, token_counts
from pairlake.functions.rewriting import md5
from pairlake.functions.text import truncate
from pairlake.functions.vectors import FLOOR, cosine01, sparse_cosine
from pairlake.operators import metrics as M
from pairlake.operators.vocab import known_ids
from pairlake.sources.cells import append_history

FEATURES = ("size_ratio", "class_cosine", "overlap", "containment", "token_delta", "size_delta")
LETTERS = "ndsacbeihu.,;:()[]{}?*&|%@#"


def pair_features(
    pairs: DataFrame, seed: str = "seed_text", target: str = "target_text", vocab: DataFrame | None = None,
    corpus: DataFrame | None = None, seed_id: str = "seed_id", lexed: bool = False,
) -> DataFrame:
    """The pair columns (without the texts) plus the numeric features; the texts take one narrow stage.

    With ``vocab`` (token, id) there is ``tf_cosine`` as well, the cosine of the counts of
    its tokens. ``corpus`` (seed_id, text) gives the seed documents, so that their counts are
    made once per document and joined; else they are made per pair. ``lexed``: the texts, those of
    ``corpus`` too, are in the form of ``lexing.lexed_lines``, made once per document.
    """
    keep = [c for c in pairs.columns if c not in (seed, target)]
    if not lexed:
        pairs = pairs.withColumns({c: lexed_lines(F.col(c)) for c in (seed, target)})
    counts = []
    if vocab is not None:
        ids = known_ids(vocab)
        counts = [token_counts(F.col(target), ids).alias("_t"), *([token_counts(F.col(seed), ids).alias("_v")] if corpus is None else [])]
    met = pairs.select(*keep, *counts, compared(F.col(seed), F.col(target), LETTERS).alias("_c"))
    own, shared, either = [F.coalesce(f"_c.{c}", no_size()) for c in ("own", "shared", "either")]
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    n, m = F.length("_c.a"), F.length("_c.b")
    made = met.select(
        *[c for c in met.columns if c != "_c"], ratio(F.least(n, m), F.greatest(n, m)).alias("size_ratio"),
        cosine01(F.col("_c.ca"), F.col("_c.cb")).alias("class_cosine"),
        ratio(shared, either).alias("overlap"), ratio(shared, own).alias("containment"),
        ratio(string_distance(F.col("_c.a"), F.col("_c.b")), F.greatest(n, m)).alias("token_delta"), ratio(F.abs(n - m), n).alias("size_delta"),
    )
    if vocab is None:
        return made
    if corpus is not None:
        # texts are done with, so numbers only meet the counts; plain arrays of them are a quarter of an array of structs
        texts = corpus.toDF(seed_id, seed)
        texts = texts if lexed else texts.withColumn(seed, lexed_lines(F.col(seed)))
        flat = lambda df, c: df.withColumns({f"{c}_id": F.col(f"{c}.id"), f"{c}_n": F.col(f"{c}.n")}).drop(c)
        back = lambda c: F.arrays_zip(F.col(f"{c}_id").alias("id"), F.col(f"{c}_n").alias("n"))
        made = flat(made, "_t").join(flat(texts.select(seed_id, token_counts(F.col(seed), ids).alias("_v")), "_v"), seed_id, "left")
        made = made.withColumns({c: back(c) for c in ("_t", "_v")})
    return made.select(*keep, sparse_cosine(F.col("_v"), F.col("_t")).alias("tf_cosine"), *FEATURES)


def _stages(classifier) -> list:
    return [
        VectorAssembler(inputCols=list(FEATURES), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        classifier,
    ]


# Model registry: name -> stages from keyword arguments. A model may replace any stage.
MODELS: dict[str, Callable[..., list]] = {
    "logistic": lambda **kw: _stages(LogisticRegression(**{"maxIter": 20, "regParam": 0.01, **kw})),
    "forest": lambda **kw: _stages(RandomForestClassifier(**{"numTrees": 20, "maxDepth": 5, "seed": 42, **kw})),
}


def parse_arguments(text: str | None) -> dict:
    """Model arguments from JSON; anything unreadable gives none."""
    try:
        out = json.loads(text or "")
    except ValueError:
        return {}
    return out if isinstance(out, dict) else {}


def train(features: DataFrame, model: str = "logistic", arguments: str | None = None) -> PipelineModel:
    """Fits a registered model on (features.., label)."""
    return Pipeline(stages=MODELS[model](**parse_arguments(arguments))).fit(features)


def score(model: PipelineModel, features: DataFrame) -> DataFrame:
    """The rows with ``score``, the chance of label 1."""
    kept = features.columns
    return model.transform(features).select(*kept, F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def evaluate(scored: DataFrame, by: Sequence[str] = ("stage",)) -> DataFrame:
    """Counts, accuracy in percent, precision, recall, F1, loss and AUC per group."""
    return M.evaluate(scored, "score", "label", by)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ---- training that stops --------------------------------------------------


@dataclass
class Stopped:
    """A logistic model of the best epoch: weights of the standardised features, the last one for the constant."""

    columns: list[str]
    means: np.ndarray
    scales: np.ndarray
    weights: np.ndarray
    best_epoch: int
    epochs: int

    def score(self) -> Column:
        """The chance of label 1."""
        z = F.lit(float(self.weights[-1]))
        for c, m, s, w in zip(self.columns, self.means.tolist(), self.scales.tolist(), self.weights.tolist()):
            z = z + (F.col(c) - m) / s * w
        return 1 / (1 + F.exp(-z))


def _gradients(dim: int, means: np.ndarray, scales: np.ndarray, weights: np.ndarray) -> Callable:
    """Rows (training, label, features..) to (training, k, s): per task the sums of gradients, of the losses, and the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, dim + 3))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]], 1)
            x = np.concatenate([(x - means) / scales, np.ones((len(x), 1))], 1)
            y, side = batch.column(1).to_numpy(zero_copy_only=False).astype(float), batch.column(0).to_numpy(zero_copy_only=False).astype(int)
            p = 1 / (1 + np.exp(-(x @ weights)))
            kept = np.clip(p, FLOOR, 1 - FLOOR)
            loss = -(y * np.log(kept) + (1 - y) * np.log(1 - kept))
            for k in range(2):
                here = side == k
                total[k] += [*((p - y)[here] @ x[here]), loss[here].sum(), here.sum()]
        places = np.arange(2 * (dim + 3))
        yield pa.RecordBatch.from_arrays([pa.array(places // (dim + 3)), pa.array(places % (dim + 3)), pa.array(total.ravel())], ["training", "k", "s"])

    return run


def train_until(
    features: DataFrame, columns: Sequence[str], history: str, training: Column, epochs: int = 20, patience: int = 30, rate: float = 1.0,
    label: str = "label",
) -> Stopped:
    """A logistic model by gradient descent over a stored table, with the weights of the best epoch.

    ``training`` tells the rows to learn from; all others are for validation. After each
    epoch the losses of both go to ``history`` (epoch, train_loss, validation_loss), and the
    training stops ``patience`` epochs after the last improvement of the validation loss. An epoch is one
    pass: gradients are added up in tasks, and to the driver come as many numbers as there are features.
    """
    spark, columns = features.sparkSession, list(columns)
    rows = features.select(training.cast("int").alias("_training"), F.col(label).cast("double").alias("_label"), *[F.col(c).cast("double") for c in columns])
    shown = rows.where("_training = 1").agg(*[f(c).alias(f"{n}{k}") for k, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    means, scales = (np.array([shown[f"{n}{k}"] for k in range(len(columns))], float) for n in "ms")
    scales = np.where(scales > 0, scales, 1.0)
    weights, best, kept, gradient = np.zeros(len(columns) + 1), np.inf, None, None
    for epoch in range(epochs + 1):
        if epoch:
            weights = weights - rate * gradient
        sums = np.zeros((2, len(columns) + 3))
        made = rows.mapInArrow(_gradients(len(columns), means, scales, weights), "training long, k long, s double")
        for r in made.groupBy("training", "k").agg(F.sum("s").alias("s")).collect():
            sums[r["training"], r["k"]] = r["s"]
        gradient = sums[1, :-2] / max(sums[1, -1], 1)
        if not epoch:
            continue  # the first pass gives the first step
        losses = [float(sums[k, -2] / max(sums[k, -1], 1)) for k in (1, 0)]
        append_history(spark.createDataFrame([(epoch, *losses)], "epoch int, train_loss double, validation_loss double"), history)
        if losses[1] < best:
            best, kept = losses[1], (epoch, weights)
        elif epoch - kept[0] >= patience:
            break
    return Stopped(columns, means, scales, kept[1], kept[0], epoch)


# ---- pluggable encoders ---------------------------------------------------

# The JVM's rule for blanks.
WORDS = re.compile(r"[^ \t\n\x0b\f\r]+")

Encoder = Callable[[Sequence[str]], np.ndarray]


#: Words whose bucket and sign a task remembers.
REMEMBERED = 200_000


class _Codes(dict):
    """Word to bucket, plus ``dim`` where the sign is negative; remembered up to a bound."""

    def __init__(self, dim: int, most: int = REMEMBERED):
        super().__init__()
        self.dim, self.most = dim, most

    def __missing__(self, word: str) -> int:
        code = int.from_bytes(md5(word.encode()).digest()[:8])  # 15 hex digits for the bucket, one for the sign
        if len(self) >= self.most:
            self.clear()
        found = self[word] = (code >> 4) % self.dim + (0 if code & 15 < 8 else self.dim)
        return found


#: Bytes of vectors of lines that a task remembers, and the length up to which it does.
LINES_REMEMBERED, LINE = 8 << 20, 4096


class _Lines(dict):
    """Line to its counts in ``dim`` signed buckets; remembered up to a bound."""

    def __init__(self, dim: int):
        super().__init__()
        self.codes, self.most = _Codes(dim), LINES_REMEMBERED // (8 * dim) + 1

    def __missing__(self, line: str) -> np.ndarray:
        dim = self.codes.dim
        signed = np.bincount(np.fromiter(map(self.codes.__getitem__, WORDS.findall(line)), np.int64), minlength=2 * dim)
        found = (signed[:dim] - signed[dim:]).astype(float)
        if len(line) <= LINE:
            if len(self) >= self.most:
                self.clear()
            self[line] = found
        return found


def hashing_encoder(dim: int = 256) -> Encoder:
    """Token counts in ``dim`` signed hash buckets: the default encoder.

    No word spans a line, and the texts made of one pair are made of the same lines, so a text's vector is the sum of those of its lines.
    """
    lines = _Lines(dim)

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            for vector in map(lines.__getitem__, text.split("\n")):
                row += vector
        return out

    return encode


def _encode_distinct(encode: Encoder, texts: list[str]) -> np.ndarray:
    """The vectors of the texts; equal ones are encoded once."""
    places = {text: k for k, text in enumerate(dict.fromkeys(texts))}
    return encode(list(places))[[places[text] for text in texts]]


def score_pairs(
    pairs: DataFrame, make_encoder: Callable[[], Encoder] = hashing_encoder,
    seed: str = "seed_text", target: str = "target_text", max_length: int | None = None,
) -> DataFrame:
    """The pair columns (without the texts) with cosine, score and pred from a text encoder.

    The encoder is made once per task and fed the distinct texts of Arrow batches. Texts are
    taken whole; ``max_length`` cuts them, for an encoder with a fixed context.
    """
    keep = [f for f in pairs.schema.fields if f.name not in (seed, target)]
    if max_length is not None:
        pairs = pairs.withColumn(seed, truncate(F.col(seed), max_length)).withColumn(target, truncate(F.col(target), max_length))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for batch in batches:
            if batch.empty:
                continue
            a, b = (_encode_distinct(encode, batch[c].tolist()) for c in (seed, target))
            size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
            dots = (a * b).sum(axis=1)
            batch["cosine"] = np.divide(dots, size, out=np.zeros(len(size)), where=size > 0)
            yield batch.drop(columns=[seed, target])

    schema = T.StructType([*keep, T.StructField("cosine", T.DoubleType())])
    order = [f.name for f in keep]
    scored = pairs.select(*order, seed, target).mapInPandas(run, schema)
    return scored.withColumn("score", (F.col("cosine") + 1) / 2).withColumn("pred", F.when(F.col("cosine") < 0, 0).otherwise(1))
