"""A trained table of token vectors: co-occurrence counts and a randomised factorisation, by joins and aggregation.

Tokens that stand near each other are counted; the positive pointwise mutual
information of the counts is a sparse symmetric matrix. Its leading part is found
by products with a few random columns (Halko, Martinsson and Tropp, 2011): a product
is a join and a sum per row, an orthonormal basis needs the columns' inner
products only, which are as many as columns squared whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pairlake.functions.draws import draw
from pairlake.session import cut

WINDOW, DIM, EXTRA, ROUNDS = 4, 16, 8, 2
#: Tokens that the dictionary of a task may have.
MAX_TOKENS = 1_000_000


def cooccurrence(df: DataFrame, tokens: str, vocab: DataFrame, window: int = WINDOW, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(a, b, n): how often the tokens with the ids a and b stand at most ``window`` places apart, each order counted.

    ``tokens`` is an array column, ``vocab`` has (token, id). Unknown tokens are not counted but keep
    their places. Counts are added up before the shuffle, and there are at most as many as pairs of ids.
    """
    known = {r["token"]: r["id"] for r in vocab.select("token", "id").limit(max_tokens + 1).collect()}
    if len(known) > max_tokens:
        raise ValueError(f"the vocabulary has more than {max_tokens} tokens")

    # looked up in Arrow, so that a batch of whole texts makes no Python strings
    names = pa.array(list(known), pa.string())
    places = np.array([*known.values(), -1], np.int32)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = batch.value_lengths().fill_null(0).to_numpy()
            at = pc.index_in(batch.flatten(), names).fill_null(len(names)).to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(places[at]))

    near = df.select(ids(F.col(tokens)).alias("i"), F.explode(F.sequence(F.lit(1), F.lit(window))).alias("o")).where("size(i) > o")
    pairs = near.select(F.explode(F.arrays_zip(F.expr("slice(i, 1, size(i) - o)").alias("a"), F.expr("slice(i, 1 + o, size(i) - o)").alias("b"))).alias("p"))
    one = pairs.where("p.a >= 0 and p.b >= 0").groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    return both.groupBy("a", "b").agg(F.sum("n").alias("n"))


def information(counts: DataFrame) -> DataFrame:
    """(a, b, v): positive pointwise mutual information of symmetric counts; what is not above 0 is left out."""
    each = counts.groupBy("a").agg(F.sum("n").alias("na"))
    whole = float(counts.agg(F.sum("n")).first()[0] or 0)
    met = counts.join(each, "a").join(each.withColumnsRenamed({"a": "b", "na": "nb"}), "b")
    value = F.log(F.col("n") * F.lit(whole) / (F.col("na") * F.col("nb")))
    return met.select("a", "b", value.alias("v")).where("v > 0")


def _times(matrix: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(id, vec): the product of (a, b, v) with rows (id, vec)."""
    met = matrix.join(vectors.withColumnRenamed("id", "b"), "b")
    sums = met.groupBy("a").agg(*[F.sum(F.col("v") * F.get("vec", F.lit(k))).alias(f"_{k}") for k in range(dim)])
    return sums.select(F.col("a").alias("id"), F.array(*[f"_{k}" for k in range(dim)]).alias("vec"))


def _inner(rows: DataFrame, left: str, right: str, dim: int) -> np.ndarray:
    """The sum of the outer products of two vector columns: a square of ``dim``, added up in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x, y = (np.asarray(c.values).reshape(-1, dim) for c in batch.columns)
                total += x.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["k", "s"])

    sums = rows.select(left, right).mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(dim * dim)
    for r in sums:
        out[r["k"]] = r["s"]
    return out.reshape(dim, dim)


def _changed(rows: DataFrame, change: np.ndarray) -> DataFrame:
    """(id, vec) with each vector times a small matrix."""
    columns = [F.aggregate(F.zip_with("vec", F.array(*[F.lit(float(x)) for x in c]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for c in change.T]
    return rows.select("id", F.array(*columns).alias("vec"))


def _basis(rows: DataFrame, dim: int) -> DataFrame:
    """The same space with orthonormal columns; directions without weight become 0."""
    weight, turn = np.linalg.eigh(_inner(rows.withColumn("other", F.col("vec")), "vec", "other", dim))
    scale = np.where(weight > 1e-10 * max(weight.max(), 1e-300), 1 / np.sqrt(np.maximum(weight, 1e-300)), 0.0)
    return cut(_changed(rows, turn * scale))


def random_columns(ids: DataFrame, dim: int, seed: int) -> DataFrame:
    """(id, vec): seeded columns between -1 and 1, by hash."""
    one = lambda k: (F.pmod(draw(seed, f"column{k}", "id"), F.lit(2_000_001)) - 1_000_000) / F.lit(1_000_000.0)
    return ids.select("id", F.array(*[one(k) for k in range(dim)]).alias("vec"))


def factorise(matrix: DataFrame, dim: int = DIM, extra: int = EXTRA, rounds: int = ROUNDS, seed: int = 42) -> DataFrame:
    """(id, vec): for each row of a symmetric matrix (a, b, v) its place along the ``dim`` strongest directions, times the root of their strength.

    ``extra`` columns and ``rounds`` of powers make the found directions better.
    Signs are fixed: the direction's largest inner weight is positive. An empty matrix gives no rows.
    """
    wide = dim + extra
    matrix = cut(matrix)
    basis = _basis(cut(_times(matrix, random_columns(matrix.select(F.col("a").alias("id")).distinct(), wide, seed), wide)), wide)
    for _ in range(rounds):
        basis = _basis(cut(_times(matrix, basis, wide)), wide)
    made = _times(matrix, basis, wide).withColumnRenamed("vec", "made")
    small = _inner(basis.join(made, "id"), "vec", "made", wide)
    weight, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(weight), kind="stable")[:dim]
    turn = turn[:, order] * np.sign(turn[np.abs(turn[:, order]).argmax(0), order])
    return _changed(basis, turn * np.sqrt(np.abs(weight[order])))


def train_table(
    df: DataFrame, tokens: str, vocab: DataFrame, dim: int = DIM, window: int = WINDOW, extra: int = EXTRA, rounds: int = ROUNDS, seed: int = 42
) -> DataFrame:
    """(token, vec): a trained table for ``vocab.embed``. Tokens that stand beside no known one have no vector."""
    made = factorise(information(cut(cooccurrence(df, tokens, vocab, window))), dim, extra, rounds, seed)
    return vocab.select("token", "id").join(made, "id").select("token", "vec")

