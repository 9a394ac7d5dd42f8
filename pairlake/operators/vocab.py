"""Vocabulary, padded id sequences, batches, pooled embeddings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pairlake.operators.ranks import shuffled_rank

# Vocabulary size including the two reserved ids, and those ids.
MAX_TOKENS = 2500
PAD, UNKNOWN = 0, 1


def words(text: Column) -> Column:
    """Blank-separated tokens as they are (no case folding)."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def fit_vocab(df: DataFrame, columns: Sequence[str], max_tokens: int = MAX_TOKENS, weight: str | None = None) -> DataFrame:
    """(token, id, freq): the most frequent tokens of all columns, ties by token, ids from 2.

    Counts are added up map-side before the shuffle, so a token found
    everywhere costs one row per task. ``weight`` counts a row several times.
    """
    many = F.col(weight) if weight else F.lit(1)
    both = df.select(many.cast("bigint").alias("_w"), F.explode(F.concat(*[words(F.col(c)) for c in columns])).alias("token"))
    top = both.groupBy("token").agg(F.sum("_w").alias("freq")).orderBy(F.desc("freq"), "token").limit(max_tokens - 2)
    # at most max_tokens - 2 rows reach this window
    place = F.row_number().over(Window.orderBy(F.desc("freq"), "token"))
    return top.select("token", (place + 1).cast("int").alias("id"), "freq")


def encode(df: DataFrame, key: str, text: str, vocab: DataFrame, n: int, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(key, ids ARRAY of n, length): unknown = 1, cut or padded with 0 to n.

    The vocabulary, whose size is checked, goes to the tasks as a dictionary and
    each text is looked up where it is: no token table, no shuffle. (A map column
    would be searched entry by entry for each token.)
    """
    known = known_ids(vocab, max_tokens)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def look_up(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: [known.get(w, UNKNOWN) for w in t] if t is not None else [])

    # cut by ``words``, as the vocabulary was
    whole = df.select(key, look_up(F.slice(words(F.col(text)), F.lit(1), F.lit(n))).alias("ids"))
    return whole.select(key, pad_to(F.col("ids"), F.lit(n)).alias("ids"), F.size("ids").alias("length"))


def known_ids(vocab: DataFrame, max_tokens: int = MAX_TOKENS) -> dict[str, int]:
    """The vocabulary as a dictionary for tasks; its size is checked."""
    known = {r["token"]: r["id"] for r in vocab.select("token", "id").limit(max_tokens + 1).collect()}
    if len(known) > max_tokens:
        raise ValueError(f"the vocabulary has more than {max_tokens} tokens")
    return known


def term_frequencies(tokens: Column, vocab: DataFrame, max_tokens: int = MAX_TOKENS) -> Column:
    """array<struct<id, n>>: how often each token of the vocabulary occurs, by id; others do not count. Null for null.

    The vocabulary, whose size is checked, goes to the tasks as a dictionary.
    """
    known = known_ids(vocab, max_tokens)

    @F.pandas_udf("array<struct<id: int, n: int>>")
    def run(rows: pd.Series) -> pd.Series:
        count = lambda row: sorted(Counter([known[w] for w in row if w in known]).items())
        return rows.map(lambda row: None if row is None else [{"id": i, "n": n} for i, n in count(row)])

    return run(tokens)


def pad_to(ids: Column, n: Column) -> Column:
    missing = F.greatest(n - F.size(ids), F.lit(0)).cast("int")
    return F.concat(ids, F.array_repeat(F.lit(PAD), missing))


def padding_mask(ids: Column) -> Column:
    return F.transform(ids, lambda i: i != PAD)


def batch(df: DataFrame, key: str, ids: str, size: int, seed: int, pad: bool = False) -> DataFrame:
    """(key, ids, batch_id): groups of ``size`` rows of a shuffle; ``pad`` fills up to the batch maximum."""
    if size <= 1:
        raise ValueError("batch size should be greater than 1")
    placed = shuffled_rank(df, key, seed, "batch").select(key, F.floor(F.col("rank") / size).alias("batch_id"))
    out = df.select(key, ids).join(placed, key)
    if pad:
        widest = F.max(F.size(ids)).over(Window.partitionBy("batch_id"))  # ``size`` rows
        out = out.withColumn("_n", widest).withColumn(ids, pad_to(F.col(ids), F.col("_n"))).drop("_n")
    return out


def embed(tokens: DataFrame, key: str, table: DataFrame, dim: int) -> DataFrame:
    """(key, vector): mean of the vectors of the tokens that ``table`` (token, vec) knows."""
    found = tokens.join(table, "token")
    means = found.groupBy(key).agg(*[F.avg(F.get("vec", F.lit(i))).alias(f"_{i}") for i in range(dim)])
    return means.select(key, F.array(*[f"_{i}" for i in range(dim)]).alias("vector"))
