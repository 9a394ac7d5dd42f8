"""Length histograms, token statistics, pair statistics, the length report and its summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pairlake.functions.text import length_bin
from pairlake.operators.distances import deltas
from pairlake.operators.ranks import quantiles_of, value_ranks
from pairlake.session import cut


def histogram(df: DataFrame, length: Column, width: int) -> DataFrame:
    """(bin, files): counts by ceil(length / width)."""
    return df.groupBy(length_bin(length, width).alias("bin")).agg(F.count("*").alias("files"))


def file_count(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by.., files): rows per folder, source or set."""
    return df.groupBy(*by).agg(F.count("*").alias("files"))


def token_frequencies(tokens: DataFrame) -> DataFrame:
    """(value, freq) of a token table; hot tokens are added up before the shuffle."""
    return tokens.groupBy("value").agg(F.count("*").alias("freq"))


def token_stats(tokens: DataFrame, keys: Sequence[str], approximate: bool = False) -> DataFrame:
    """One row: number of tokens, of distinct tokens, of files, longest file in tokens."""
    if approximate:
        per_file = tokens.groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg("value").alias("h"))
        return per_file.agg(
            F.sum("n").alias("tokens"), F.hll_sketch_estimate(F.hll_union_agg("h")).alias("distinct_tokens"),
            F.count("*").alias("files"), F.max("n").alias("max_length"),
        )
    # per file and value once; then both totals from the same rows
    per = tokens.groupBy(*keys, "value").agg(F.count("*").alias("c"))
    sets = per.groupingSets([[F.col(k) for k in keys], [F.col("value")]], *[F.col(k) for k in keys], F.col("value"))
    both = sets.agg(F.sum("c").alias("n"), F.grouping("value").alias("of_file"))
    file = F.col("of_file") == 1
    return both.agg(
        F.coalesce(F.sum(F.when(file, F.col("n"))), F.lit(0)).alias("tokens"), F.count_if(~file).alias("distinct_tokens"),
        F.count_if(file).alias("files"), F.max(F.when(file, F.col("n"))).alias("max_length"),
    )


def outcomes(df: DataFrame, key: str, status: str) -> DataFrame:
    """(status, files): files per outcome of a node table or status table."""
    return df.groupBy(key).agg(F.max(status).alias(status)).groupBy(status).agg(F.count("*").alias("files"))


def pair_stats(pairs: DataFrame, by: Sequence[str] = ("stage",)) -> DataFrame:
    """Largest seed and target token counts per set."""
    return pairs.groupBy(*by).agg(
        F.max(F.get("dist_token", F.lit(1))).alias("max_seed_tokens"), F.max(F.get("dist_token", F.lit(2))).alias("max_dest_tokens")
    )


def length_report(pairs: DataFrame) -> DataFrame:
    """The nine report columns from pair records."""
    at = lambda c, i: F.get(c, F.lit(i)).cast("bigint")
    flat = pairs.select(
        at("dist_token", 1).alias("seed_length"), at("dist_token", 2).alias("dest_length"), at("dist_token", 0).alias("token_ed"),
        at("dist_ast", 1).alias("seed_ast"), at("dist_ast", 2).alias("dest_ast"), at("dist_ast", 0).alias("ast_ed"),
        F.col("result").alias("label"),
    )
    return deltas(flat).select(
        "seed_length", "dest_length", "token_ed", "token_delta", "seed_ast", "dest_ast", "ast_ed", "ast_delta", "label"
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, count, mean, std, min, q25, q50, q75, max), quantiles exact and interpolated.

    Everything comes from one table of distinct values with their counts, so the
    input is computed once.
    """
    seen = cut(value_ranks(df, columns))
    base = seen.groupBy("name").agg(
        F.sum("c").alias("count"), (F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    # around the mean, as squares of large values would lose digits; one row per column name
    off = F.col("value") - F.col("mean")
    spread = seen.join(F.broadcast(base.select("name", "mean", "count")), "name").groupBy("name", "count").agg(F.sum(off * off * F.col("c")).alias("_q"))
    spread = spread.select("name", F.sqrt(F.try_divide("_q", F.col("count") - 1)).alias("std"))
    spots = quantiles_of(seen, (0.25, 0.5, 0.75))
    at = lambda f: F.max(F.when(F.col("fraction") == f, F.col("value")))
    wide = spots.groupBy("name").agg(at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75"))
    names = F.explode(F.array(*[F.lit(c) for c in columns])).alias("name")
    out = df.sparkSession.range(1).select(names).join(base, "name", "left").join(spread, "name", "left").join(wide, "name", "left")
    return out.select("name", F.coalesce("count", F.lit(0)).alias("count"), "mean", "std", "min", "q25", "q50", "q75", "max")
