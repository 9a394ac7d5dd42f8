"""The pair record: token texts, three distances with both sizes, label; relative distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from pairlake.functions import edit
from pairlake.functions.lexer import join_tokens, tokens
from pairlake.operators import trees
from pairlake.session import fan_out

PAIR_SCHEMA = T.StructType(
    [
        T.StructField("obfuscated_tokens", T.StringType()),
        T.StructField("seed_tokens", T.StringType()),
        T.StructField("dist_string", T.ArrayType(T.LongType())),
        T.StructField("dist_ast", T.ArrayType(T.LongType())),
        T.StructField("dist_token", T.ArrayType(T.LongType())),
        T.StructField("result", T.IntegerType()),
        T.StructField("obfuscated_ast", T.StringType()),
        T.StructField("seed_ast", T.StringType()),
    ]
)


def _triple(distance, first, second):
    return F.array(*[c.cast("bigint") for c in (distance, first, second)])


def token_sides(df: DataFrame, seed: str, target: str, mode: str = "class") -> DataFrame:
    """Adds seed_tokens, obfuscated_tokens (blank-joined) and their counts."""
    arrays = df.select("*", tokens(F.col(seed), mode).alias("_s"), tokens(F.col(target), mode).alias("_t"))
    return arrays.select(
        *df.columns,
        join_tokens(F.col("_s")).alias("seed_tokens"), F.size("_s").alias("seed_length"),
        join_tokens(F.col("_t")).alias("obfuscated_tokens"), F.size("_t").alias("dest_length"),
    )


def to_features(pairs: DataFrame) -> DataFrame:
    """(obf, org, lbl): what a model sees of a pair record."""
    return pairs.select(
        F.col("obfuscated_tokens").alias("obf"), F.col("seed_tokens").alias("org"), F.col("result").alias("lbl")
    )


def datapair(
    pairs: DataFrame, seed: str, target: str, pair: str = "pair_id", seed_id: str = "seed_id",
    mode: str = "class", to_ast: bool = False, corpus: DataFrame | None = None,
) -> DataFrame:
    """The pair columns plus the full pair record, for HTML-like texts.

    ``pairs`` carries whole seed and target texts. Seed trees are built once
    per seed document and meet the pair by key, target trees in the pair's row.
    ``corpus`` (seed_id, text) gives the seed documents, so that their trees are
    built from the scan; else they are taken out of the pairs.
    """
    sided = token_sides(pairs, seed, target, mode)
    # one row per seed: copies of a seed in several pairs are dropped before parsing
    seeds = corpus.toDF(seed_id, seed) if corpus is not None else pairs.select(seed_id, seed).dropDuplicates([seed_id])
    seed_trees = seeds.select(seed_id, trees.html_tree(F.col(seed)).alias("_s")).select(
        seed_id, F.col("_s.tree").alias("_st"), F.col("_s.n").alias("_sn"))
    sided = sided.withColumn("_t", trees.html_tree(F.col(target))).withColumns({"_tt": F.col("_t.tree"), "_tn": F.col("_t.n")}).drop("_t")
    joined = sided.join(seed_trees, seed_id, "left")
    joined = fan_out(joined.fillna("", ["_st", "_tt"]).fillna(0, ["_sn", "_tn"]), pair)
    own = [c for c in pairs.columns if c not in (seed, target)]
    asts = [trees.first_of(F.col(c)).alias(n) if to_ast else F.lit(None).cast("string").alias(n)
            for c, n in (("_tt", "obfuscated_ast"), ("_st", "seed_ast"))]
    return joined.select(
        *own, "obfuscated_tokens", "seed_tokens",
        _triple(edit.string_distance(F.col(seed), F.col(target)), F.length(seed), F.length(target)).alias("dist_string"),
        # the root above the top-level nodes counts as one node
        _triple(trees.tree_distance(F.col("_st"), F.col("_tt")), F.col("_sn") + 1, F.col("_tn") + 1).alias("dist_ast"),
        _triple(
            edit.token_distance(F.col("seed_tokens"), F.col("obfuscated_tokens")), F.col("seed_length"), F.col("dest_length")
        ).alias("dist_token"),
        F.col("label").cast("int").alias("result"), *asts,
    )


def deltas(df: DataFrame) -> DataFrame:
    """Adds token_delta and ast_delta: distance per unit of seed size (null for an empty seed)."""
    return df.withColumn("token_delta", F.try_divide("token_ed", "seed_length")).withColumn(
        "ast_delta", F.try_divide("ast_ed", "seed_ast")
    )
