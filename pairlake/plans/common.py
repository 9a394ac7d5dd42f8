"""Shared pieces of the registered queries and of their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairlake.session import spread

SEED = 42


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# The key column of the text tables.
KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "embeddings": "vec_id", "events": "event_id"}


def texts(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    """A text table for work that is heavy per row."""
    return spread(table(spark, folder, name), KEYS[name])


def sql_draw(salt: str, *keys: str, seed: int = SEED) -> str:
    """The check SQL of functions.draws.draw."""
    parts = ", ".join([f"'{seed}'", f"'{salt}'", *[f"cast({k} as varchar)" for k in keys]])
    return f"(('0x' || substr(md5(concat_ws('|', {parts})), 1, 15))::BIGINT)"


def sql_rank(source: str, key: str, by: str = "", salt: str = "shuffle", seed: int = SEED) -> str:
    """The check SQL of operators.ranks.shuffled_rank."""
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, {key}" if by else key
    return (
        f"SELECT {cols}, row_number() OVER ({part} ORDER BY {sql_draw(salt, key, seed=seed)}, {key}) - 1 AS rank, "
        f"count(*) OVER ({part}) AS n FROM {source}"
    )


def sql_split(source: str, key: str, seed: int = SEED) -> str:
    """The check SQL of operators.splits.with_stage (disjoint form), keys only."""
    return (
        f"SELECT {key}, CASE WHEN rank < floor(0.8 * n) THEN 'train' WHEN rank < floor(0.9 * n) "
        f"THEN 'validation' ELSE 'test' END AS stage FROM ({sql_rank(source, key, seed=seed)})"
    )


def sql_step(drawn: str, n: str, *avoid: str) -> str:
    """The check SQL of functions.draws.step_past."""
    k = len(avoid)
    d = f"({drawn} % ({n} - {k}))"
    if k == 1:
        return f"({d} + CASE WHEN {d} >= {avoid[0]} THEN 1 ELSE 0 END)"
    lo, hi = f"least({avoid[0]}, {avoid[1]})", f"greatest({avoid[0]}, {avoid[1]})"
    one = f"({d} + CASE WHEN {d} >= {lo} THEN 1 ELSE 0 END)"
    return f"({one} + CASE WHEN {one} >= {hi} THEN 1 ELSE 0 END)"


def sql_pairs(source: str, key: str, pos: int = 1, neg: int = 1) -> str:
    """CTE list ending in ``pairs``: the check SQL of operators.pairs.make_pairs by stage.

    ``source`` must be a relation with ``key`` and ``stage``.
    """
    alt = sql_step(sql_draw("alt", "seed_id", "rep"), "n", "rank")
    base1 = sql_step(sql_draw("base", "seed_id", "rep"), "n", "rank")
    base0 = sql_step(sql_draw("base", "seed_id", "rep"), "n", "rank", "alt_rank")
    return f"""
    ranks AS ({sql_rank(source, key, by="stage")}),
    reps AS (SELECT stage, {key} AS seed_id, rank, n, rep, CASE WHEN rep <= {pos} THEN 1 ELSE 0 END AS label
             FROM ranks, (SELECT unnest(generate_series(1, {pos + neg})) AS rep)),
    alts AS (SELECT *, CASE WHEN label = 1 THEN rank ELSE {alt} END AS alt_rank FROM reps),
    bases AS (SELECT *, CASE WHEN label = 1 THEN {base1} ELSE {base0} END AS base_rank FROM alts),
    pairs AS (SELECT concat_ws('.', seed_id, b.{key}, label, rep) AS pair_id, seed_id, a.{key} AS alt_id,
                     b.{key} AS base_id, rep, label, bases.stage AS stage
              FROM bases JOIN ranks a ON a.stage = bases.stage AND a.rank = alt_rank
                         JOIN ranks b ON b.stage = bases.stage AND b.rank = base_rank)"""
