"""Draws, ranks, running totals, quantiles, splits, grid."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pairlake.functions.draws import draw, share, step_past
from pairlake.operators import grid, ranks, splits


def python_draw(seed, salt, *keys):
    text = "|".join([str(seed), salt, *map(str, keys)])
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def test_draw_is_the_seeded_hash(spark):
    rows = spark.range(20).select("id", draw(7, "x", "id").alias("d")).collect()
    assert all(r.d == python_draw(7, "x", r.id) for r in rows)


def test_share_is_close_to_the_fraction(spark):
    n = spark.range(5000).where(share(draw(1, "s", "id"), 0.4)).count()
    assert 1850 < n < 2150


@pytest.mark.parametrize("n,avoid", [(2, (0,)), (2, (1,)), (3, (0, 2)), (3, (2, 1)), (5, (4,)), (5, (1, 3))])
def test_step_past_is_uniform_over_the_rest(spark, n, avoid):
    df = spark.range(3000).select(step_past(draw(3, "p", "id"), F.lit(n), *[F.lit(a) for a in avoid]).alias("r"))
    seen = Counter(r.r for r in df.collect())
    rest = set(range(n)) - set(avoid)
    assert set(seen) == rest
    assert min(seen.values()) > 3000 / len(rest) * 0.85


def test_too_few_targets_fail(spark):
    df = spark.range(1).select(step_past(F.lit(5), F.lit(2), F.lit(0), F.lit(1)).alias("r"))
    with pytest.raises(PySparkException):
        df.collect()


@pytest.mark.parametrize("bits", [1, 4, 12])
def test_shuffled_rank_is_the_order_of_draws(spark, bits):
    got = {r.id: r["rank"] for r in ranks.shuffled_rank(spark.range(200), "id", 9, bits=bits).collect()}
    order = sorted(range(200), key=lambda i: (python_draw(9, "shuffle", i), i))
    assert got == {k: i for i, k in enumerate(order)}


def test_rank_in_groups_with_one_large_group(spark):
    df = spark.range(300).select("id", F.when(F.col("id") < 250, "big").otherwise("small").alias("g"))
    rows = ranks.shuffled_rank(df, "id", 1, by=["g"]).collect()
    for g, n in (("big", 250), ("small", 50)):
        mine = [r for r in rows if r.g == g]
        assert sorted(r["rank"] for r in mine) == list(range(n)) and {r.n for r in mine} == {n}


def test_running_totals(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), "id", (F.col("id") % 7).alias("v"))
    got = {(r.g, r.id): r.t for r in ranks.running(df, ["id"], {"t": F.col("v")}, by=["g"]).collect()}
    for g in (0, 1):
        total = 0
        for i in range(g, 500, 2):
            total += i % 7
            assert got[(g, i)] == total


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 30, 401).tolist(), rng.normal(size=401).tolist()
    df = spark.createDataFrame(list(zip(a, b)), "a long, b double")
    got = {(r.name, r.fraction): r.value for r in ranks.exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.9]).collect()}
    for name, values in (("a", a), ("b", b)):
        for f in (0.25, 0.5, 0.9):
            assert got[(name, f)] == pytest.approx(np.quantile(values, f))


@pytest.mark.parametrize("n,want", [(10, (8, 1, 1)), (1, (0, 0, 1)), (37, (29, 4, 4))])
def test_split_sizes(spark, n, want):
    rows = splits.with_stage(spark.range(n), "id", 5).collect()
    c = Counter(r.stage for r in rows)
    assert tuple(c[s] for s in splits.STAGES) == want and len({r.id for r in rows}) == n


def test_overlapping_split(spark):
    rows = splits.with_stage(spark.range(10), "id", 5, overlap=True).collect()
    c = Counter(r.stage for r in rows)
    assert (c["train"], c["validation"], c["test"]) == (8, 1, 2)
    assert {r.id for r in rows if r.stage == "validation"} <= {r.id for r in rows if r.stage == "test"}


def test_split_neither_joins_nor_shuffles_the_rows(spark):
    df = splits.with_stage(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id", 5)
    main = df._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Exchange" not in main and "Join" not in main


def test_shards_cover_all(spark):
    seen = [r.id for i in range(3) for r in splits.shard(spark.range(50), "id", 3, i).collect()]
    assert sorted(seen) == list(range(50))


def test_grid_and_profiles(spark):
    cells = grid.grid(spark.range(2), exp=grid.EXPERIMENTS, mix=grid.MIXES)
    assert cells.distinct().count() == 24
    table = {r.name: r for r in grid.profiles(spark).collect()}
    assert table["EXP_all_m1"].mode == "w_sco" and not table["EXP_all_m1"].mixed
    assert table["EXP_var_m2"].mode == "object" and table["EXP_ast_m3"].mode == "control_dead"
    assert table["EXP_ast_m3"].flags["dead"] == "true" and table["EXP_ast_m2"].flags["dead"] == "false"
    assert table["B"].flags["split_length"] == "5" and table["hi"].flags["encoding"] == "base64"
    named = spark.createDataFrame([("sco",), ("EXP_all_m2",)], "profile string")
    assert {r.mode for r in grid.resolve(named).collect()} == {"sco"}
