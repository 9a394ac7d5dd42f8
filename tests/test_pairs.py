"""Pair building."""

from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pairlake.operators import grid, pairs, splits


def keys(spark, n):
    return splits.with_stage(spark.range(n).withColumnRenamed("id", "doc_id"), "doc_id", 1)


def test_pairs_keep_the_avoid_rules(spark):
    rows = pairs.make_pairs(keys(spark, 60), "doc_id", 1, pos=2, neg=3).collect()
    stage = {r.doc_id: r.stage for r in keys(spark, 60).collect()}
    assert Counter(r.label for r in rows) == {1: 120, 0: 180}
    assert len({r.pair_id for r in rows}) == 300
    for r in rows:
        assert stage[r.seed_id] == stage[r.alt_id] == stage[r.base_id] == r.stage
        if r.label:
            assert r.alt_id == r.seed_id != r.base_id
        else:
            assert len({r.seed_id, r.alt_id, r.base_id}) == 3


def test_negatives_are_honoured(spark):
    rows = pairs.make_pairs(keys(spark, 60), "doc_id", 1, pos=1, neg=0).collect()
    assert {r.label for r in rows} == {1}


def test_small_groups_fail(spark):
    two = spark.range(2).select(F.col("id").alias("doc_id"), F.lit("train").alias("stage"))
    assert pairs.make_pairs(two, "doc_id", 1, 1, 0).count() == 2
    with pytest.raises(PySparkException):
        pairs.make_pairs(two, "doc_id", 1, 0, 1).collect()


def test_attach_gives_the_right_texts(spark):
    corpus = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    made = pairs.make_pairs(keys(spark, 40), "doc_id", 1)
    for r in pairs.attach(made, corpus).collect():
        assert (r.seed_text, r.alt_text, r.base_text) == (f"t{r.seed_id}", f"t{r.alt_id}", f"t{r.base_id}")


def test_attach_reads_the_corpus_once(spark):
    corpus = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = pairs.make_pairs(splits.with_stage(corpus.select("doc_id"), "doc_id", 1), "doc_id", 1)
    plan = pairs.attach(made, corpus)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text#") and plan.count("Relation [doc_id") == 1
    assert "Cartesian" not in plan


def test_first_success(spark):
    k = spark.range(30).withColumnRenamed("id", "doc_id")
    ok = k.select("doc_id", (F.col("doc_id") < 10).alias("ok"))
    rows = pairs.first_success(k, ok, "doc_id", 3).collect()
    assert len(rows) == 30
    for r in rows:
        if r.status == "ok":
            assert r.partner < 10 and r.partner != r.doc_id and 0 <= r.attempt < 10
        else:
            assert r.partner is None
    none = k.select("doc_id", F.lit(False).alias("ok"))
    assert {r.status for r in pairs.first_success(k, none, "doc_id", 3).collect()} == {"failed"}
    with pytest.raises(PySparkException):
        pairs.first_success(k, none, "doc_id", 3, strict=True).collect()


def test_pair_targets_two_rows_each(spark):
    made = pairs.make_pairs(keys(spark, 60), "doc_id", 1, 1, 0)
    targets = grid.grid(made.select("stage", F.col("seed_id").alias("source"), F.col("base_id").alias("base")), exp=["e"], mix=["m"])
    rows = pairs.pair_targets(targets, 2).collect()
    assert len(rows) == 120
    for r in rows:
        assert (r.seed == r.source) if r.label else (r.seed not in (r.source, r.base))


def test_two_folder_pairs(spark):
    rows = pairs.two_folder_pairs(spark.range(20).withColumnRenamed("id", "doc_id"), "doc_id", 1).collect()
    assert len(rows) == 40
    for r in rows:
        assert r.first != r.second
        assert (r.first == r.doc_id) == (r.label == 1) and r.second != r.doc_id


def test_missing_and_completeness(spark):
    a, b = spark.range(10), spark.createDataFrame([(1,), (1,), (3,)], "id long")
    assert {r.id for r in pairs.missing(a, b, "id").collect()} == set(range(10)) - {1, 3}
    assert tuple(pairs.completeness(a, b, "id").first()) == (10, 8)


def test_one_pair_and_unions(spark):
    c = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, t string")
    r = pairs.one_pair(c, "k", "t", 3, 1).first()
    assert (r.seed_text, r.target_text) == ("c", "a")
    u = pairs.union_records(c, spark.createDataFrame([(9, 1.5)], "k long, x double"))
    assert u.columns == ["k", "t", "x"] and u.where("x is null").count() == 3


def test_packed_texts_are_those_of_the_plain_way(spark):
    made = pairs.make_pairs(keys(spark, 40), "doc_id", 1, 2, 1)
    odd = spark.createDataFrame([(0, None), (1, ""), (2, "é\n٣ \U0001f600"), (2, "z"), (2, "é\n"), (3, None), (3, "b"), (None, "x")], "doc_id long, text string")
    corpus = spark.range(4, 38).select(F.col("id").alias("doc_id"), F.concat(F.lit("t" * 500), "id").alias("text")).unionByName(odd)
    again = made.where("seed_id < 5").unionByName(made).unionByName(  # pairs that come twice, of unknown documents, without a key, and of one name
        spark.createDataFrame([("u", 90, 91, 92, 1, 0, "s"), ("v", None, 5, 6, 1, 0, "s"), ("w", 5, None, None, 1, 1, "s"), ("x", 90, 90, 7, 1, 1, "s"), ("y", 8, 9, 10, 1, 0, "s"), ("y", 8, 11, 12, 1, 0, "s")], made.schema))
    # a name that pairs of two seeds have
    both = again.unionByName(spark.createDataFrame([("y", 12, 13, 14, 1, 0, "s"), ("v", 9, 10, None, 1, 0, "s"), ("z", None, 10, 3, 1, 0, "s"), ("z", 0, 10, 3, 1, 0, "s")], made.schema))
    assert pairs._one_seed_each(again) and not pairs._one_seed_each(both)
    for given in (again, both):
        rows = [sorted((tuple(r) for r in pairs.attach(given, corpus, pack=pack).select(*made.columns, "seed_text", "alt_text", "base_text").collect()), key=repr) for pack in (False, True)]
        assert rows[0] == rows[1] and len(rows[0]) == given.count() - 1 and any(r[-2] == "t" * 500 + "9" for r in rows[0])


def test_packed_texts_make_a_smaller_shuffle(spark):
    corpus = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("some words of "), "id"), 60).alias("text"))
    made = pairs.make_pairs(keys(spark, 200), "doc_id", 1)
    sizes = []
    for pack in (False, True):
        df = pairs.attach(made, corpus, pack=pack)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        found, todo = 0, [plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan]
        while todo:
            node = todo.pop()
            inner = node.plan() if "QueryStage" in node.nodeName() else None
            todo += [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() == "Exchange":
                found += node.metrics().apply("dataSize").value()
        sizes.append(found)
    assert sizes[1] < 0.4 * sizes[0]


def test_packed_pairs_of_few_files_keep_all_tasks_busy(spark):
    corpus = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")).coalesce(1)
    made = pairs.make_pairs(keys(spark, 40), "doc_id", 1).coalesce(1)
    assert pairs.attach(made, corpus, pack=True).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
