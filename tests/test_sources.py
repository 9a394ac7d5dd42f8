"""Sources, sinks, shapes, streaming."""

import glob
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from pairlake.operators import extend, grid, perturb
from pairlake.operators.shapes import infer_shapes
from pairlake.sources import cells, corpus, records
from pairlake.streaming import incremental

SCHEMA = ("n long, marks array<long>, rows array<array<long>>, pair array<float>, cube array<array<array<long>>>, "
          "unit array<array<array<long>>>, title string, tags array<string>, none array<int>, hollow array<array<int>>")
OBJECTS = [
    (7, [8], [[5, 5], [6]], [0.5, 0.25], [[[4, 4], [4, 4]]], [[[9]], [[9]]], "first", ["x"], [], [[]]),
    (8, [8, 9, 10], [[5], [6], [7, 7]], [0.125, 2.0], [[[4, 3]], [[2, 1]], [[0, 0]]], [[[9]], [[9]]], "second", ["y", "z"], [], [[]]),
]


def test_shapes(spark):
    rows = infer_shapes(spark.createDataFrame(OBJECTS, SCHEMA)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.key, r.level)):
        got.setdefault(r.key, []).append(r["size"])
    assert got == {"n": [1], "marks": [None], "rows": [None, None], "pair": [2], "cube": [None, None, 2], "unit": [2, 1, 1],
                   "title": [1], "tags": [None], "none": [-1], "hollow": [1, -1]}
    assert {r.key: r.type for r in rows}["pair"] == "float" and {r.key: r.type for r in rows}["tags"] == "str"


def test_records_round_trip(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.createDataFrame(OBJECTS, SCHEMA)
    many = df.crossJoin(spark.range(70)).drop("id")
    records.write_records(many, path, chunk=50)
    back = records.read_records(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, many.collect()))
    sizes = back.groupBy(F.col("_metadata.file_name")).count().collect()
    assert max(r["count"] for r in sizes) <= 50
    assert records.read_shapes(spark, path).count() == 16
    less = records.read_records(spark, path, ["cube", "unit"])
    plan = less._jdf.queryExecution().executedPlan().toString()
    assert "cube" not in plan and less.columns == [c for c in df.columns if c not in ("cube", "unit")]


def test_json_scan(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"x": 1, "y": [1, 2]}, indent=2))
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        json.dump({"x": 2, "y": []}, f)
    assert sorted((r.x, r.y) for r in records.scan_json(spark, str(tmp_path)).collect()) == [(1, [1, 2]), (2, [])]


def test_corpus_scan(spark, tmp_path):
    (tmp_path / "a.js").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("no")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "c.js").write_text("")
    assert [(r.name, r.content) for r in corpus.scan_corpus(spark, str(tmp_path)).collect()] == [("a.js", "one\ntwo\n")]
    deep = corpus.scan_corpus(spark, str(tmp_path), recursive=True).collect()
    assert {r.name for r in deep} >= {"a.js"} and all(r.path.endswith(r.name) for r in deep)
    kept = corpus.filter_names(spark.createDataFrame([("xa.js",), ("a.js",), ("a.c",)], "n string"), "n", ".js", "x")
    assert [r.n for r in kept.collect()] == ["a.js"]


def test_renumber(spark):
    df = spark.createDataFrame([("a.js",), ("b/x.js",), ("b/y.txt",), ("b/z/q.js",), ("c.js",)], "p string")
    got = {r.path: r.new_name for r in corpus.renumber_corpus(df, "p", "k", suffix="js").collect()}
    assert got == {"a.js": "k-0.js", "b/x.js": "k-1-0.js", "b/z/q.js": "k-1-2-0.js", "c.js": "k-2.js"}


def test_listed_and_derived(spark, tmp_path):
    listed = spark.createDataFrame([("a",), ("b",), ("data/unknown/c",)], "path string")
    files = spark.createDataFrame([("a", "A"), ("data/unknown/c", "C")], "path string, content string")
    rows = {r.path: (r.content, r.status) for r in corpus.scan_listed(listed, files, "path", "data/unknown").collect()}
    assert rows == {"a": ("A", "ok"), "b": (None, "failed")}
    out = corpus.derive(files, "path", F.lower("content"), F.col("content") == "A", "not A")
    for _ in range(2):  # a rerun adds nothing
        corpus.write_derived(out, str(tmp_path / "d"), "path")
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2
    back = {r.path: (r.value, r.status, r.error) for r in spark.read.parquet(str(tmp_path / "d")).collect()}
    assert back == {"a": ("a", "ok", None), "data/unknown/c": (None, "failed", "not A")}


def test_cells_one_after_another_are_written_without_a_shuffle(spark, tmp_path):
    path, rows = str(tmp_path / "cells"), spark.range(20, numPartitions=2).withColumn("stage", F.when(F.col("id") < 15, "train").otherwise("test"))
    copies = [grid.grid(rows, exp=[e], mix=[m]) for e in ("e", "f") for m in ("M1", "M2")]
    every = cells.union_cells(copies)
    assert every.rdd.getNumPartitions() == 8
    assert all(len({r["exp"] + r["mix"] for r in part}) == 1 for part in every.rdd.glom().collect())
    cells.write_cells(every, path, spread=False)
    whole = grid.grid(rows, exp=["e", "f"], mix=["M1", "M2"])
    assert sorted(map(tuple, cells.read_cells(spark, path).select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    assert cells.read_cells(spark, path, stage="test", exp="f", mix="M2").count() == 5
    files = list((tmp_path / "cells").rglob("*.parquet"))
    assert len(files) <= 12 and all(f.name.endswith(".zstd.parquet") for f in files)  # a file per task and cell at most


def test_cells_are_pruned(spark, tmp_path):
    path = str(tmp_path / "c")
    cells.write_cells(grid.grid(spark.range(10), stage=["train", "test"], exp=["e", "f"], mix=["M1"]), path)
    some = cells.read_cells(spark, path, stage="test", exp="e")
    assert some.count() == 10
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(stage" in plan
    cells.write_manifest(spark.createDataFrame([("s", "e", "m", "a"), ("s", "e", "m", "a")], "stage string, exp string, mix string, n string"), str(tmp_path / "m"), "n")
    assert [r.value for r in cells.read_manifest(spark, str(tmp_path / "m")).collect()] == ["a"]


def test_report_and_history(spark, tmp_path):
    df = spark.createDataFrame([("a,\"b", 1.5), ("c", None)], "p string, d double")
    for append in (False, True):
        cells.write_report(df, str(tmp_path / "r"), append)
    assert cells.read_report(spark, str(tmp_path / "r"), df.schema).count() == 4
    for e in (1, 2):
        cells.append_history(spark.createDataFrame([(e, 0.5)], "epoch int, loss double"), str(tmp_path / "h"))
    assert sorted(r.epoch for r in cells.read_history(spark, str(tmp_path / "h"), "epoch int, loss double").collect()) == [1, 2]


def test_materialise_computes_once(spark, tmp_path):
    calls = []

    def compute(n, step=1):
        calls.append(n)
        return [spark.range(0, n, step), spark.range(1)]

    first = records.materialise(spark, str(tmp_path), compute, 10, step=3)
    again = records.materialise(spark, str(tmp_path), compute, 10, step=3)
    assert calls == [10] and [d.count() for d in first] == [d.count() for d in again] == [4, 1]
    records.materialise(spark, str(tmp_path), compute, 11)
    assert calls == [10, 11]

    def compute_other(n, step=1):
        return [spark.range(0, 2 * n, step)]

    other = records.materialise(spark, str(tmp_path), compute_other, 10, step=3)
    assert [d.count() for d in other] == [7]
    one, two = spark.range(3), spark.range(4)
    assert records.argument_key(one) != records.argument_key(two) and records.argument_key(one) == records.argument_key(one)


def test_argument_keys_tell_arguments_apart(spark):
    key = records.argument_key
    apart = [
        ("a", "b"), ("a_b",), ("a b",), ("ab",), ("x/y",), ("xy",), (-1,), ("-1",), (1,), (1.0,), (True,), ("True",), (None,), ("None",), (), ("",),
        ([1, 2],), ((1, 2),), ([[1], 2],), ({"a": 1},), ({"a": "1"},), ([["a", 1]],), ({1, 2},), (b"a",), (spark.range(3),), (spark.range(3).where("id > 1"),),
        (spark.createDataFrame([(1,)], "id long"),), (spark.createDataFrame([(2,)], "id long"),), (spark.createDataFrame([(2,)], "n long"),),
    ]
    keys = [key(*a) for a in apart]
    assert len(set(keys)) == len(keys) and keys == [key(*a) for a in apart]
    assert all(len(k) == 64 and set(k) <= set("0123456789abcdef") for k in keys)
    assert key(a=1, b=2) == key(b=2, a=1) != key(1, b=2) and key({"a": 1, "b": 2}) == key({"b": 2, "a": 1}) and key({3, 1}) == key({1, 3})


def test_frames_are_known_by_files_functions_and_rows(spark, tmp_path):
    for name in "ab":
        spark.range(5).write.parquet(str(tmp_path / name))
    a, b = (spark.read.parquet(str(tmp_path / n)) for n in "ab")
    key = records.argument_key
    assert key(a) == key(spark.read.parquet(str(tmp_path / "a"))) != key(b)
    wide = [a.select(*[(F.col("id") + (i == 30) * k).alias(f"c{i}") for i in range(40)]) for k in range(2)]
    assert key(wide[0]) != key(wide[1])  # they differ beyond what a plan shows
    one, two = F.udf(lambda x: x + 1, "long"), F.udf(lambda x: x + 2, "long")
    assert key(a.select(one("id").alias("x"))) != key(a.select(two("id").alias("x")))


def test_two_writers_read_one_run(spark, tmp_path):
    root, calls = str(tmp_path), []

    def compute(n):
        calls.append(n)
        if len(calls) == 1:  # another writer is done before this one
            assert [r.id for r in records.materialise(spark, root, compute, n)[0].collect()] == [2]
        return [spark.range(len(calls), len(calls) + 1)]

    assert [r.id for r in records.materialise(spark, root, compute, 7)[0].collect()] == [2]
    assert [r.id for r in records.materialise(spark, root, compute, 7)[0].collect()] == [2] and len(calls) == 2


def test_runs_of_differing_schemas(spark, tmp_path):
    root = str(tmp_path)
    records.add_run(spark.createDataFrame([(1, "x", [1], (1, "a"))], "k int, s string, v array<int>, t struct<n: int, m: string>"), root, "a")
    records.add_run(spark.createDataFrame([(2**40, [0.5], (2.5, 3))], "k long, v array<float>, t struct<n: double, o: int>"), root, "b")
    records.add_run(spark.createDataFrame([(3, None)], "k byte, w date"), root, "c")
    rows = {r.k: r for r in records.read_runs(spark, root).collect()}
    assert rows[1].v == [1.0] and rows[1].t.asDict() == {"n": 1.0, "m": "a", "o": None} and rows[1].w is None
    assert rows[2**40].s is None and rows[2**40].t.asDict() == {"n": 2.5, "m": None, "o": 3} and rows[3].t is None
    plan = records.read_runs(spark, root, ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "struct<n" not in plan and records.read_runs(spark, root, ["t"]).columns == ["k", "s", "v", "w"]
    records.add_run(spark.createDataFrame([(4,)], "k int"), root, "c")  # in the place of the earlier one
    assert records.read_runs(spark, root).columns == ["k", "s", "v", "t"]
    records.add_run(spark.createDataFrame([("x",)], "k string"), root, "d")
    with pytest.raises(ValueError, match="k is"):
        records.read_runs(spark, root)


def test_stream_by_key(spark, tmp_path):
    src, sink, progress = (str(tmp_path / n) for n in ("src", "sink", "progress"))
    add = lambda rows: spark.createDataFrame(rows, "k long, v long").coalesce(1).write.mode("append").parquet(src)
    run = lambda progress=progress: sorted(incremental.stream_derive(
        spark, src, "k long, v long", lambda d: d.withColumn("w", F.col("v") * 2), sink, progress, key="k").collect(), key=str)
    add([(1, 1), (2, 2), (None, 3), (2, 5)])
    first = run()
    assert len(first) == 3 and {r.k for r in first} == {1, 2, None}
    add([(2, 9), (None, 9), (1, 9), (3, 3)])
    second = run()
    assert [r for r in second if r.k != 3] == first and [(r.k, r.v, r.w) for r in second if r.k == 3] == [(3, 3, 6)]
    # lost between the sink and the note of progress: the batch runs again and changes nothing
    noted = sorted(glob.glob(f"{progress}/commits/*"))
    for name in noted + glob.glob(f"{progress}/commits/.*.crc"):
        if name.split("/")[-1].strip(".").split(".")[0] == noted[-1].split("/")[-1]:
            os.remove(name)
    assert run() == second
    # with its progress lost the stream reads everything again: all keys are there
    assert run(str(tmp_path / "other")) == second


def test_steps_that_recipes_share_are_done_once(spark):
    extend.register_step("swap", lambda t: F.translate(t, "ab", "ba"))
    df = spark.createDataFrame([(1, "aab"), (2, None)], "k long, t string")
    recipes = {"none": [], "swap": ["swap"], "long": ["swap", "twice"], "longer": ["swap", "twice", "swap"]}
    out = perturb.compose(df, "t", recipes, {"twice": lambda t: F.repeat(t, 2)}, {"text": lambda t: t, "n": F.length})
    got = {(r.k, r.recipe): (r.text, r.n) for r in out.collect()}
    assert got[1, "none"] == ("aab", 3) and got[1, "swap"] == ("bba", 3) and got[1, "long"] == ("bbabba", 6) and got[1, "longer"] == ("aabaab", 6)
    assert got[2, "longer"] == (None, None) and len(got) == 8 and out.columns == ["k", "recipe", "text", "n"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("repeat(") == 1 and plan.count("translate(") == 2
    with pytest.raises(KeyError):
        perturb.compose(df, "t", {"x": ["unknown"]})


def test_stream_takes_new_files_only(spark, tmp_path):
    src, sink, progress = (str(tmp_path / n) for n in ("src", "sink", "progress"))
    part = lambda a, b: spark.range(a, b).coalesce(1).write.mode("append").parquet(src)
    run = lambda: incremental.stream_derive(spark, src, "id long", lambda d: d.withColumn("twice", F.col("id") * 2), sink, progress)
    part(0, 10)
    assert run().count() == 10
    files = set(glob.glob(sink + "/*.parquet"))
    part(10, 15)
    assert sorted(r.twice for r in run().collect()) == [2 * i for i in range(15)]
    assert files < set(glob.glob(sink + "/*.parquet"))
    assert run().count() == 15
    assert incremental.only_new(spark.range(5), spark.range(3), "id").count() == 2


def test_extensions(spark):
    extend.register("even", lambda d: d.where("id % 2 = 0"))
    extend.register("plus", lambda d: d.withColumn("id", F.col("id") + 1))
    assert [r.id for r in extend.apply(spark.range(4), "even", "plus").collect()] == [1, 3]
    out = extend.map_records(spark.range(6), lambda r: {"y": r["id"] * 10} if r["id"] > 3 else {}, "y long")
    assert sorted(r.y for r in out.collect()) == [40, 50]
