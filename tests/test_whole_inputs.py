"""No caps, no lost data: long numbers, long references, whole names, every profile and one pass per summary."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlake import session
from pairlake.functions import text
from pairlake.operators import distances, grid, metrics, models, pairs, perturb, report, splits, trees, vocab
from pairlake.operators.search import search


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize("number", ("0", "7", "007", "000", "999999999999999", "1234567890123456", "9" * 80, "1" + "0" * 50))
def test_numbers_of_any_length(spark, number):
    for seed in range(5):
        got = one(spark, lambda t: perturb.number_expressions(t, seed, F.lit(1)), f"x {number}.")
        a, b = re.fullmatch(r"x \(([0-9]+)\+([0-9]+)\)\.", got).groups()
        assert int(a) + int(b) == int(number) and (a == "0" or a[0] != "0") and (b == "0" or b[0] != "0")


TEXTS = (
    "x = 'a'+'b' + \"c\"+\"d\"; e = 'it''s'+ 'f' +'g'", "_s(0x1) _s_(0x2) _s__(0xzz) '_s(0x0)' \"_s(0x1)\"", "don't 'stop' it's \"x'+'y\"+\"z\"",
    "", "''+''", "'abcdefghijklmnop'+'abcdefghijklmnopq'", "plain", "'a'\n+ 'b'", "+ '+' +",
)


@pytest.mark.parametrize("shift", (0, 1 << 25, 1 << 40))
@pytest.mark.parametrize("share", (0.5, 1.0))
def test_restore_has_no_false_repairs(spark, shift, share):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "k long, t string")
    words = docs.withColumn("w", perturb.string_dictionary(F.col("t"), share, 1, "k")).withColumn("d", F.md5("t"))
    coded = words.withColumn("c", perturb.split_literals(perturb.reference_literals(F.col("t"), F.col("w"), shift), 3))
    back = {r.k: (r.c, r.status) for r in perturb.restore(coded, "k", "c", "d", "w", shift=shift).collect()}
    assert [back[i][0] for i in range(len(TEXTS))] == list(TEXTS) and all(s != "failed" for _, s in back.values())


@pytest.mark.parametrize("encoding", ("none", "base64"))
def test_dictionary_line(spark, encoding):
    for value in (*TEXTS, "s = 'é🎉\\n' + \"q\""):
        coded = one(spark, lambda t: perturb.with_dictionary(t, perturb.string_dictionary(t, 1.0, 1, F.lit(1)), encoding), value)
        assert coded.startswith(perturb.HEADER) and one(spark, lambda t: perturb.without_dictionary(t, encoding), coded) == value
    assert one(spark, perturb.without_dictionary, "no line") == "no line"


def test_keys_in_any_text(spark):
    got = one(spark, lambda t: perturb.rename_text_keys(t, 1, F.lit(1)), "{a: 1, 'b' : 2, \"a\": c} d ? e : f")
    m = re.fullmatch(r"\{(\w+): 1, '(\w+)' : 2, \"(\w+)\": c\} d \? (\w+) : f", got)
    assert m and m[1] == m[3] and m[2] != "b" and m[4] != "e"


RICH = "f(a) { b: 'some literal here', \"k\": 12345 } // note\nsecond line  with 'another one'\nthird   line\nlast line"


def test_every_profile_changes_a_rich_text(spark):
    # line order changes in a share of the texts only, so there are several
    rows = [(f"p{i}", RICH, RICH, "base one\nbase  two 'x' // c\nbase three") for i in range(6)]
    pair = spark.createDataFrame(rows, "pair_id string, seed_text string, alt_text string, base_text string")
    names = [r["name"] for r in grid.profile_rows()]
    every = {(r["mode"], r["pair_id"]): r["target_text"] for r in perturb.apply_modes(pair, 3, names).collect()}
    assert len(every) == 21 * 6
    for name in names:
        changed = sum(RICH not in every[name, f"p{i}"] for i in range(6))
        assert changed == 6 or changed and name.startswith(("EXP_ast", "p_control")), name
    got = {name: every[name, "p0"] for name in names}
    assert got["medium"].startswith(perturb.HEADER) and "some literal" not in got["medium"] and '"12345' not in got["medium"]
    assert one(spark, lambda t: perturb.without_dictionary(t), got["low"]).count("'some literal here'") == 1
    assert got["w_control_ast"].startswith('[["') and "some literal" not in got["w_control_ast"]
    presets = {r["name"]: {**grid.DEFAULT_FLAGS, **r["over"]} for r in grid.profile_rows() if r["name"] in grid.PRESETS}
    assert all(f["reserved_strings"] == "" for f in presets.values())


def test_compact_leaves_literals(spark):
    for value, want in (
        ("x = 'see //host/share' + y // gone", "x = 'see //host/share' + y"), ('a  = "two  blanks /* kept */"  ;/* gone */ b', 'a = "two  blanks /* kept */" ; b'),
        ("u = http://a.b//c  d", "u = http://a.b"), ("/* open", "/* open"), ("a/**/b", "a b"),
    ):
        assert one(spark, text.compact, value) == want


def test_whole_element_names(spark):
    html = "<my-el a='>' b=\">\"><p-card>x</p-card><svg:g/><P class=a>t</P></my-el><scripty>1</scripty><i a='>q</i>"
    labels = [r.label for r in trees.nodes(trees.html_stream(spark.createDataFrame([(1, html)], "k long, html string"), "k"), "k").orderBy("node_id").collect()]
    assert labels == ["my-el", "p-card", "svg:g", "p", "scripty", "i"]


PAGES = (
    "", "no tags", "<a><b></b><br><c></c></a><d></d>", "</a><a>", "<p>one<p>two<b>x</b>", "<x-y><z:q>1</z:q></x-y>", "<ul><li><li><li></ul><ul></ul>",
    "<a><b></a></b>", "<é><a>", "<!-- <a> --><script>if (a<b) {}</script><i></i>",
)


def test_row_trees_equal_windowed_trees(spark):
    rows = spark.createDataFrame(list(enumerate(PAGES)), "k long, html string")
    more = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select((F.col("page_id") + 1000).alias("k"), "html")
    rows = rows.unionByName(more)
    far = {r.k: (r.tree, r.n) for r in trees.tree_texts(trees.nodes(trees.html_stream(rows, "k"), "k"), "k").collect()}
    near = {r.k: tuple(r.t) for r in rows.select("k", trees.html_tree(F.col("html")).alias("t")).collect()}
    assert near == {k: far.get(k, ("", 0)) for k in near}


def test_first_subtree_is_whole(spark):
    for tree, want in (("", ""), ("1:a", "1:a"), ("1:a 2:b 3:c 1:d 2:e", "1:a 2:b 3:c"), ("1:a 2:b 2:c", "1:a 2:b 2:c"), ("2:a 3:b 1:c", "2:a 3:b")):
        assert one(spark, trees.first_of, tree) == want
    rows = [("p", 1, "<a><b></b></a><c></c>", "<d><e></e></d>", 0)]
    rec = distances.datapair(spark.createDataFrame(rows, "pair_id string, seed_id long, s string, t string, label int"), "s", "t", to_ast=True).first()
    assert rec.seed_ast == "1:a 2:b" and rec.obfuscated_ast == "1:d 2:e" and rec.dist_ast[1:] == [4, 3]


def test_vocabulary_and_codes_part_alike(spark):
    odd = "a b c　d e f\u0085g\u001ch \x0b i"
    df = spark.createDataFrame([(1, odd), (2, None), (3, "")], "k long, t string")
    known = vocab.fit_vocab(df, ["t"])
    tokens = re.split("[ \t\n\x0b\f\r]+", odd)
    assert sorted(r.token for r in known.collect()) == sorted(set(tokens))
    got = {r.k: r for r in vocab.encode(df, "k", "t", known, 12).collect()}
    ids = {r.token: r.id for r in known.collect()}
    assert got[1].ids[: len(tokens)] == [ids[t] for t in tokens] and got[1].length == len(tokens)
    assert got[2].ids == got[3].ids == [0] * 12


def test_encoders_see_whole_texts(spark):
    long = "word " * 400
    rows = [(1, long + "same " * 900, long + "other " * 900)]
    score = lambda **k: models.score_pairs(spark.createDataFrame(rows, "k long, seed_text string, target_text string"), **k).first().cosine
    assert score(max_length=1024) > 0.999 > score()


def test_leaks(spark):
    rows = [(1, "a", "train"), (2, "a", "test"), (3, "b", "train"), (4, "b", "train"), (1, "a", "validation"), (5, None, "test"), (6, None, "train")]
    staged = spark.createDataFrame(rows, "k long, t string, stage string")
    assert [tuple(r) for r in splits.leaked_keys(staged, "k").collect()] == [(1, "train,validation")]
    got = {r.t: (r.stages, r.rows) for r in splits.leaked_texts(staged, "t").collect()}
    assert got["a"] == ("test,train,validation", 3) and "b" not in got


def scans(df, folder):
    return df._jdf.queryExecution().executedPlan().toString().count(folder)


def test_summaries_read_their_input_once(spark, tmp_path):
    path = str(tmp_path / "scored")
    spark.range(1000).select("id", (F.col("id") % 7 / 7.0).alias("score"), (F.col("id") % 2).cast("int").alias("label"), F.col("id").cast("string").alias("value")).write.parquet(path)
    df = spark.read.parquet(path)
    assert scans(metrics.evaluate(df, "score", "label"), "scored") == 0  # all from the written counts
    assert scans(metrics.threshold_metrics(df, "score", "label"), "scored") == 0
    assert scans(report.describe(df, ["id", "score"]), "scored") == 0
    assert report.token_stats(df, ["id"])._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert tuple(report.token_stats(df, ["id"]).first()) == (1000, 1000, 1000, 1)
    assert tuple(report.token_stats(df.limit(0), ["id"]).first()) == (0, 0, 0, None)
    got = {r.name: r for r in report.describe(df.withColumn("gone", F.lit(None).cast("double")), ["id", "gone"]).collect()}
    assert got["id"].mean == 499.5 and abs(got["id"].std - np.std(np.arange(1000), ddof=1)) < 1e-9 and got["gone"]["count"] == 0


def test_cuts_can_be_dropped(spark):
    session.drop_cuts(spark)
    kept = session.cut(spark.range(3))
    path = session.CUTS[-1]
    assert kept.count() == 3 and session.drop_cuts(spark) == 1 and not session.CUTS
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_cuts_of_other_sessions_stay(spark):
    session.drop_cuts(spark)
    other = spark.newSession()
    mine, theirs = session.cut(spark.range(3)), session.cut(other.range(4))
    assert session.drop_cuts(spark) == 1 and theirs.count() == 4
    one, two = session.cut(other.range(5)), session.cut(other.range(6))
    assert session.drop_cuts(other, session.cuts(other)[1:2]) == 1 and two.count() == 6 and len(session.cuts(other)) == 2
    assert session.drop_cuts(other) == 2 and not session.CUTS


@pytest.mark.parametrize("rows", (1024, 7))
def test_search_is_exact_with_rings(spark, monkeypatch, rows):
    monkeypatch.setattr("pairlake.operators.search.RING_ROWS", rows)
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.standard_normal((150, 6)), np.repeat(rng.standard_normal((1, 6)), 60, 0) + 1e-3 * rng.standard_normal((60, 6))])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)]
    seeds = spark.createDataFrame(rows, "seed_id long, vector array<double>")
    found = search(seeds.withColumnRenamed("seed_id", "target_id"), seeds, 4, skip_same=True, pivots=5, block=16).collect()
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    scores = np.round((unit @ unit.T + 1) / 2, 9)
    for t in range(len(points)):
        want = sorted((i for i in range(len(points)) if i != t), key=lambda i: (-scores[t, i], i))[:4]
        assert [r.seed_id for r in sorted((r for r in found if r.target_id == t), key=lambda r: r.place)] == want


def test_one_pair_record(spark):
    pages = spark.createDataFrame([(0, "<a><b></b></a>"), (1, "<a></a>")], "page_id long, html string")
    made = pairs.one_pair(pages, "page_id", "html", 0, 1).select("*", F.lit("x").alias("pair_id"), F.lit(0).alias("label"))
    rec = distances.datapair(made, "seed_text", "target_text").first()
    assert rec.dist_ast == [1, 3, 2] and rec.dist_string == [7, 14, 7]
