"""Edit distances, vectors, pair records, reports."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pairlake.functions import edit, vectors
from pairlake.functions.costs import Costs, cost_table
from pairlake.operators import distances, report


def table(a, b, insert=1, remove=1, update=1):
    row = [j * insert for j in range(len(b) + 1)]
    for x in a:
        new = [row[0] + remove]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + remove, new[-1] + insert, row[j - 1] + (update if x != y else 0)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcé ", max_size=40), st.text("abcé ", max_size=40), st.text("abcé ", max_size=15))
def test_edit_distance_is_a_metric(a, b, c):
    d = edit.edit_distance(a, b)
    assert d == table(a, b) == edit.edit_distance(b, a) == edit.distance(a, b)
    assert abs(len(a) - len(b)) <= d <= max(len(a), len(b))
    assert edit.edit_distance(a, c) <= d + edit.edit_distance(b, c)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=15), st.lists(st.sampled_from("abcd"), max_size=15),
       st.sampled_from([(1, 1, 1), (2, 1, 3), (1, 3, 1), (0.5, 2, 1), (1, 1, 5)]))
def test_weighted(a, b, costs):
    assert edit.weighted(a, b, *costs) == pytest.approx(table(a, b, *costs))


def test_hand_cases(spark):
    df = spark.createDataFrame([("a bb c bb", "a c bb d"), ("", "a b c"), ("x", "x"), ("", ""), (None, "x")], "a string, b string")
    got = [r.d for r in df.select(edit.token_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [2, 3, 0, 0, None]
    assert edit.edit_distance("kitten", "sitting") == 3


def test_string_distance_short_and_long_agree(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdé😀 ") for _ in range(n))
    rows = [(word(rng.choice([0, 5, 60, 70, 300])), word(rng.choice([0, 5, 60, 70, 300]))) for _ in range(40)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", edit.string_distance(F.col("a"), F.col("b")).alias("d"), edit.string_distance_within(F.col("a"), F.col("b"), 50).alias("w")).collect()
    for r in got:
        want = table(r.a, r.b)
        assert r.d == want and r.w == (want if want <= 50 else -1)


def test_many_distinct_symbols():
    a, b = [f"t{i}" for i in range(50_000)], [f"t{i}" for i in range(1, 50_001)]
    assert edit.edit_distance(a[:3000], b[:3000]) == 2


def test_vector_functions(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=8), rng.normal(size=8)
    df = spark.createDataFrame([(a.tolist(), b.tolist(), (-a).tolist(), [0.0] * 8)], "a array<double>, b array<double>, n array<double>, z array<double>")
    c = lambda x, y: vectors.cosine01(F.col(x), F.col(y))
    r = df.select(
        c("a", "b").alias("ab"), c("a", "a").alias("aa"), c("a", "n").alias("an"), c("a", "z").alias("az"),
        vectors.l2_normalise(F.col("a")).alias("u"), vectors.l2_normalise(F.col("z")).alias("z"), vectors.softmax(F.col("a")).alias("s"),
        vectors.kl_divergence(vectors.softmax(F.col("a")), vectors.softmax(F.col("b"))).alias("kl"),
        vectors.to_label(F.lit(0.5), "round").alias("half"), vectors.to_label(F.lit(-0.1)).alias("neg"),
        vectors.overlap_penalty(F.col("a"), F.col("b"), F.lit(1), F.lit(1)).alias("same"),
    ).first()
    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    assert r.ab == pytest.approx((a @ b / np.linalg.norm(a) / np.linalg.norm(b) + 1) / 2)
    assert r.aa == pytest.approx(1) and r.an == pytest.approx(0, abs=1e-12) and r.az == 0.5
    assert np.allclose(r.u, a / np.linalg.norm(a)) and r.z == [0.0] * 8 and np.allclose(r.s, soft(a))
    assert r.kl == pytest.approx((soft(a) * np.log(soft(a) / soft(b))).sum())
    assert (r.half, r.neg, r.same) == (0, 0, 0.0)


def test_datapair_record(spark):
    seed, target = "<p>one two</p>", "<div>x</div>\n<p>one two</p>"
    df = spark.createDataFrame([("p1", 1, 1, seed, target), ("p2", 1, 0, seed, "<ul></ul>"), ("p3", 2, 0, "", "")],
                               "pair_id string, seed_id long, label int, s string, t string")
    rows = {r.pair_id: r for r in distances.datapair(df, "s", "t", to_ast=True).collect()}
    r = rows["p1"]
    assert r.seed_tokens == "</>/<=/>= name </>/<=/>= name name </>/<=/>= / name </>/<=/>="
    assert r.dist_string == [13, 14, 27] and r.dist_ast == [1, 2, 3] and r.dist_token == [8, 9, 17]
    assert (r.result, r.seed_ast, r.obfuscated_ast) == (1, "1:p", "1:div")
    assert rows["p2"].dist_ast == [1, 2, 2] and rows["p3"].dist_string == [0, 0, 0] and rows["p3"].dist_ast == [0, 1, 1]
    assert [f.name for f in distances.PAIR_SCHEMA] == [c for c in r.asDict() if c not in ("pair_id", "seed_id", "label")]


def test_datapair_distances_equal_brute_force(spark):
    from pairlake.functions.treedist import tree_distance
    from pairlake.operators import trees
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").orderBy("page_id").limit(6)
    rows = pages.collect()
    df = spark.createDataFrame([(f"{a.page_id}", a.page_id, 0, a.html, b.html) for a, b in zip(rows, rows[1:])], "pair_id string, seed_id long, label int, s string, t string")
    shape = {}
    for r in trees.nodes(trees.html_stream(pages, "page_id"), "page_id").orderBy("node_id").collect():
        shape.setdefault(r.page_id, []).append((r.depth, r.label))
    whole = lambda k: ([0] + [d for d, _ in shape[k]], [""] + [x for _, x in shape[k]])
    after = {a.page_id: b for a, b in zip(rows, rows[1:])}
    for r in distances.datapair(df, "s", "t", mode="value").collect():
        other = after[r.seed_id]
        mine = next(x for x in rows if x.page_id == r.seed_id)
        assert r.dist_string == [table(mine.html, other.html), len(mine.html), len(other.html)]
        assert r.dist_token[0] == table(r.seed_tokens.split(" "), r.obfuscated_tokens.split(" "))
        assert r.dist_ast == [tree_distance(*whole(r.seed_id), *whole(other.page_id)), len(whole(r.seed_id)[0]), len(whole(other.page_id)[0])]


def test_report_and_describe(spark):
    rows = [([4, 8, 10], [1, 2, 3], 1), ([3, 0, 3], [2, 4, 4], 0)]
    df = spark.createDataFrame(rows, "dist_token array<long>, dist_ast array<long>, result int")
    r = report.length_report(df).orderBy("label").collect()
    assert (r[1].token_delta, r[1].ast_delta, r[1].seed_length, r[0].token_delta) == (0.5, 0.5, 8, None)
    d = {x.name: x for x in report.describe(report.length_report(df), ["token_ed", "token_delta"]).collect()}
    assert (d["token_ed"]["count"], d["token_ed"].mean, d["token_ed"].q50, d["token_delta"]["count"]) == (2, 3.5, 3.5, 1)
    s = report.pair_stats(df.withColumn("stage", F.lit("x"))).first()
    assert (s.max_seed_tokens, s.max_dest_tokens) == (8, 10)


def test_token_stats(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (2, "c")], "k long, value string")
    assert tuple(report.token_stats(t, ["k"]).first()) == (5, 3, 2, 3)
    assert tuple(report.token_stats(t, ["k"], approximate=True).first()) == (5, 3, 2, 3)
    assert {r.value: r.freq for r in report.token_frequencies(t).collect()} == {"a": 3, "b": 1, "c": 1}


@pytest.mark.parametrize("limit", [0, 1, 4, 30])
def test_distance_within_a_limit(limit):
    rng = random.Random(limit)
    for _ in range(300):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = [rng.choice("abcd")] * rng.randint(0, 1)
        d = edit.edit_distance(a, b)
        assert edit.within(a, b, limit) == edit.within("".join(a), "".join(b), limit) == (d if d <= limit else None)


def test_long_sequences_with_few_edits_are_quick():
    import time

    rng = random.Random(1)
    a = [f"w{rng.randrange(1000)}" for _ in range(100_000)]
    b = list(a)
    for k in range(50):
        at = rng.randrange(len(b))
        b[at : at + (k % 3 > 0)] = ["new"] * (k % 3 < 2)
    edit.within(a[:100], b[:100], 5)
    start = time.time()
    d = edit.within(a, b, 60)
    assert time.time() - start < 1 and 40 <= d <= 50
    assert edit.within(a, b, d) == d and edit.within(a, b, d - 1) is None
    assert edit.distance(a[:6000], b[:6000]) == edit.edit_distance(a[:6000], b[:6000])


def test_costs_of_single_symbols():
    costs = Costs(1.0, 2.0, 2.5, {("a", "b"): 0.25, ("a", None): 0.5, (None, "c"): 4.0, ("b", "b"): 0.125})
    assert edit.weighted("a", "b", costs=costs) == 0.25 and edit.weighted("b", "a", costs=costs) == 2.5
    assert edit.weighted("aa", "", costs=costs) == 1.0 and edit.weighted("", "cb", costs=costs) == 5.0
    assert edit.weighted("b", "b", costs=costs) == 0.125  # named, so not free
    assert edit.weighted("xb", "b", costs=Costs(update=lambda x, y: 9.0 * (x != y))) == 1.0
    assert Costs(0.1, 0.2, 0.3).scale == 10


def test_cost_table_is_checked(spark):
    rows = spark.createDataFrame([("a", "b", 0.5), (None, "b", 1.0)], "a string, b string, cost double")
    assert cost_table(rows) == {("a", "b"): 0.5, (None, "b"): 1.0}
    for wrong in (rows.union(rows), rows.selectExpr("null as a", "null as b", "cost").limit(1), rows.selectExpr("a", "b", "null as cost")):
        with pytest.raises(ValueError):
            cost_table(wrong)
    with pytest.raises(ValueError):
        cost_table(rows, most=1)


def test_token_distance_within_of_odd_rows(spark):
    df = spark.createDataFrame([("a b c", "a c"), ("", ""), (None, "a"), ("a b", "c d e f")], "x string, y string")
    got = [r.d for r in df.select(edit.token_distance_within(F.col("x"), F.col("y"), 2).alias("d")).collect()]
    assert got == [1, 0, None, -1]


def test_edit_distance_over_many_words_is_that_of_the_table():
    draw = random.Random(23)

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, before = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(before[j] + (x != y), before[j + 1] + 1, row[-1] + 1))
        return row[-1]

    for size in (0, 1, 5, 63, 64, 65, 200):
        for _ in range(6):
            a, b = ("".join(draw.choice("abcd") for _ in range(draw.randint(0, size))) for _ in range(2))
            assert edit.edit_distance(a, b) == edit.edit_distance(list(a), list(b)) == slow(a, b)
