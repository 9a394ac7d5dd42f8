"""Trees: node tables, counts, vectors, distances."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from pairlake.functions import treedist
from pairlake.functions.costs import Costs
from pairlake.operators import trees


def html(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "k long, html string")


def nodes_of(spark, *texts):
    return trees.nodes(trees.html_stream(html(spark, *texts), "k"), "k")


def test_html_nodes_and_parents(spark):
    text = "<html><!-- <b> --><body><script>var t='</p>';</script><p>x<br>y</p><IMG src='a'></body></html>"
    rows = trees.with_parent(nodes_of(spark, text), "k").orderBy("node_id").collect()
    by_id = {r.node_id: r.label for r in rows}
    assert [(r.label, r.depth, by_id.get(r.parent_id)) for r in rows] == [
        ("html", 1, None), ("body", 2, "html"), ("script", 3, "body"), ("p", 3, "body"), ("br", 4, "p"), ("img", 3, "body")]
    assert {r["mode"] for r in rows} == {"strict"}


def test_html_modes(spark):
    rows = nodes_of(spark, "<div><p>a<p>b</div>", "</div><div>", "<br>").select("k", "mode").distinct().collect()
    assert {r.k: r["mode"] for r in rows} == {0: "loose", 1: "failed", 2: "strict"}


def test_html_depths_agree_with_a_stack(spark):
    import re
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {}
    for r in trees.with_parent(trees.nodes(trees.html_stream(pages, "page_id"), "page_id"), "page_id").collect():
        got.setdefault(r.page_id, []).append((r.node_id, r.label, r.depth, r.parent_id))
    for page in pages.collect():
        clean = re.sub("(?s)<!--.*?-->", "", page.html)
        for n in ("script", "style"):
            clean = re.sub(rf"(?is)(<{n}\b[^>]*>).*?(</{n}>)", r"\1\2", clean)
        tags = [(m.group(1).lower(), m.group(0).startswith("</")) for m in re.finditer(r"</?([A-Za-z][A-Za-z0-9]*)[^>]*>", clean)]
        net = {}
        for n, c in tags:
            net[n] = net.get(n, 0) + (-1 if c else 1)
        stack, want = [], []
        for i, (n, c) in enumerate(tags):
            if net[n]:
                if not c:
                    want.append((i, n, len(stack) + 1, stack[-1] if stack else -1))
            elif c:
                stack.pop()
            else:
                want.append((i, n, len(stack) + 1, stack[-1] if stack else -1))
                stack.append(i)
        assert sorted(got[page.page_id]) == want


def json_frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "k long, j string")


@pytest.mark.parametrize("text,want", [
    ('{"a":[1,{"b":null}],"c":2}', 4), ("null", 1), ("5", 0), ("[]", 1), ('{"null": "null", "x": [null, null]}', 4), ('{"a{[": "}]"}', 1),
])
def test_json_node_count(spark, text, want):
    df = json_frame(spark, text)
    assert df.select(trees.json_node_count(F.col("j")).alias("n")).first().n == want
    counted = trees.node_count(trees.nodes(trees.json_stream(df, "k", "j"), "k"), "k").collect()
    assert counted[0].n == want


def test_json_modes_and_labels(spark):
    df = json_frame(spark, '{"a": {"b": [1, "x"]}}', "{a: [}", "{]")
    rows = trees.nodes(trees.json_stream(df, "k", "j"), "k").orderBy("k", "node_id").collect()
    assert [(r.label, r.kind, r.depth) for r in rows if r.k == 0] == [("", "object", 1), ("a", "object", 2), ("b", "array", 3), ("", "scalar", 4), ("", "scalar", 4)]
    assert {r.k: r["mode"] for r in rows} == {0: "strict", 1: "failed", 2: "loose"}


def test_strip_keys_takes_the_subtree(spark):
    df = json_frame(spark, '{"start":1,"end":{"a":[{"start":{}}]},"x":{"start":[1,2],"y":{"end":null,"z":3}}}')
    rows = trees.nodes(trees.strip_keys(trees.json_stream(df, "k", "j"), "k", ("start", "end")), "k").orderBy("node_id").collect()
    assert [r.label for r in rows] == ["", "x", "y", "z"]


def test_first_subtree(spark):
    rows = json_frame(spark, '[{"a": 1}, 2]', "[]", "no").select(trees.first_subtree(F.col("j")).alias("f")).collect()
    assert [r.f for r in rows] == ['{"a":1}', None, None]


def test_vectors(spark):
    df = html(spark, "<p>a\n<p>b</p><table><tr><td></table>")
    r = trees.feature_vector(df, "k").first()
    assert r.lines == 2 and len(r.vec) == 1 + len(trees.TEMPLATE) and r.features["p"] == 2 and r.features["h1"] == 0 and sum(r.vec) == 2 + 5
    c = trees.category_vector(df, "k").first()
    assert (c.block, c.table, c.heading) == (2, 3, 0)


def forest(depths, labels):
    roots, stack = [], []
    for d, label in zip(depths, labels):
        node = (label, [])
        while stack and stack[-1][0] >= d:
            stack.pop()
        (stack[-1][1][1] if stack else roots).append(node)
        stack.append((d, node))
    freeze = lambda n: (n[0], tuple(map(freeze, n[1])))
    return tuple(map(freeze, roots))


@functools.lru_cache(None)
def brute(f, g):
    size = lambda x: sum(1 + size(n[1]) for n in x)
    if not f or not g:
        return size(f) + size(g)
    v, w = f[-1], g[-1]
    return min(brute(f[:-1] + v[1], g) + 1, brute(f, g[:-1] + w[1]) + 1, brute(v[1], w[1]) + brute(f[:-1], g[:-1]) + (v[0] != w[0]))


@pytest.mark.parametrize("seed", [0, 48])
def test_tree_distance_is_exact(seed):
    rng = random.Random(seed)

    def tree():
        depths = [0]
        for _ in range(rng.randint(0, 7)):
            depths.append(rng.randint(1, depths[-1] + 1))
        return depths, [rng.choice("abc") for _ in depths]

    for _ in range(600):
        a, b = tree(), tree()
        d = treedist.tree_distance(*a, *b)
        assert d == brute(forest(*a), forest(*b)) == treedist.tree_distance(*b, *a)


def test_forest_within_is_exact():
    rng, hits = random.Random(9), 0

    def tree(most):
        depths = [1]
        for _ in range(rng.randint(0, most)):
            depths.append(rng.randint(1, depths[-1] + 1))
        return depths, [rng.choice("ab") for _ in depths]

    text = lambda t: " ".join(f"{d}:{x}" for d, x in zip(*t))
    for _ in range(300):
        a, b = tree(3), tree(6)
        at, down = rng.randint(0, len(b[0])), rng.randint(0, 2)
        before = b[0][at - 1] if at else 0
        mixed = (b[0][:at] + [d + min(down, before) for d in a[0]] + b[0][at:], b[1][:at] + a[1] + b[1][at:])
        for other in (b, mixed):
            want = brute((("", forest(*a)),), (("", forest(*other)),))
            hits += treedist.forest_within(*a, *other)
            assert trees._text_distance(text(a), text(other), 1, 1, None) == want
            assert trees._text_distance(text(other), text(a), 1, 1, None) == want
    assert hits > 300


def test_tree_costs():
    assert treedist.tree_distance([0, 1], ["r", "x"], [0], ["r"], insert=1, remove=3) == 3
    assert treedist.tree_distance([0], ["a"], [0], ["b"], update=lambda x, y: 0.5 * (x != y)) == 0.5


def test_whole_trees_of_many_shapes_are_exact():
    """Deep, broad and lopsided ones, where paths nest on both sides; none is trimmed away."""
    rng = random.Random(3)

    def tree(size, deep):
        depths = [0]
        while len(depths) < size:
            depths.append(depths[-1] + 1 if rng.random() < deep else rng.randint(1, depths[-1] + 1))
        return depths, [rng.choice("ab") for _ in depths]

    for _ in range(60):
        a, b = tree(rng.randint(5, 11), rng.random()), tree(rng.randint(5, 11), rng.random())
        plain = treedist._distance(*[treedist.Forest(*treedist.post_order(*t)) for t in (a, b)], treedist.Costs())
        turned = treedist._distance(*[treedist.Forest(*treedist.post_order(*t)).mirrored() for t in (a, b)], treedist.Costs())
        assert plain == turned == brute(forest(*a), forest(*b)) == treedist.tree_distance(*a, *b)


@functools.lru_cache(None)
def brute_costs(f, g, costs):
    names = dict(costs)
    cost = lambda x, y, plain: names.get((x, y), plain)
    gone = lambda x: sum(cost(n[0], None, 2) + gone(n[1]) for n in x)
    made = lambda x: sum(cost(None, n[0], 0.5) + made(n[1]) for n in x)
    if not f or not g:
        return gone(f) + made(g)
    v, w = f[-1], g[-1]
    return min(
        brute_costs(f[:-1] + v[1], g, costs) + cost(v[0], None, 2), brute_costs(f, g[:-1] + w[1], costs) + cost(None, w[0], 0.5),
        brute_costs(v[1], w[1], costs) + brute_costs(f[:-1], g[:-1], costs) + cost(v[0], w[0], 0 if v[0] == w[0] else 1.25))


def test_tree_distance_with_a_cost_table():
    rng = random.Random(4)
    table = {("a", "b"): 0.25, ("b", "a"): 3.0, ("a", None): 0.75, (None, "c"): 7.0, ("c", "c"): 0.125, (None, "a"): 0.0}

    def tree():
        depths = [rng.randint(0, 0)]
        for _ in range(rng.randint(0, 5)):
            depths.append(rng.randint(0, depths[-1] + 1))
        return depths, [rng.choice("abc") for _ in depths]

    costs = treedist.Costs(0.5, 2, 1.25, table)
    for _ in range(200):
        a, b = tree(), tree()
        assert treedist.tree_distance(*a, *b, costs=costs) == brute_costs(forest(*a), forest(*b), tuple(table.items()))
        by_call = treedist.Costs(0.5, 2, lambda x, y: 0 if x == y else 1.25, table)
        assert treedist.tree_distance(*a, *b, costs=by_call) == pytest.approx(treedist.tree_distance(*a, *b, costs=costs))
    for wrong in ({"insert": -1}, {"update": float("inf")}, {"table": {("a", "b"): float("nan")}}):
        with pytest.raises(ValueError):
            treedist.Costs(**wrong)


def test_trimmed_trees_leave_what_differs():
    one = treedist.Forest(*treedist.post_order([0, 1, 2, 1, 1], list("rabcd")))
    two = treedist.Forest(*treedist.post_order([0, 1, 2, 1, 2, 1], list("rabxyd")))
    a, b = treedist.trimmed(one, two)
    assert a.labels == ["c"] and b.labels == ["y", "x"]
    assert [len(t.labels) for t in treedist.trimmed(one, one)] == [0, 0]


def page(rows, seed):
    """Depths and labels of a page with a long table and some changed cells."""
    rng = random.Random(seed)
    depths, labels = [0, 1], ["html", "body"]
    while len(depths) < rows:
        depths += [2, 3, 4, 4, 5, 4, 3, 4, 5, 5]
        labels += ["div", "p", "a", rng.choice(["b", "i"]), "em", "span", "ul", rng.choice(["li", "dt"]), "a", rng.choice(["img", "br"])]
    return depths[:rows], labels[:rows]


def test_pages_of_many_nodes_take_little_memory():
    import resource
    import time

    a, b = page(4_000, 1), page(4_000, 2)
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    d = treedist.tree_distance(*a, *b)
    assert 0 < d < 2_000 and time.time() - start < 60
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def test_bound_and_limit(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    ids = [r.page_id for r in pages.select("page_id").orderBy("page_id").collect()]
    made = spark.createDataFrame([(f"{a}-{b}", a, b) for a, b in zip(ids, ids[1:] + ids[:1])] + [("same", ids[0], ids[0])], "pair_id string, a long, b long")
    tree = trees.nodes(trees.html_stream(pages, "page_id"), "page_id")
    bound = {r.pair_id: r.bound for r in trees.tree_bound(made, "pair_id", "a", "b", tree, "page_id").collect()}
    exact = {r.pair_id: r.distance for r in trees.tree_distance_within(made, "pair_id", "a", "b", tree, "page_id").collect()}
    assert exact["same"] == bound["same"] == 0 and len(bound) == len(exact) == len(ids) + 1
    assert all(bound[p] <= exact[p] for p in exact)
    limit = sorted(bound.values())[len(bound) // 2]
    for r in trees.tree_distance_within(made, "pair_id", "a", "b", tree, "page_id", limit).collect():
        assert r.exact == (bound[r.pair_id] <= limit) and r.distance == (exact if r.exact else bound)[r.pair_id]


def test_structure_bounds_the_distance(spark):
    rng = random.Random(6)
    tags = ["b", "i", "p", "u"]

    def html_of(size):
        marks, opened = [], []
        for _ in range(size):
            while opened and rng.random() < 0.5:
                marks.append(f"</{opened.pop()}>")
            opened.append(rng.choice(tags))
            marks.append(f"<{opened[-1]}>")
        return "".join(marks) + "".join(f"</{t}>" for t in reversed(opened))

    texts = [html_of(rng.randint(0, 14)) for _ in range(40)]
    tree = nodes_of(spark, *texts)
    made = spark.createDataFrame([(f"{a}-{b}", a, b) for a in range(0, 40, 2) for b in range(1, 40, 6)], "pair_id string, a long, b long")
    exact = {r.pair_id: r.distance for r in trees.tree_distance_within(made, "pair_id", "a", "b", tree, "k").collect()}
    by_structure = {r.pair_id: r.bound for r in trees.structure_bound(made, "pair_id", "a", "b", tree, "k").collect()}
    by_labels = {r.pair_id: r.bound for r in trees.tree_bound(made, "pair_id", "a", "b", tree, "k").collect()}
    assert len(exact) == len(by_structure) == 140 and all(by_structure[p] <= exact[p] and by_labels[p] <= exact[p] for p in exact)
    limit = 4
    skipped = [r for r in trees.tree_distance_within(made, "pair_id", "a", "b", tree, "k", limit).collect() if not r.exact]
    assert {r.pair_id for r in skipped} == {p for p in exact if max(by_structure[p], by_labels[p]) > limit}
    assert all(r.distance <= exact[r.pair_id] for r in skipped)
    print(f"skipped {len(skipped)} of {len(exact)}, by labels alone {sum(by_labels[p] > limit for p in exact)}")
    with pytest.raises(ValueError):
        trees.tree_distance_within(made, "pair_id", "a", "b", tree, "k", limit, treedist.Costs(insert=2))


def test_select_children(spark):
    df = json_frame(spark, '{"a":1,"b":{"a":[{"c":{}}]},"x":{"a":[1,2],"b":{"x":null,"z":3}}}')
    rows = trees.nodes(trees.select_children(trees.json_stream(df, "k", "j"), "k", ("a", "b")), "k").orderBy("node_id").collect()
    assert [(r.label, r.depth) for r in rows] == [("", 1), ("a", 2), ("b", 2), ("a", 3), ("", 4)]


def test_small_tree_costs_by_column(spark):
    row = spark.range(1).select(trees.tree_distance(F.lit("1:a 2:b"), F.lit("1:a 2:c 2:d"), insert=2, table={("b", "c"): 0.5}).alias("d")).first()
    assert row.d == 2.5


def test_windows_over_json_tokens_shuffle_no_tokens(spark):
    df = spark.createDataFrame([(k, '{"a":[1,{"k":null}],"b":2}') for k in range(9)] + [(3, "[1]"), (None, "[]")], "k long, j string")
    made = trees.nodes(trees.strip_keys(trees.json_stream(df, "k", "j"), "k", ["k"]), "k").groupBy("k", "label").agg(F.count("*").alias("n"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange")
    found = {(r.k, r.label): r.n for r in made.collect()}
    assert found[1, "a"] == 1 and (1, "k") not in found and found[3, ""] == found[1, ""] + 2 and found[None, ""] == 1


def test_small_trees_together_have_the_distances_of_each_pair_alone():
    draw = random.Random(17)

    def tree(most):
        depth, out = 0, []
        for _ in range(draw.randint(0, most)):
            depth = draw.randint(1, depth + 1)
            out.append((depth, draw.choice(["a", "b", "", "k:v"])))
        return [d for d, _ in out], [x for _, x in out]

    pairs = [(tree(5), tree(5)) for _ in range(1500)] + [(tree(25), tree(25)) for _ in range(20)]
    table = {("a", "b"): 0.5, ("a", None): 2.0, ("b", "b"): 0.25, (None, ""): 3.0}
    for costs in (Costs(), Costs(1.0, 1.5, 2.0, table), Costs(0.5, 1.0, 3.0), Costs(1.0, 1.0, lambda x, y: len(x + y) / 3)):
        assert treedist.tree_distances(pairs, costs) == [treedist.tree_distance(*a, *b, costs=costs) for a, b in pairs]
    assert treedist.tree_distances([], Costs()) == []
