"""Registered queries: own costs, limits, exact tree distances and bounds by structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlake.functions import edit
from pairlake.functions.costs import Costs, cost_table
from pairlake.operators import trees as TR
from pairlake.plans.common import sql_pairs, table
from pairlake.plans.measuring import ORACLES as ORACLES_OF_PAGES
from pairlake.plans.measuring import HTML_NODES, JSON_TEXT, PAGE_STAGED, TURNS, _event_json, _letters, _page_nodes, _page_pairs, _turn_tokens
from pairlake.plans.texts import sql_tokens

QUERIES, ORACLES = {}, {}

# ---- limits ---------------------------------------------------------------

LIMITS = (3, 20, 60)
QUERIES["token_distance_within"] = lambda s, d: _turn_tokens(s, d).select(
    "conv_id", "turn", *[edit.token_distance_within(F.col("seed_tokens"), F.col("obfuscated_tokens"), n).alias(f"within_{n}") for n in LIMITS])
ORACLES["token_distance_within"] = "SELECT conv_id, turn, " + ", ".join(
    f"CASE WHEN v <= {n} THEN v ELSE -1 END AS within_{n}" for n in LIMITS
) + f" FROM (SELECT conv_id, turn, levenshtein({_letters('text')}, {_letters('reply')}) AS v FROM ({TURNS}))"

# ---- own costs of tokens --------------------------------------------------

#: Costs of single token classes: of a change, of a removal (no second), of an insertion (no first).
TOKEN_COSTS = [("name", "num", 0.25), ("num", "name", 1.5), ("string", None, 4.0), (None, "string", 0.5), ("name", "name", 0.125), (None, "num", 2.0)]


def _costs(s, rows):
    return cost_table(s.createDataFrame(rows, "a string, b string, cost double"))


QUERIES["weighted_distance_table"] = lambda s, d: _turn_tokens(s, d).select(
    "conv_id", "turn",
    edit.weighted_distance(F.col("seed_tokens"), F.col("obfuscated_tokens"), 1.0, 2.0, 2.5, _costs(s, TOKEN_COSTS)).alias("cost"))


def sql_cost(x: str, y: str, rows, insert: float, remove: float, update: float) -> str:
    """The cost of changing ``x`` to ``y``; either may be NULL."""
    named = " ".join(
        f"WHEN {x} {'IS NULL' if a is None else f'= {chr(39)}{a}{chr(39)}'} AND {y} {'IS NULL' if b is None else f'= {chr(39)}{b}{chr(39)}'} THEN {c}"
        for a, b, c in rows if (x != "NULL" or a is None) and (y != "NULL" or b is None) and (x == "NULL" or a is not None) and (y == "NULL" or b is not None))
    plain = insert if x == "NULL" else remove if y == "NULL" else f"CASE WHEN {x} = {y} THEN 0 ELSE {update} END"
    return f"(CASE {named} ELSE {plain} END)" if named else f"({plain})"


def sql_weighted(rows, insert: float, remove: float, update: float) -> str:
    """(conv_id, turn, cost): the table of prefixes, a row of it per step.

    A row's minima from left to right are taken with the cost of the insertions left out.
    """
    cost = lambda x, y: sql_cost(x, y, rows, insert, remove, update)
    return f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, {sql_tokens("text")} AS a, {sql_tokens("reply")} AS b FROM ({TURNS})),
u AS (SELECT *, list_reduce(list_concat([[0.0::DOUBLE]], list_transform(b, lambda y: [{cost("NULL", "y")}::DOUBLE])),
  lambda p, q: list_append(p, p[-1] + q[1])) AS upto FROM t),
r(conv_id, turn, i, line) AS (
  SELECT conv_id, turn, 0, upto FROM u
  UNION ALL
  SELECT conv_id, turn, i + 1, list_transform(list_reduce(list_transform(best, lambda v, j: [v - upto[j]]),
      lambda p, q: list_append(p, least(p[-1], q[1]))), lambda v, j: v + upto[j])
  FROM (SELECT r.conv_id, r.turn, i, upto, list_transform(line, lambda v, j: least(v + {cost("a[i + 1]", "NULL")},
      CASE WHEN j > 1 THEN line[j - 1] + {cost("a[i + 1]", "b[j - 1]")} END)) AS best
    FROM r JOIN u ON u.conv_id = r.conv_id AND u.turn = r.turn WHERE i < len(a)))
SELECT r.conv_id, r.turn, line[-1] AS cost FROM r JOIN u ON u.conv_id = r.conv_id AND u.turn = r.turn WHERE i = len(a)"""


ORACLES["weighted_distance_table"] = sql_weighted(TOKEN_COSTS, 1.0, 2.0, 2.5)
ORACLES["weighted_distance_costs"] = sql_weighted([], 1.0, 2.0, 2.5)

# ---- exact distances of small trees ---------------------------------------

#: A tree of five or six nodes from each event, in one of four shapes.
SHAPES = (
    """concat('{"', event_type, '":[', props, ',null]}')""",
    """concat('{"', event_type, '":{"k":', user_id, ',"v":[1]}}')""",
    """concat('{"u":', props, ',"', event_type, '":null,"v":7}')""",
    """concat('{"', event_type, '":[[1],', props, ']}')""",
)
#: Labels and depths of their nodes, in document order.
SHAPE_NODES = (
    ("['', event_type, '', 'k', '']", "[1, 2, 3, 4, 3]"), ("['', event_type, 'k', 'v', '']", "[1, 2, 3, 3, 4]"),
    ("['', 'u', 'k', event_type, 'v']", "[1, 2, 3, 2, 2]"), ("['', event_type, '', '', '', 'k']", "[1, 2, 3, 4, 3, 4]"),
)
LABEL_COSTS = [("k", "v", 0.25), ("u", None, 0.5), (None, "v", 3.0), ("click", "view", 0.5), ("", "k", 0.75), (None, "", 0.25)]


def _small_trees(s, d):
    """The events' trees, and pairs of an event with one of the next few."""
    events = table(s, d, "events").select("event_id", "event_type", "props", "user_id")
    shaped = "CASE event_id % 4 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(SHAPES)) + " END"
    texts_ = events.selectExpr("event_id", f"{shaped} AS j")
    nodes = TR.nodes(TR.json_stream(texts_, "event_id", "j"), "event_id")
    partner = events.select(F.col("event_id").alias("other"))
    pairs = events.select("event_id", (F.col("event_id") + 1 + F.col("user_id") % 6).alias("other")).join(partner, "other")
    return pairs.select(F.concat_ws("-", "event_id", "other").alias("pair_id"), "event_id", "other"), nodes


def _small_tree_distance(s, d):
    pairs, nodes = _small_trees(s, d)
    plain = TR.tree_distance_within(pairs, "pair_id", "event_id", "other", nodes, "event_id")
    own = TR.tree_distance_within(
        pairs, "pair_id", "event_id", "other", nodes, "event_id", costs=Costs(1.0, 1.5, 2.0, _costs(s, LABEL_COSTS)))
    return plain.select("pair_id", "distance").join(own.select("pair_id", F.col("distance").alias("cost")), "pair_id")


_shape = lambda k: "CASE event_id % 4 " + " ".join(f"WHEN {n} THEN {x[k]}" for n, x in enumerate(SHAPE_NODES)) + " END"
_held = lambda n, k, i: f"(list_min({n}[{k} + 1:{i}]) > {n}[{k}])"
_label_cost = lambda x, y: sql_cost(x, y, LABEL_COSTS, 1.0, 1.5, 2.0)
QUERIES["small_tree_distance"] = _small_tree_distance
# All ways to keep nodes of one tree for nodes of the other that leave order and descent alone; the cheapest of them.
ORACLES["small_tree_distance"] = f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, {_shape(0)} AS l, {_shape(1)} AS d FROM events),
p AS (SELECT a.event_id, b.event_id AS other, a.l AS la, a.d AS da, b.l AS lb, b.d AS db FROM e a JOIN e b ON b.event_id = a.event_id + 1 + a.user_id % 6),
m(la, da, lb, db, js) AS (
  SELECT DISTINCT la, da, lb, db, []::BIGINT[] FROM p
  UNION ALL
  SELECT la, da, lb, db, list_append(js, j) FROM (SELECT *, len(js) + 1 AS i, unnest(range(0, len(lb) + 1)) AS j FROM m WHERE len(js) < len(la))
  WHERE j = 0 OR len(list_filter(range(1, i), lambda k: js[k] > 0 AND NOT (js[k] < j AND {_held("da", "k", "i")} = {_held("db", "js[k]", "j")}))) = 0),
c AS (SELECT la, da, lb, db,
    min(len(la) + len(lb) - list_sum(list_transform(js, lambda j, i: CASE WHEN j = 0 THEN 0 WHEN la[i] = lb[j] THEN 2 ELSE 1 END))) AS distance,
    min(list_sum(list_transform(js, lambda j, i: CASE WHEN j = 0 THEN {_label_cost("la[i]", "NULL")} ELSE {_label_cost("la[i]", "lb[j]")} END))
      + coalesce(list_sum(list_transform(list_filter(range(1, len(lb) + 1), lambda j: NOT list_contains(js, j)), lambda j: {_label_cost("NULL", "lb[j]")})), 0)) AS cost
  FROM m WHERE len(js) = len(la) GROUP BY la, da, lb, db)
SELECT event_id || '-' || other AS pair_id, cast(distance AS BIGINT) AS distance, cast(cost AS DOUBLE) AS cost
FROM p JOIN c USING (la, da, lb, db)"""

# ---- bounds by structure --------------------------------------------------


def _structure(s, d):
    pairs, nodes = _page_pairs(s, d), _page_nodes(s, d)
    found = TR.structure_bound(pairs, "pair_id", "seed_id", "base_id", nodes, "page_id").withColumnRenamed("bound", "by_structure")
    labels = TR.tree_bound(pairs, "pair_id", "seed_id", "base_id", nodes, "page_id").withColumnRenamed("bound", "by_labels")
    return found.join(labels, "pair_id").withColumn("bound", F.greatest("by_structure", "by_labels"))


QUERIES["structure_bound"] = _structure
ORACLES["structure_bound"] = f"""
WITH s AS ({PAGE_STAGED}), {sql_pairs("s", "page_id")}, {HTML_NODES},
o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY node_id) AS n FROM nodes),
h AS (SELECT a.page_id, a.n, a.label, a.depth, min(b.n) FILTER (b.depth <= a.depth) AS nx FROM o a LEFT JOIN o b ON a.page_id = b.page_id AND b.n > a.n GROUP BY ALL),
g AS (SELECT h.page_id, h.label, CASE WHEN c.depth > h.depth THEN '=' || c.label ELSE '' END AS child, CASE WHEN x.depth = h.depth THEN '=' || x.label ELSE '' END AS sibling
  FROM h LEFT JOIN o c ON c.page_id = h.page_id AND c.n = h.n + 1 LEFT JOIN o x ON x.page_id = h.page_id AND x.n = h.nx
  UNION ALL SELECT page_id, NULL, '=' || label, '' FROM o WHERE n = 1),
k AS (SELECT page_id, label, child, sibling, count(*) AS k FROM g GROUP BY ALL),
f AS (SELECT pair_id, label, child, sibling, sum(x) AS x FROM (SELECT pair_id, k.label, child, sibling, k AS x FROM pairs JOIN k ON k.page_id = seed_id
  UNION ALL SELECT pair_id, k.label, child, sibling, -k FROM pairs JOIN k ON k.page_id = base_id) GROUP BY ALL),
y AS (SELECT pair_id, cast(ceil(sum(abs(x)) / 5) AS BIGINT) AS by_structure FROM f GROUP BY pair_id),
l AS (SELECT page_id, label, count(*) AS k FROM nodes GROUP BY ALL),
w AS (SELECT pair_id, label, sum(x) AS x FROM (SELECT pair_id, l.label, k AS x FROM pairs JOIN l ON l.page_id = seed_id
  UNION ALL SELECT pair_id, l.label, -k FROM pairs JOIN l ON l.page_id = base_id) GROUP BY ALL),
z AS (SELECT pair_id, cast((abs(sum(x)) + sum(abs(x))) / 2 AS BIGINT) AS by_labels FROM w GROUP BY pair_id)
SELECT pair_id, coalesce(by_structure, 0) AS by_structure, coalesce(by_labels, 0) AS by_labels, greatest(coalesce(by_structure, 0), coalesce(by_labels, 0)) AS bound
FROM pairs LEFT JOIN y USING (pair_id) LEFT JOIN z USING (pair_id)"""

# ---- children -------------------------------------------------------------

CHILDREN = ("body", "v", "k")
QUERIES["select_children"] = lambda s, d: TR.nodes(
    TR.select_children(TR.json_stream(_event_json(s, d), "event_id", "j"), "event_id", CHILDREN), "event_id"
).groupBy("event_id", "label", "kind", "depth").agg(F.count("*").alias("nodes"))
ORACLES["select_children"] = f"""
SELECT event_id, CASE WHEN key IS NULL OR try_cast(key AS INTEGER) IS NOT NULL THEN '' ELSE key END AS label,
  CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE 'scalar' END AS kind,
  cast(1 + len(regexp_extract_all(fullkey, '[.\\[]')) AS INTEGER) AS depth, count(*) AS nodes
FROM (SELECT e.event_id, t.key, t.type, t.fullkey FROM (SELECT event_id, {JSON_TEXT} AS j FROM events) e, json_tree(e.j) t)
WHERE len(list_filter(regexp_extract_all(fullkey, '\\."?([^."\\[]+)', 1), lambda x: x NOT IN ('body', 'v', 'k'))) = 0
GROUP BY ALL"""

# ---- differences of tag vectors ---------------------------------------------


def _tag_difference(s, d):
    made = TR.vector_difference(_page_pairs(s, d), "pair_id", "seed_id", "base_id", TR.feature_vector(table(s, d, "pages"), "page_id"), "page_id")
    return made.select("pair_id", F.array_join(F.transform("difference", lambda x: x.cast("string")), ",").alias("difference"), "total")


QUERIES["tag_difference"] = _tag_difference
ORACLES["tag_difference"] = f"""
WITH s AS ({PAGE_STAGED}), {sql_pairs("s", "page_id")},
v AS (SELECT page_id, list_transform(string_split(vec, ','), lambda x: cast(x AS BIGINT)) AS v FROM ({ORACLES_OF_PAGES["feature_vector"]})),
d AS (SELECT pair_id, list_transform(a.v, lambda x, i: x - b.v[i]) AS d FROM pairs JOIN v a ON a.page_id = seed_id JOIN v b ON b.page_id = base_id)
SELECT pair_id, array_to_string(list_transform(d, lambda x: cast(x AS VARCHAR)), ',') AS difference, cast(list_sum(list_transform(d, lambda x: abs(x))) AS BIGINT) AS total FROM d"""
