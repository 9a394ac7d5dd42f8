"""Registered queries: trees, distances, vectors, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlake.functions import edit, vectors as V
from pairlake.functions.draws import draw
from pairlake.functions.lexer import class_string, lex, tokens
from pairlake.operators import distances as D
from pairlake.operators import pairs as P
from pairlake.operators import perturb as E
from pairlake.operators import report as R
from pairlake.operators import splits as S
from pairlake.operators import trees as TR
from pairlake.plans.common import SEED, sql_draw, sql_pairs, sql_rank, sql_split, sql_step, table, texts
from pairlake.plans.pairing import STAGED, _staged
from pairlake.plans.perturbing import sql_inject
from pairlake.session import fan_out
from pairlake.plans.texts import _q, sql_class, sql_raw, sql_tokens

QUERIES, ORACLES = {}, {}

# ---- trees ----------------------------------------------------------------

_clean = "regexp_replace(html, '<!--.*?-->', '', 'gs')"
for _n in ("script", "style"):
    _clean = f"regexp_replace({_clean}, '(?is)(<{_n}(?:\\s[^>]*)?>).*?(</{_n}>)', '\\1\\2', 'g')"
SQL_TAGS = f"regexp_extract_all({_clean}, {_q(TR.TAG)}, 0)"
SQL_NAME = "lower(regexp_extract(x, '^</?([A-Za-z][^\\s/>]*)', 1))"
_void = ", ".join(f"'{v}'" for v in TR.VOID)
HTML_NODES = f"""
t AS (SELECT page_id, unnest({SQL_TAGS}) AS x, generate_subscripts({SQL_TAGS}, 1) - 1 AS pos FROM html_source),
n AS (SELECT page_id, pos, {SQL_NAME} AS label, starts_with(x, '</') AS close FROM t),
c AS (SELECT page_id, label, sum(CASE WHEN close THEN -1 ELSE 1 END) AS net FROM n GROUP BY ALL),
dl AS (SELECT n.*, CASE WHEN net <> 0 THEN 0 WHEN close THEN -1 ELSE 1 END AS delta FROM n JOIN c USING (page_id, label)),
rn AS (SELECT *, sum(delta) OVER (PARTITION BY page_id ORDER BY pos) AS run FROM dl),
m AS (SELECT page_id, CASE WHEN min(run) < 0 THEN 'failed' WHEN bool_or(delta = 0 AND label NOT IN ({_void})) THEN 'loose'
      ELSE 'strict' END AS mode FROM rn GROUP BY page_id),
nodes AS (SELECT page_id, mode, pos AS node_id, greatest(run + CASE WHEN delta = 0 THEN 1 ELSE 0 END, 1)::INTEGER AS depth,
      label, CASE WHEN delta = 0 THEN 'single' ELSE 'element' END AS kind FROM rn JOIN m USING (page_id)
      WHERE delta > 0 OR (delta = 0 AND NOT close))"""


HTML_NODES = "html_source AS (SELECT page_id, html FROM pages)," + HTML_NODES


def _page_nodes(s, d):
    return TR.nodes(TR.html_stream(texts(s, d, "pages"), "page_id"), "page_id")


QUERIES["html_nodes"] = lambda s, d: TR.with_parent(_page_nodes(s, d), "page_id")
ORACLES["html_nodes"] = f"""
WITH {HTML_NODES},
b AS (SELECT *, depth - 1 AS level, NULL AS o, true AS child FROM nodes
      UNION ALL SELECT *, depth, node_id, false FROM nodes WHERE kind = 'element'),
w AS (SELECT *, last_value(o IGNORE NULLS) OVER (PARTITION BY page_id, level ORDER BY node_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM b)
SELECT page_id, mode, node_id, depth, label, kind, coalesce(p, -1) AS parent_id FROM w WHERE child"""

JSON_TEXT = (
    "concat('{\"start\":', event_id, ',\"type\":\"', event_type, '\",\"body\":[', props, ',null,{\"end\":1,\"v\":[', user_id, ']}]}')"
)


def _event_json(s, d):
    return texts(s, d, "events").selectExpr("event_id", f"{JSON_TEXT} as j".replace('\\"', '"'))


def _json_nodes(s, d):
    return TR.nodes(TR.json_stream(_event_json(s, d), "event_id", "j"), "event_id")


JSON_TREE = f"""
SELECT event_id, CASE WHEN t.key IS NULL OR try_cast(t.key AS INTEGER) IS NOT NULL THEN '' ELSE t.key END AS label,
  CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE 'scalar' END AS kind
FROM (SELECT event_id, {JSON_TEXT} AS j FROM events) e, json_tree(e.j) t"""

QUERIES["json_nodes"] = lambda s, d: _json_nodes(s, d).groupBy("event_id", "mode", "label", "kind").agg(
    F.count("*").alias("nodes"))
ORACLES["json_nodes"] = f"SELECT event_id, 'strict' AS mode, label, kind, count(*) AS nodes FROM ({JSON_TREE}) GROUP BY ALL"

QUERIES["strip_keys"] = lambda s, d: TR.nodes(
    TR.strip_keys(TR.json_stream(_event_json(s, d), "event_id", "j"), "event_id", ("start", "end", "k")), "event_id"
).groupBy("event_id", "label", "kind").agg(F.count("*").alias("nodes"))
ORACLES["strip_keys"] = f"""
SELECT event_id, label, kind, count(*) AS nodes FROM ({JSON_TREE}) WHERE label NOT IN ('start', 'end', 'k') GROUP BY ALL"""

QUERIES["json_node_count"] = lambda s, d: _event_json(s, d).select("event_id", TR.json_node_count(F.col("j")).alias("n"))
ORACLES["json_node_count"] = f"SELECT event_id, count(*) AS n FROM ({JSON_TREE}) WHERE kind <> 'scalar' GROUP BY event_id"

QUERIES["html_node_count"] = lambda s, d: TR.node_count(_page_nodes(s, d), "page_id")
ORACLES["html_node_count"] = f"WITH {HTML_NODES} SELECT page_id, count(*) AS n FROM nodes GROUP BY page_id"

QUERIES["feature_vector"] = lambda s, d: TR.feature_vector(texts(s, d, "pages"), "page_id").select(
    "page_id", "lines", F.array_join(F.transform("vec", lambda x: x.cast("string")), ",").alias("vec"),
    F.element_at("features", F.lit("p")).alias("paragraphs"),
)
_tags = ", ".join(f"'{t}'" for t in TR.TEMPLATE)
_opening = f"list_transform(list_filter({SQL_TAGS}, lambda x: NOT starts_with(x, '</')), lambda x: {SQL_NAME})"
ORACLES["feature_vector"] = f"""
WITH o AS (SELECT page_id, len(regexp_split_to_array(html, '\\r\\n|\\r|\\n|\\x{{2028}}|\\x{{2029}}')) AS lines, {_opening} AS o FROM pages)
SELECT page_id, lines, array_to_string(list_concat([cast(lines AS VARCHAR)], list_transform([{_tags}],
  lambda t: cast(len(list_filter(o, lambda x: x = t)) AS VARCHAR))), ',') AS vec, len(list_filter(o, lambda x: x = 'p')) AS paragraphs FROM o"""

QUERIES["category_vector"] = lambda s, d: TR.category_vector(texts(s, d, "pages"), "page_id")
ORACLES["category_vector"] = f"WITH o AS (SELECT page_id, {_opening} AS o FROM pages) SELECT page_id, " + ", ".join(
    f"len(list_filter(o, lambda x: x IN ({', '.join(repr(t) for t in tags)}))) AS \"{g}\"" for g, tags in TR.TAG_GROUPS.items()
) + " FROM o"

QUERIES["first_subtree"] = lambda s, d: table(s, d, "events").select(
    "event_id", TR.first_subtree(F.concat(F.lit("["), F.col("props"), F.lit(",[1,{}],null]"))).alias("first")
)
ORACLES["first_subtree"] = """
SELECT event_id, cast(json_extract('[' || props || ',[1,{}],null]', '$[0]') AS VARCHAR).replace(' ', '') AS first FROM events"""


def _page_pairs(s, d):
    keys = S.with_stage(table(s, d, "pages").select("page_id"), "page_id", SEED)
    return P.make_pairs(keys, "page_id", SEED)


PAGE_STAGED = sql_split("pages", "page_id")

QUERIES["tree_bound"] = lambda s, d: TR.tree_bound(_page_pairs(s, d), "pair_id", "seed_id", "base_id", _page_nodes(s, d), "page_id")
ORACLES["tree_bound"] = f"""
WITH s AS ({PAGE_STAGED}), {sql_pairs("s", "page_id")}, {HTML_NODES},
h AS (SELECT page_id, label, count(*) AS k FROM nodes GROUP BY ALL),
b AS (SELECT pair_id, label, sum(x) AS x FROM (SELECT pair_id, label, k AS x FROM pairs JOIN h ON h.page_id = seed_id
  UNION ALL SELECT pair_id, label, -k FROM (SELECT pair_id, base_id FROM pairs) JOIN h ON h.page_id = base_id) GROUP BY ALL)
SELECT pair_id, cast((abs(sum(x)) + sum(abs(x))) / 2 AS BIGINT) AS bound FROM b GROUP BY pair_id""".replace(
    "pair_id, label, k AS x FROM pairs JOIN", "pair_id, h.label, k AS x FROM pairs JOIN").replace(
    "SELECT pair_id, label, -k FROM", "SELECT pair_id, h.label, -k FROM")

QUERIES["tree_distance"] = lambda s, d: TR.tree_distance_within(
    _page_pairs(s, d), "pair_id", "seed_id", "base_id", _page_nodes(s, d), "page_id"
)

# ---- distances ------------------------------------------------------------


def _turns(s, d):
    t = table(s, d, "conversations").select("conv_id", "turn", "text")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return t.join(nxt, ["conv_id", "turn"])


TURNS = """SELECT a.conv_id, a.turn, a.text, b.text AS reply FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""
# The SQL distance counts bytes: each character beyond ASCII of a pair is written as one control character instead.
_CONTROLS = " || ".join(f"chr({c})" for c in range(1, 32) if c not in (9, 10, 13))


def sql_lev(a, b):
    beyond = f"array_to_string(list_sort(list_distinct(regexp_extract_all({a} || {b}, '[^\\x00-\\x7F]', 0))), '')"
    one = lambda c: f"translate({c}, {beyond}, substr({_CONTROLS}, 1, length({beyond})))"
    return f"levenshtein({one(a)}, {one(b)})"


QUERIES["string_distance"] = lambda s, d: _turns(s, d).select(
    "conv_id", "turn", edit.string_distance(F.col("text"), F.col("reply")).alias("distance"),
    edit.string_distance_within(F.col("text"), F.col("reply"), 120).alias("within_120"),
)
ORACLES["string_distance"] = f"""
SELECT conv_id, turn, distance, CASE WHEN distance <= 120 THEN distance ELSE -1 END AS within_120
FROM (SELECT conv_id, turn, {sql_lev("text", "reply")} AS distance FROM ({TURNS}))"""


def _class_pairs(s, d):
    letters = texts(s, d).select("doc_id", class_string(F.col("text")).alias("text"))
    return P.attach(P.make_pairs(_staged(s, d), "doc_id", SEED), letters)


QUERIES["token_distance"] = lambda s, d: _class_pairs(s, d).select(
    "pair_id", "label", F.length("seed_text").alias("seed_length"), F.length("base_text").alias("dest_length"),
    edit.string_distance(F.col("seed_text"), F.col("base_text")).alias("token_ed"),
)
ORACLES["token_distance"] = f"""
WITH s AS ({STAGED}), {sql_pairs("s", "doc_id")},
l AS (SELECT doc_id, array_to_string(list_transform({sql_raw("text")}, lambda x: {sql_class(True)}), '') AS c FROM documents)
SELECT pair_id, label, length(a.c) AS seed_length, length(b.c) AS dest_length, levenshtein(a.c, b.c) AS token_ed
FROM pairs JOIN l a ON a.doc_id = seed_id JOIN l b ON b.doc_id = base_id"""


def _turn_tokens(s, d):
    t = fan_out(_turns(s, d), "conv_id", "turn")
    return D.token_sides(t, "text", "reply", "class")


QUERIES["weighted_distance"] = lambda s, d: _turn_tokens(s, d).select(
    "conv_id", "turn", edit.weighted_distance(F.col("seed_tokens"), F.col("obfuscated_tokens")).alias("unit"),
    edit.token_distance(F.col("seed_tokens"), F.col("obfuscated_tokens")).alias("tokens"),
)
_letters = lambda c: f"array_to_string(list_transform({sql_raw(c)}, lambda x: {sql_class(True)}), '')"
ORACLES["weighted_distance"] = f"""
SELECT conv_id, turn, cast(levenshtein({_letters("text")}, {_letters("reply")}) AS DOUBLE) AS unit,
  levenshtein({_letters("text")}, {_letters("reply")}) AS tokens FROM ({TURNS})"""

QUERIES["weighted_distance_costs"] = lambda s, d: _turn_tokens(s, d).select(
    "conv_id", "turn", edit.weighted_distance(F.col("seed_tokens"), F.col("obfuscated_tokens"), 1.0, 2.0, 2.5).alias("cost")
)


def _mixed_pages(s, d):
    pages = table(s, d, "pages").select("page_id", "html")
    made = P.attach(_page_pairs(s, d), pages, "page_id", "html")
    target = E.inject(F.col("alt_text"), F.col("base_text"), draw(SEED, "inject", "pair_id"))
    return made.select(
        "pair_id", "seed_id", "alt_id", "base_id", "rep", "label", "stage", "seed_text", target.alias("target_text")
    )


def _datapair(s, d, mode="class"):
    pages = texts(s, d, "pages").select("page_id", "html")
    return D.datapair(_mixed_pages(s, d), "seed_text", "target_text", mode=mode, to_ast=True, corpus=pages)


_join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
# No SQL for the exact tree distance: it has to lie between the difference and the sum of the sizes, both without the root.
_fits = lambda: (
    (F.get("dist_ast", F.lit(0)) >= F.abs(F.get("dist_ast", F.lit(1)) - F.get("dist_ast", F.lit(2))))
    & (F.get("dist_ast", F.lit(0)) <= F.get("dist_ast", F.lit(1)) + F.get("dist_ast", F.lit(2)) - 2)
).cast("int").alias("ast_fits")
QUERIES["datapair"] = lambda s, d: _datapair(s, d).select(
    "pair_id", "stage", "result", F.md5("seed_tokens").alias("seed_tokens"), F.md5("obfuscated_tokens").alias("obfuscated_tokens"),
    _join("dist_string"), _join("dist_token"), F.get("dist_ast", F.lit(1)).alias("seed_nodes"), F.get("dist_ast", F.lit(2)).alias("target_nodes"),
    _fits(), "seed_ast", "obfuscated_ast",
)


def _sizes(s, d):
    at = lambda c, i, name: F.get(c, F.lit(i)).alias(name)
    return _datapair(s, d).select(
        "pair_id", "stage", "result", F.md5("seed_tokens").alias("seed_tokens"), F.md5("obfuscated_tokens").alias("obfuscated_tokens"),
        at("dist_string", 1, "seed_chars"), at("dist_string", 2, "target_chars"), at("dist_ast", 1, "seed_nodes"),
        at("dist_ast", 2, "target_nodes"), at("dist_token", 0, "token_ed"), at("dist_token", 1, "seed_length"), at("dist_token", 2, "dest_length"),
    )


_letters = lambda c: f"array_to_string(list_transform({sql_raw(c)}, lambda x: {sql_class(True)}), '')"
MIXED = f"""s AS ({PAGE_STAGED}), {sql_pairs("s", "page_id")},
mx AS (SELECT pair_id, seed_id, label, stage, x.html AS seed_text, {sql_inject("y.html", "z.html", sql_draw("inject", "pair_id"))} AS target_text
  FROM pairs JOIN pages x ON x.page_id = seed_id JOIN pages y ON y.page_id = alt_id JOIN pages z ON z.page_id = base_id)"""
# (page_id, n, first): number of nodes with the root, and the first top-level subtree
SUBTREES = """
f1 AS (SELECT page_id, arg_min(depth, node_id) AS d0, min(node_id) AS n0 FROM nodes GROUP BY page_id),
f2 AS (SELECT nodes.page_id, min(node_id) AS stop FROM nodes JOIN f1 USING (page_id) WHERE node_id > n0 AND depth <= d0 GROUP BY nodes.page_id),
c2 AS (SELECT nodes.page_id, count(*) + 1 AS n, string_agg(depth || ':' || label, ' ' ORDER BY node_id) FILTER (stop IS NULL OR node_id < stop) AS first
  FROM nodes LEFT JOIN f2 USING (page_id) GROUP BY nodes.page_id)"""
PAIR_TREES = f"""{MIXED}, html_source AS (SELECT pair_id AS page_id, target_text AS html FROM mx UNION ALL SELECT 's' || page_id, html FROM pages),
{HTML_NODES[HTML_NODES.index("t AS ("):]}, {SUBTREES},
rec AS (SELECT mx.*, a.n AS seed_nodes, b.n AS target_nodes, a.first AS seed_ast, b.first AS obfuscated_ast,
  levenshtein({_letters("seed_text")}, {_letters("target_text")}) AS token_ed, len({sql_raw("seed_text")}) AS seed_length, len({sql_raw("target_text")}) AS dest_length
  FROM mx JOIN c2 a ON a.page_id = 's' || seed_id JOIN c2 b ON b.page_id = pair_id)"""
ORACLES["datapair"] = f"""
WITH {PAIR_TREES}
SELECT pair_id, stage, label AS result, md5(array_to_string({sql_tokens("seed_text")}, ' ')) AS seed_tokens,
  md5(array_to_string({sql_tokens("target_text")}, ' ')) AS obfuscated_tokens,
  {sql_lev("seed_text", "target_text")} || ',' || length(seed_text) || ',' || length(target_text) AS dist_string,
  token_ed || ',' || seed_length || ',' || dest_length AS dist_token, seed_nodes, target_nodes, 1 AS ast_fits, seed_ast, obfuscated_ast FROM rec"""
QUERIES["datapair_sizes"] = _sizes
ORACLES["datapair_sizes"] = f"""
WITH {MIXED}, html_source AS (SELECT pair_id AS page_id, target_text AS html FROM mx UNION ALL SELECT 's' || page_id, html FROM pages),
{HTML_NODES[HTML_NODES.index("t AS ("):]},
c2 AS (SELECT page_id, count(*) + 1 AS n FROM nodes GROUP BY page_id)
SELECT pair_id, stage, label AS result, md5(array_to_string({sql_tokens("seed_text")}, ' ')) AS seed_tokens,
  md5(array_to_string({sql_tokens("target_text")}, ' ')) AS obfuscated_tokens, length(seed_text) AS seed_chars, length(target_text) AS target_chars,
  a.n AS seed_nodes, b.n AS target_nodes, levenshtein({_letters("seed_text")}, {_letters("target_text")}) AS token_ed,
  len({sql_raw("seed_text")}) AS seed_length, len({sql_raw("target_text")}) AS dest_length
FROM mx JOIN c2 a ON a.page_id = 's' || seed_id JOIN c2 b ON b.page_id = pair_id"""


def _features(s, d):
    sided = D.token_sides(_mixed_pages(s, d), "seed_text", "target_text", "value")
    f = D.to_features(sided.withColumn("result", F.col("label").cast("int")))
    return f.select(F.md5("obf").alias("obf"), F.md5("org").alias("org"), "lbl")


QUERIES["to_features"] = _features
ORACLES["to_features"] = f"""
WITH {MIXED} SELECT md5(array_to_string({sql_tokens("target_text", "value")}, ' ')) AS obf, md5(array_to_string({sql_tokens("seed_text", "value")}, ' ')) AS org,
  label AS lbl FROM mx"""


def _one_pair(s, d):
    made = P.one_pair(table(s, d, "pages").select("page_id", "html"), "page_id", "html", 0, 1)
    rec = D.datapair(made.select("*", F.lit("0.1").alias("pair_id"), F.lit(0).alias("label")), "seed_text", "target_text", to_ast=True)
    return rec.select("seed_id", "target_id", "obfuscated_tokens", "seed_tokens", _join("dist_string"), _join("dist_token"),
                      F.get("dist_ast", F.lit(1)).alias("seed_nodes"), F.get("dist_ast", F.lit(2)).alias("target_nodes"), _fits(), "result", "seed_ast", "obfuscated_ast")


QUERIES["score_one_pair"] = _one_pair
ORACLES["score_one_pair"] = f"""
WITH html_source AS (SELECT page_id, html FROM pages WHERE page_id IN (0, 1)), {HTML_NODES[HTML_NODES.index("t AS ("):]}, {SUBTREES}
SELECT a.page_id::INTEGER AS seed_id, b.page_id::INTEGER AS target_id, array_to_string({sql_tokens("b.html")}, ' ') AS obfuscated_tokens,
  array_to_string({sql_tokens("a.html")}, ' ') AS seed_tokens, {sql_lev("a.html", "b.html")} || ',' || length(a.html) || ',' || length(b.html) AS dist_string,
  levenshtein({_letters("a.html")}, {_letters("b.html")}) || ',' || len({sql_raw("a.html")}) || ',' || len({sql_raw("b.html")}) AS dist_token,
  x.n AS seed_nodes, y.n AS target_nodes, 1 AS ast_fits, 0 AS result, x.first AS seed_ast, y.first AS obfuscated_ast
FROM pages a, pages b, c2 x, c2 y WHERE a.page_id = 0 AND b.page_id = 1 AND x.page_id = 0 AND y.page_id = 1"""

# ---- vectors --------------------------------------------------------------


def _vector_pairs(s, d):
    e = table(s, d, "embeddings")
    made = P.random_partner(e, "vec_id", SEED, "vector")
    left = e.select("vec_id", F.col("embedding").alias("a"), F.col("label").alias("la"))
    right = e.select(F.col("vec_id").alias("partner"), F.col("embedding").alias("b"), F.col("label").alias("lb"))
    return made.join(left, "vec_id").join(right, "partner")


VECTOR_PAIRS = f"""
r AS ({sql_rank("embeddings", "vec_id")}),
vp AS (SELECT x.vec_id, y.vec_id AS partner, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b, x.label AS la, y.label AS lb
  FROM r JOIN r q ON q.rank = {sql_step(sql_draw("vector", "r.vec_id"), "r.n", "r.rank")}
  JOIN embeddings x ON x.vec_id = r.vec_id JOIN embeddings y ON y.vec_id = q.vec_id)"""

QUERIES["cosine01"] = lambda s, d: _vector_pairs(s, d).select(
    "vec_id", "partner", F.round(V.cosine01(F.col("a"), F.col("b")), 6).alias("score"),
    V.to_label(V.cosine(F.col("a"), F.col("b"))).alias("by_cosine"),
    V.to_label(V.cosine01(F.col("a"), F.col("b")), "round").alias("by_round"),
)
ORACLES["cosine01"] = f"""
WITH {VECTOR_PAIRS} SELECT vec_id, partner, round(greatest(0, least(1, (list_cosine_similarity(a, b) + 1) / 2)), 6) AS score,
  CASE WHEN list_cosine_similarity(a, b) < 0 THEN 0 ELSE 1 END AS by_cosine,
  cast(round_even((list_cosine_similarity(a, b) + 1) / 2, 0) AS INTEGER) AS by_round FROM vp"""

QUERIES["l2_normalise"] = lambda s, d: table(s, d, "embeddings").select(
    "vec_id", V.l2_normalise(F.transform("embedding", lambda x: x * 3)).alias("u")
).select("vec_id", F.round(V.norm(F.col("u")), 6).alias("norm"), F.array_join(F.transform("u", lambda x: F.format_string("%.6f", x)), ",").alias("u"))
ORACLES["l2_normalise"] = """
SELECT vec_id, 1.0::DOUBLE AS norm, array_to_string(list_transform(e, lambda x: printf('%.6f', x / n)), ',') AS u
FROM (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))"""

QUERIES["kl_divergence"] = lambda s, d: _vector_pairs(s, d).select(
    "vec_id", "partner", "la", "lb", *[V.softmax(F.transform(c, lambda x: x.cast("double") * 5)).alias(c) for c in ("a", "b")]
).select(
    "vec_id", "partner", F.round(V.kl_divergence(F.col("a"), F.col("b")), 6).alias("kl"),
    F.round(V.overlap_penalty(F.col("a"), F.col("b"), F.col("la"), F.col("lb")), 6).alias("penalty"),
)
_soft = lambda c: (
    f"list_transform(list_transform({c}, lambda x: exp(x * 5 - list_max({c}) * 5)), lambda y: y / "
    f"list_sum(list_transform({c}, lambda x: exp(x * 5 - list_max({c}) * 5))))"
)
ORACLES["kl_divergence"] = f"""
WITH {VECTOR_PAIRS}, sm AS (SELECT vec_id, partner, la, lb, {_soft("a")} AS p, {_soft("b")} AS q FROM vp),
k AS (SELECT *, list_sum(list_transform(list_zip(p, q), lambda z: least(1, greatest(1e-7, z[1])) * ln(least(1, greatest(1e-7, z[1])) / least(1, greatest(1e-7, z[2]))))) AS kl FROM sm)
SELECT vec_id, partner, round(kl, 6) AS kl, round(CASE WHEN la <> lb THEN 1 - kl ELSE 0 END, 6) AS penalty FROM k"""

# ---- reports --------------------------------------------------------------

QUERIES["length_histogram"] = lambda s, d: R.histogram(table(s, d, "documents"), F.length("text"), 1000)
ORACLES["length_histogram"] = """
SELECT cast(ceil(length(text) / 1000.0) AS BIGINT) AS bin, count(*) AS files FROM documents GROUP BY bin"""

QUERIES["token_histogram"] = lambda s, d: R.histogram(texts(s, d), F.size(tokens(F.col("text"))), 100)
ORACLES["token_histogram"] = f"""
SELECT cast(ceil(len({sql_raw("text")}) / 100.0) AS BIGINT) AS bin, count(*) AS files FROM documents GROUP BY bin"""

QUERIES["token_frequencies"] = lambda s, d: R.token_frequencies(lex(texts(s, d), ["doc_id"], mode="value"))
ORACLES["token_frequencies"] = f"""
SELECT value, count(*) AS freq FROM (SELECT unnest({sql_tokens("text", "value")}) AS value FROM documents) GROUP BY value"""

QUERIES["token_stats"] = lambda s, d: R.token_stats(lex(texts(s, d), ["doc_id"], mode="value"), ["doc_id"])
ORACLES["token_stats"] = f"""
SELECT cast(sum(len(t)) AS BIGINT) AS tokens, (SELECT count(DISTINCT v) FROM (SELECT unnest({sql_tokens("text", "value")}) AS v FROM documents)) AS distinct_tokens,
  count(*) AS files, max(len(t)) AS max_length FROM (SELECT {sql_tokens("text", "value")} AS t FROM documents)"""

QUERIES["file_count"] = lambda s, d: R.file_count(table(s, d, "documents"), ["source"])
ORACLES["file_count"] = "SELECT source, count(*) AS files FROM documents GROUP BY source"

QUERIES["parse_outcomes"] = lambda s, d: R.outcomes(TR.html_stream(texts(s, d, "pages"), "page_id"), "page_id", "mode")
ORACLES["parse_outcomes"] = f"WITH {HTML_NODES} SELECT mode, count(*) AS files FROM m GROUP BY mode"


QUERIES["pair_stats"] = lambda s, d: R.pair_stats(_datapair(s, d))
ORACLES["pair_stats"] = f"""
WITH {MIXED} SELECT stage, max(len({sql_raw("seed_text")})) AS max_seed_tokens, max(len({sql_raw("target_text")})) AS max_dest_tokens FROM mx GROUP BY stage"""


def _report(s, d):
    r = R.length_report(_datapair(s, d).where("stage <> 'test'"))
    same = F.abs(F.col("ast_delta") * F.col("seed_ast") - F.col("ast_ed")) < 1e-6
    fits = (F.col("ast_ed") >= F.abs(F.col("seed_ast") - F.col("dest_ast"))) & (F.col("ast_ed") <= F.col("seed_ast") + F.col("dest_ast") - 2)
    return r.select("seed_length", "dest_length", "token_ed", F.round("token_delta", 9).alias("token_delta"), "seed_ast", "dest_ast",
                    (same & fits).cast("int").alias("ast_fits"), "label")


QUERIES["length_report"] = _report
ORACLES["length_report"] = f"""
WITH {PAIR_TREES} SELECT seed_length, dest_length, token_ed, round(token_ed / seed_length, 9) AS token_delta, seed_nodes AS seed_ast, target_nodes AS dest_ast,
  1 AS ast_fits, label FROM rec WHERE stage <> 'test'"""


def _describe(s, d):
    t = texts(s, d).select("n_chars", F.length("text").alias("chars"), F.size(tokens(F.col("text"))).alias("n_tokens"))
    r = R.describe(t, ["n_chars", "chars", "n_tokens"])
    return r.select("name", "count", *[F.round(c, 6).alias(c) for c in r.columns[2:]])


QUERIES["describe"] = _describe
ORACLES["describe"] = f"""
WITH t AS (SELECT unnest([{{'name': 'n_chars', 'v': n_chars}}, {{'name': 'chars', 'v': length(text)}}, {{'name': 'n_tokens', 'v': len({sql_raw("text")})}}], recursive := true) FROM documents)
SELECT name, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v)::DOUBLE, 6) AS min,
  round(quantile_cont(v, 0.25)::DOUBLE, 6) AS q25, round(quantile_cont(v, 0.5)::DOUBLE, 6) AS q50, round(quantile_cont(v, 0.75)::DOUBLE, 6) AS q75, round(max(v)::DOUBLE, 6) AS max
FROM t GROUP BY name"""
