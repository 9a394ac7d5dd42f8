"""Trees of HTML and JSON texts as node tables, node counts, feature vectors.

A text becomes a stream of opening, closing and single nodes; depth is a
running sum over it and the parent a last-value window. Both windows run per
document, so their size is that of one text.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pairlake.functions.bind import let
from pairlake.functions.costs import Costs, Table
from pairlake.functions.lexer import js_escape
from pairlake.functions.lexing import escaped
from pairlake.functions.text import line_count
from pairlake.functions.treedist import forest_within, tree_distance as _pair_distance, tree_distances
from pairlake.session import by_key, fan_out

# HTML elements without content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
# The counted tags in vector order, by group.
TAG_GROUPS = {
    "section": ("html", "head", "body", "header", "footer", "main", "nav", "section", "article", "aside", "div"),
    "heading": ("title", "h1", "h2", "h3", "h4", "h5", "h6"),
    "block": ("p", "pre", "blockquote", "figure", "figcaption", "hr", "br"),
    "inline": ("a", "span", "b", "i", "em", "strong", "code", "small", "sub", "sup"),
    "list": ("ul", "ol", "li", "dl", "dt", "dd"),
    "table": ("table", "thead", "tbody", "tr", "th", "td"),
    "form": ("form", "input", "label", "select", "option", "textarea", "button"),
    "media": ("img", "video", "audio", "source", "iframe"),
    "meta": ("meta", "link", "style", "script", "noscript"),
}
#: Nodes up to which trees are small: their distances go together.
SMALL_TREE = 16
TEMPLATE = tuple(tag for tags in TAG_GROUPS.values() for tag in tags)

# Fixed value: a tag. The name reaches to a blank, '/' or '>'; a '>' in a quoted value does not end
# it, unless the quote is never closed.
TAG = """</?[A-Za-z][^\\s/>]*(?:[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>|[^>]*>)"""
TAG_NAME = "^</?([A-Za-z][^\\s/>]*)"


def raw_tags(html: Column) -> Column:
    """Tags in order, comments and the bodies of script and style left out."""
    out = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    for name in ("script", "style"):
        out = F.regexp_replace(out, f"(?is)(<{name}(?:\\s[^>]*)?>).*?(</{name}>)", "$1$2")
    return F.regexp_extract_all(out, F.lit(TAG), F.lit(0))


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, TAG_NAME, 1))


def html_stream(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, mode, pos, label, kind, delta): the tags that count.

    A name whose opening and closing tags differ in number inside a text is a
    single node there. mode: 'strict' if only void elements are single, 'loose'
    if others are, 'failed' if a closing tag comes before its opening tag.
    """
    tags = df.select(key, F.transform(raw_tags(F.col(html)), lambda t: F.struct(
        tag_name(t).alias("name"), t.startswith("</").alias("close"))).alias("tags"))
    names = lambda close: F.transform(F.filter("tags", lambda t: t["close"] == close), lambda t: t["name"])
    tags = tags.select(key, "tags", names(False).alias("opens"), names(True).alias("closes"))
    count = lambda arr, n: F.size(F.filter(arr, lambda x: x == n))
    single = F.filter(
        F.array_distinct(F.concat("opens", "closes")), lambda n: count(F.col("opens"), n) != count(F.col("closes"), n)
    )
    tags = tags.select(key, "tags", single.alias("single"))
    delta = lambda t: F.when(F.array_contains("single", t["name"]), 0).when(t["close"], -1).otherwise(1)
    low = F.aggregate(
        F.transform("tags", delta),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda acc, d: F.struct((acc["at"] + d).alias("at"), F.least(acc["low"], acc["at"] + d).alias("low")),
    )["low"]
    mode = (
        F.when(low < 0, "failed")
        .when(F.size(F.array_except("single", F.array(*[F.lit(v) for v in VOID]))) > 0, "loose")
        .otherwise("strict")
    )
    kept = F.filter(
        F.transform("tags", lambda t, i: F.struct(
            i.alias("pos"), t["name"].alias("label"), t["close"].alias("close"), delta(t).alias("delta"))),
        lambda r: ~(r["close"] & (r["delta"] == 0)),
    )
    return tags.select(key, mode.alias("mode"), F.explode(kept).alias("r")).select(
        key, "mode", "r.pos", "r.label",
        F.when(F.col("r.delta") == 0, "single").otherwise("element").alias("kind"), "r.delta",
    )


# Fixed value: solid JSON tokens.
JSON_TOKEN = r"""\"(?:[^\"\\]|\\.)*\"|[{}\[\],:]|[^\s{}\[\],:\"]+"""


def json_tokens(json: Column) -> Column:
    return F.regexp_extract_all(json, F.lit(JSON_TOKEN), F.lit(0))


def json_stream(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, mode, pos, label, kind, delta) of a JSON text; the label is the object key or ''.

    mode: 'strict' if the text parses, 'loose' if only its brackets close, else 'failed'.
    Texts are dealt by key before, so windows over the tokens of a text shuffle no tokens.
    """
    toks = by_key(df.select(key, json), key).select(key, F.try_parse_json(json).isNotNull().alias("ok"), json_tokens(F.col(json)).alias("t"))
    count = lambda *marks: F.size(F.filter("t", lambda x: x.isin(*marks)))
    mode = F.when(F.col("ok"), "strict").when(count("{", "[") == count("}", "]"), "loose").otherwise("failed")
    at = lambda i: F.get(F.col("t"), i)
    strip = lambda x: F.substr(x, F.lit(2), F.length(x) - 2)
    row = lambda x, i: F.struct(
        i.alias("pos"),
        F.when((i > 1) & (at(i - 1) == ":"), strip(at(i - 2))).otherwise("").alias("label"),
        F.when(x == "{", "object").when(x == "[", "array").when(x.isin("}", "]"), "close")
        .when(x.isin(",", ":") | (F.coalesce(at(i + 1), F.lit("")) == ":"), "mark")
        .when(x == "null", "null").otherwise("scalar").alias("kind"),
    )
    rows = toks.select(key, mode.alias("mode"), F.explode(F.filter(F.transform("t", row), lambda r: r["kind"] != "mark")).alias("r"))
    delta = F.when(F.col("r.kind").isin("object", "array"), 1).when(F.col("r.kind") == "close", -1).otherwise(0)
    return rows.select(key, "mode", "r.pos", "r.label", "r.kind", delta.alias("delta"))


def nodes(stream: DataFrame, key: str) -> DataFrame:
    """(key, mode, node_id, depth, label, kind): nodes in document order, depth from 1."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    deep = stream.withColumn("run", F.sum("delta").over(w)).where("delta >= 0")
    depth = F.greatest(F.col("run") + F.when(F.col("delta") == 0, 1).otherwise(0), F.lit(1))
    return deep.select(key, "mode", F.col("pos").alias("node_id"), depth.cast("int").alias("depth"), "label", "kind")


CONTAINERS = ("element", "object", "array")


def with_parent(tree: DataFrame, key: str) -> DataFrame:
    """Adds ``parent_id``: the nearest earlier container one level up, -1 at the top."""
    row = lambda level, opened: F.struct(level.alias("level"), opened.cast("int").alias("open"))
    child = row(F.col("depth") - 1, F.lit(None))
    both = F.when(F.col("kind").isin(*CONTAINERS), F.array(child, row(F.col("depth"), F.col("node_id")))).otherwise(F.array(child))
    rows = tree.select("*", F.explode(both).alias("_r"))
    w = Window.partitionBy(key, "_r.level").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("parent_id", F.coalesce(F.last("_r.open", ignorenulls=True).over(w), F.lit(-1)))
    return found.where(F.col("_r.open").isNull()).select(*tree.columns, "parent_id")


def strip_keys(stream: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """The stream without nodes labelled by one of ``names`` and everything below them."""
    return _without(stream, key, F.col("label").isin(*names))


def select_children(stream: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """The stream with only those nodes that are to count as children.

    A node with a label stays if the label is one of ``names`` and its holder stays;
    one without a label (an element of an array, the whole text) stays where its holder does.
    """
    return _without(stream, key, (F.col("label") != "") & ~F.col("label").isin(*names))


def _without(stream: DataFrame, key: str, gone: Column) -> DataFrame:
    """The stream without the nodes that ``gone`` says, and everything below them."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    s = stream.withColumn("_run", F.sum("delta").over(w))
    s = s.withColumn("_level", F.when(F.col("delta") == -1, F.col("_run") + 1).otherwise(F.col("_run")))
    s = s.withColumn("_hit", gone & (F.col("delta") >= 0))
    # a closing mark takes the verdict of the container it closes: the bracket before it on its level
    own = Window.partitionBy(key, "_level", F.col("delta") == 0).orderBy("pos")
    s = s.withColumn("_opened", F.lag("_hit").over(own))
    s = s.withColumn("_hit", F.when(F.col("delta") == -1, F.col("_opened")).otherwise(F.col("_hit"))).drop("_opened")
    inside = F.sum(F.when(F.col("_hit"), F.col("delta")).otherwise(0)).over(w)
    s = s.withColumn("_in", inside)
    return s.where(~((F.col("_in") > 0) | F.col("_hit"))).select(*stream.columns)


def json_node_count(json: Column) -> Column:
    """Objects, arrays and nulls of a JSON text; scalars do not count. No explode, no shuffle."""
    node = lambda toks, x, i: x.isin("{", "[") | ((x == "null") & (F.coalesce(F.get(toks, i + 1), F.lit("")) != ":"))
    return let(json_tokens(json), lambda toks: F.size(F.filter(toks, lambda x, i: node(toks, x, i))))


def node_count(tree: DataFrame, key: str) -> DataFrame:
    """(key, n): nodes that are not scalars."""
    return tree.groupBy(key).agg(F.count_if(F.col("kind") != "scalar").alias("n"))


def first_subtree(json: Column) -> Column:
    """The first element of a JSON array as JSON text; null if there is none."""
    return F.to_json(F.try_variant_get(F.try_parse_json(json), "$[0]", "variant"))


# ---- feature vectors: row-local ------------------------------------------


def _opening(html: Column) -> Column:
    return F.transform(F.filter(raw_tags(html), lambda t: ~t.startswith("</")), tag_name)


def feature_vector(df: DataFrame, key: str, html: str = "html", template: Sequence[str] = TEMPLATE) -> DataFrame:
    """(key, lines, features MAP, vec ARRAY): line count and a counter per template tag, absent = 0."""
    tags = F.array(*[F.lit(t) for t in template])
    count = lambda opened: F.transform(tags, lambda t: F.size(F.filter(opened, lambda x: x == t)))
    counts = df.select(
        key, line_count(F.col(html)).alias("lines"), let(_opening(F.col(html)), count).alias("_c")
    )
    return counts.select(
        key, "lines", F.map_from_arrays(tags, "_c").alias("features"), F.concat(F.array("lines"), "_c").alias("vec")
    )


def category_vector(df: DataFrame, key: str, html: str = "html", groups: dict[str, Sequence[str]] = TAG_GROUPS) -> DataFrame:
    """(key, one counter per group): several tags counted together."""

    def count(opened: Column, tags: Sequence[str]) -> Column:
        return F.size(F.filter(opened, lambda x: x.isin(*tags)))

    record = lambda opened: F.struct(*[count(opened, tags).alias(name) for name, tags in groups.items()])
    return df.select(key, let(_opening(F.col(html)), record).alias("_g")).select(key, "_g.*")


def vector_difference(pairs: DataFrame, pair: str, a: str, b: str, vectors: DataFrame, key: str) -> DataFrame:
    """(pair, difference, total): place by place the vector of ``a`` less that of ``b``, and the sum without signs.

    Vectors (key, vec) are made once per text and meet the pairs by key.
    """
    side = lambda c, name: vectors.select(F.col(key).alias(c), F.col("vec").alias(name))
    met = pairs.select(pair, a, b).join(side(a, "_a"), a).join(side(b, "_b"), b)
    difference = F.zip_with("_a", "_b", lambda x, y: x - y)
    return met.select(pair, difference.alias("difference")).withColumn(
        "total", F.aggregate("difference", F.lit(0).cast("bigint"), lambda s, x: s + F.abs(x)))


# ---- distances ------------------------------------------------------------


def tree_texts(tree: DataFrame, key: str) -> DataFrame:
    """(key, tree, n): each tree as one text of depth:label entries in document order."""
    plain = F.col("label").rlike(r"^[A-Za-z0-9_\-]*$")  # nearly all labels: nothing to escape
    label = F.when(plain, F.col("label")).otherwise(js_escape(F.col("label")))
    entry = F.concat(F.col("depth").cast("string"), F.lit(":"), label)
    whole = tree.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("node_id", entry.alias("e")))).alias("es"))
    return whole.select(key, F.array_join(F.transform("es", lambda r: r["e"]), " ").alias("tree"), F.size("es").alias("n"))


@F.pandas_udf(T.StructType([T.StructField("tree", T.StringType()), T.StructField("n", T.IntegerType())]))
def _row_trees(tags: pd.Series) -> pd.DataFrame:
    """Tree texts from arrays of 'name' and '/name': the rules of ``html_stream`` and ``nodes``, in one pass over a row."""

    def one(marks) -> tuple[str, int]:
        net: dict[str, int] = {}
        for m in marks:
            name = m.lstrip("/")
            net[name] = net.get(name, 0) + (-1 if m[0] == "/" else 1)
        entries, depth = [], 0
        for m in marks:
            close, name = m[0] == "/", m.lstrip("/")
            if net[name]:
                if not close:
                    entries.append(f"{max(depth + 1, 1)}:{escaped(name)}")
            elif close:
                depth -= 1
            else:
                depth += 1
                entries.append(f"{max(depth, 1)}:{escaped(name)}")
        return " ".join(entries), len(entries)

    return pd.DataFrame([("", 0) if x is None else one(x) for x in tags], columns=["tree", "n"])


def html_tree(html: Column) -> Column:
    """struct(tree, n): the tree text of one HTML text and its number of nodes; no explode, no shuffle."""
    mark = lambda t: F.concat(F.when(t.startswith("</"), "/").otherwise(""), tag_name(t))
    return _row_trees(F.transform(raw_tags(html), mark))


def first_of(tree: Column) -> Column:
    """The first top-level subtree of a tree text: its root and all that follows on a deeper level; '' of an empty tree."""
    depth = lambda e: F.split_part(e, F.lit(":"), F.lit(1)).cast("int")

    def cut(entries: Column) -> Column:
        root = depth(F.get(entries, F.lit(0)))
        at = F.transform(entries, lambda e, i: F.when((i > 0) & (depth(e) <= root), i))
        return F.array_join(F.slice(entries, F.lit(1), F.coalesce(F.array_min(at), F.size(entries))), " ")

    return F.when(tree == "", "").otherwise(let(F.split(tree, " "), cut))


def _parse(text: str) -> tuple[list[int], list[str]]:
    parts = [e.split(":", 1) for e in text.split(" ")] if text else []
    return [int(d) for d, _ in parts], [label for _, label in parts]


def _text_distance(
    x: str | None, y: str | None, insert: float = 1, remove: float = 1, update=None, costs: Costs | None = None
) -> float | None:
    if x is None or y is None:
        return None
    costs = costs or Costs(insert, remove, 1.0 if update is None else update)
    (da, la), (db, lb) = _parse(x), _parse(y)
    if costs.unit and len(la) <= len(lb) and forest_within(da, la, db, lb):
        return float(len(lb) - len(la))
    if costs.unit and len(lb) < len(la) and forest_within(db, lb, da, la):
        return float(len(la) - len(lb))
    return _pair_distance(da, la, db, lb, costs=costs)


def _text_distances(x: Sequence[str | None], y: Sequence[str | None], costs: Costs) -> list[float | None]:
    """``_text_distance`` of many pairs; small trees go together, larger ones take the quick cases first."""
    out: list[float | None] = [None] * len(x)
    places, pairs = [], []
    for k, (p, q) in enumerate(zip(x, y)):
        if p is None or q is None:
            continue
        if costs.exact and max(p.count(" "), q.count(" ")) < SMALL_TREE:
            places.append(k)
            pairs.append((_parse(p), _parse(q)))
        else:
            out[k] = _text_distance(p, q, costs=costs)
    for k, value in zip(places, tree_distances(pairs, costs)):
        out[k] = value
    return out


def tree_distance(a: Column, b: Column, insert: float = 1, remove: float = 1, update=None, table: Table | None = None) -> Column:
    """Exact ordered tree distance of two tree texts.

    ``update``: cost of a label change, a number or a function of two labels; ``table``: costs of single labels,
    as ``Costs`` takes them.
    """
    costs = Costs(insert, remove, 1.0 if update is None else update, dict(table or {}))

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_text_distances(x, y, costs), dtype="float64")

    return run(a, b)


def _difference(pairs: DataFrame, pair: str, a: str, b: str, counts: DataFrame, key: str, *by: str) -> DataFrame:
    """(pair, net, gross): by how much the counts ``c`` of two trees differ, with and without sign. Counts meet the pairs, not nodes."""
    side = lambda col, sign: pairs.select(pair, F.col(col).alias(key)).join(counts, key).select(
        pair, *by, (F.col("c") * sign).alias("d")
    )
    both = side(a, 1).unionByName(side(b, -1)).groupBy(pair, *by).agg(F.sum("d").alias("d"))
    return both.groupBy(pair).agg(F.sum("d").alias("net"), F.sum(F.abs("d")).alias("gross"))


def tree_bound(pairs: DataFrame, pair: str, a: str, b: str, tree: DataFrame, key: str) -> DataFrame:
    """(pair, bound): at least this many unit edits, from label counts alone.

    With n, m nodes of which I can keep their label, max(n, m) - I edits are
    needed. Counts are pre-aggregated per tree before they meet the pairs.
    """
    counts = tree.groupBy(key, "label").agg(F.count("*").alias("c"))
    bound = _difference(pairs, pair, a, b, counts, key, "label")
    bound = bound.select(pair, ((F.abs("net") + F.col("gross")) / 2).cast("bigint").alias("bound"))
    return pairs.select(pair).join(bound, pair, "left").select(pair, F.coalesce("bound", F.lit(0)).alias("bound"))


def tree_grams(tree: DataFrame, key: str) -> DataFrame:
    """(key, label, child, sibling, c): how often a tree has a node with this first child and this next sibling; '' where it has none.

    The root above the top-level nodes is one of them (its label is null).
    """
    placed = with_parent(tree.select(key, "node_id", "depth", "label", "kind"), key)
    at = Window.partitionBy(key, "parent_id").orderBy("node_id")
    marked = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))  # no node is no label
    placed = placed.select(
        key, "node_id", "parent_id", "label", marked(F.lead("label").over(at)).alias("sibling"), F.row_number().over(at).alias("_n"))
    firsts = placed.where("_n = 1").select(key, F.col("parent_id").alias("node_id"), marked(F.col("label")).alias("child"))
    # the root is told by its first child; a tree without nodes has no grams
    own = F.struct("label", F.coalesce("child", F.lit("")).alias("child"), "sibling")
    root = F.struct(F.lit(None).cast("string").alias("label"), marked(F.col("label")).alias("child"), F.lit("").alias("sibling"))
    at_top = (F.col("parent_id") == -1) & (F.col("_n") == 1)
    both = placed.join(firsts, [key, "node_id"], "left").select(key, F.explode(F.when(at_top, F.array(own, root)).otherwise(F.array(own))).alias("g"))
    return both.select(key, "g.*").groupBy(key, "label", "child", "sibling").agg(F.count("*").alias("c"))


def structure_bound(pairs: DataFrame, pair: str, a: str, b: str, tree: DataFrame, key: str) -> DataFrame:
    """(pair, bound): at least this many unit edits, from the nodes' grams (``tree_grams``).

    An insertion or removal changes the grams of the node, of the one that comes
    before it (its parent or left sibling) and of its last child: five more or fewer
    at most; a new label changes four. So the grams that two trees do not share are
    at most five times the edits (Yang, Kalnis and Tung, 2005). Grams of longer
    paths and several children have no such factor: it grows with the children of a node.
    """
    counts = tree_grams(tree, key)
    bound = _difference(pairs, pair, a, b, counts, key, "label", "child", "sibling")
    bound = bound.select(pair, F.ceil(F.col("gross") / 5).cast("bigint").alias("bound"))
    return pairs.select(pair).join(bound, pair, "left").select(pair, F.coalesce("bound", F.lit(0)).alias("bound"))


def tree_distance_within(
    pairs: DataFrame, pair: str, a: str, b: str, tree: DataFrame, key: str, limit: int | None = None, costs: Costs | None = None
) -> DataFrame:
    """(pair, distance, exact): the exact distance; with ``limit``, pairs whose lower
    bound is above it keep the bound and exact = false.

    The bound is the larger one of those by label counts and by structure. With own ``costs`` there is no bound and so no limit.
    """
    costs = costs or Costs()
    texts = tree_texts(tree, key)
    ids = pairs.select(pair, a, b)
    left = texts.select(F.col(key).alias(a), F.col("tree").alias("_a"))
    right = texts.select(F.col(key).alias(b), F.col("tree").alias("_b"))
    both = ids.join(left, a, "left").join(right, b, "left").fillna("", ["_a", "_b"])
    exact = lambda x, y: tree_distance(x, y, costs.insert, costs.remove, costs.update, costs.table)
    if limit is None:
        whole = exact(F.col("_a"), F.col("_b"))
        whole = whole.cast("bigint") if costs.unit else whole
        return fan_out(both, pair).select(pair, whole.alias("distance"), F.lit(True).alias("exact"))
    if not costs.unit:
        raise ValueError("a limit needs unit costs: the bounds count edits")
    bounds = tree_bound(pairs, pair, a, b, tree, key).withColumnRenamed("bound", "_l").join(
        structure_bound(pairs, pair, a, b, tree, key).withColumnRenamed("bound", "_s"), pair)
    both = fan_out(both.join(bounds.select(pair, F.greatest("_l", "_s").alias("bound")), pair), pair)
    near = F.col("bound") <= limit
    found = exact(F.when(near, F.col("_a")), F.when(near, F.col("_b"))).cast("bigint")
    return both.select(pair, F.coalesce(found, "bound").alias("distance"), near.alias("exact"))
