"""The registered queries of this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairlake.llm import alignment, ann, classifier, divergence, linededup, mixing, neardup, ngramjoin, pieces, pii, quality, secretscan, sharding
from pairlake.llm.common import table
from pairlake.session import cut


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf_dir, "documents")).select("doc_id", "rep_id", "class_id", "n_links")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secretscan.digest(secretscan.scan(docs), "doc_id", "secrets")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", "block", "slot", "position")


def op4_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors.where("vec_id % 20 = 0"), vectors)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup(docs, words=linededup.PASSAGE_WORDS).select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.judge(docs, trusted).drop("text")


def op7_piece_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = pieces.decode(coded)
    return coded.select("doc_id", "ids", back.eqNullSafe(F.coalesce("text", F.lit(""))).alias("same"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.detect(docs), "doc_id", "pii")


def op9_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_slot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = [f"shard-{i:02d}" for i in range(sharding.SHARDS)]
    placed = sharding.place(docs, names)
    return placed.select("doc_id", "slot", "shard", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    wanted = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    # encoded once: the links of each document are written, not the texts
    rows = cut(alignment.align(docs, wanted=wanted).select("doc_id", "aligned.*"))
    held = alignment.strength(F.col("links"), alignment.pair_counts(F.col("links"), rows))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", held.alias("held"), "groups_sha256").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "held.n_best", "held.count_sum", "groups_sha256"
    )


def op12_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id", "kept")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_join, op2_secret_scan, op3_source_mix, op4_one_bit_search, op5_line_dedup, op6_quality_rules, op7_piece_codes,
        op8_personal_data, op9_quality_votes, op10_slot_table, op11_token_alignment,
        op12_near_duplicates, op13_source_divergence,
    )
}


def _sql_draw(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT)"


def _sql_slots(shards: int, slots: int) -> str:
    """The table filled turn by turn: a shard's next free slot is looked for from where it stopped."""
    here = f"(starts[turn % {shards} + 1] + j * strides[turn % {shards} + 1]) % {slots} + 1"
    key = "coalesce(cast(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, '')))"
    return f"""
WITH RECURSIVE s AS (SELECT i, 'shard-' || lpad(cast(i AS VARCHAR), 2, '0') AS name FROM range({shards}) t(i)),
l AS (SELECT list({_sql_draw("'42'", "'start'", "name")} % {slots} ORDER BY i) AS starts,
  list({_sql_draw("'42'", "'stride'", "name")} % {slots - 1} + 1 ORDER BY i) AS strides FROM s),
f(turn, pos, owner) AS (
  SELECT 0, list_transform(range({shards}), lambda x: 0), list_transform(range({slots}), lambda x: -1)
  UNION ALL
  SELECT turn + 1, list_transform(pos, lambda x, k: CASE WHEN k = turn % {shards} + 1 THEN j + 1 ELSE x END),
    list_transform(owner, lambda x, k: CASE WHEN k = {here} THEN turn % {shards} ELSE x END)
  FROM (SELECT *, list_filter(range(pos[turn % {shards} + 1], {slots}), lambda j: owner[{here}] < 0)[1] AS j FROM f, l WHERE turn < {slots})),
o AS (SELECT unnest(range({slots})) AS slot, unnest(owner) AS i FROM f WHERE turn = {slots}),
d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, {_sql_draw("'42'", "'slot'", key)} % {slots} AS slot FROM documents)
SELECT doc_id, slot, name AS shard, n_bytes FROM d JOIN o USING (slot) JOIN s USING (i)"""


#: The search is approximate by design, but its bound leaves out nothing in practice: the SQL is the exact answer.
_EXACT_SEARCH = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v) AS score FROM e q JOIN e ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)
SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY rank <= 20"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs that share a shingle, and what they reach.
_NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 3 THEN list_filter([array_to_string(w, ' ')], lambda x: x <> '')
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) + any_value(b.n) AS n, count(*) AS c
  FROM u a JOIN u b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p WHERE 100 * c >= 85 * (n - c) UNION ALL SELECT y, x FROM p WHERE 100 * c >= 85 * (n - c)),
r(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.root FROM r JOIN e ON r.node = e.x AND r.root < e.y),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, cast(len(g) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.node = s.doc_id"""

#: Shares of every kept term in every group, absent ones too.
_DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
u AS (SELECT id, lang, source, unnest(w) AS t FROM d),
k AS (SELECT lang, t, count(*) AS n FROM u GROUP BY lang, t HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, t, count(*) AS n FROM u JOIN k USING (lang, t) GROUP BY lang, source, t),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
w AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(w.n, 0) + 5 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (v.n + 5 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t
    LEFT JOIN w ON w.lang = g.lang AND w.source = g.source),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', t, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, cast(value AS BIGINT) AS value,
  cast(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM o QUALIFY part = 'pair' OR rank <= 50"""

ORACLES = {"op4_one_bit_search": _EXACT_SEARCH, "op10_slot_table": _sql_slots(sharding.SHARDS, sharding.SLOTS), "op12_near_duplicates": _NEAR_DUPLICATES,
           "op13_source_divergence": _DIVERGENCE}
