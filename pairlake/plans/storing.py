"""Registered queries: scans, sinks read back, incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlake.functions.lexer import join_tokens, tokens
from pairlake.operators import extend, grid as G, pairs as P
from pairlake.operators.splits import with_stage
from pairlake.plans.common import SEED, sql_pairs, table
from pairlake.plans.learning import CM, SCORES, _scores
from pairlake.plans.pairing import STAGED, _staged
from pairlake.plans.texts import sql_tokens
from pairlake.operators import metrics as M
from pairlake.session import scratch
from pairlake.sources import cells as C
from pairlake.sources import corpus as S
from pairlake.sources import records as R
from pairlake.streaming import incremental as N

QUERIES, ORACLES = {}, {}


def _scan(s, d):
    path = scratch(s, "corpus")
    # one file per item, as a corpus folder has it
    table(s, d, "benchmark").select("text").write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
    files = S.scan_corpus(s, path, "*.txt")
    return files.select(F.regexp_replace("content", r"\n$", "").alias("content"), F.col("name").endswith(".txt").cast("int").alias("named"))


QUERIES["scan_corpus"] = _scan
ORACLES["scan_corpus"] = "SELECT text AS content, 1 AS named FROM benchmark"

QUERIES["renumber_corpus"] = lambda s, d: S.renumber_corpus(
    table(s, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")), "path", "page"
)
ORACLES["renumber_corpus"] = """
WITH p AS (SELECT DISTINCT regexp_replace(url, '^https?://', '') AS path FROM pages),
l AS (SELECT path, unnest(string_split(path, '/')) AS name, generate_subscripts(string_split(path, '/'), 1) AS level FROM p),
x AS (SELECT *, array_to_string(string_split(path, '/')[1:level - 1], '/') AS parent FROM l),
e AS (SELECT parent, level, name, row_number() OVER (PARTITION BY parent, level ORDER BY name) - 1 AS place FROM (SELECT DISTINCT parent, level, name FROM x))
SELECT path, 'page-' || string_agg(cast(place AS VARCHAR), '-' ORDER BY level) || '.js' AS new_name FROM x JOIN e USING (parent, level, name) GROUP BY path"""


def _listed(s, d):
    listed = table(s, d, "documents").select(F.concat(F.lit("data/"), F.when(F.col("lang") == "es", "unknown/").otherwise(""), "doc_id").alias("path"))
    corpus = table(s, d, "labels").select(F.concat(F.lit("data/"), "doc_id").alias("path"), "quality")
    return S.scan_listed(listed, corpus, "path", "data/unknown").select("path", "status", F.coalesce("quality", F.lit(-1)).alias("quality"))


QUERIES["scan_listed"] = _listed
ORACLES["scan_listed"] = """
SELECT 'data/' || d.doc_id AS path, CASE WHEN l.doc_id IS NULL THEN 'failed' ELSE 'ok' END AS status, coalesce(quality, -1) AS quality
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE lang <> 'es'"""


def _json_files(s, d):
    path = scratch(s, "json")
    table(s, d, "pages").select("page_id", "url", "html").write.option("compression", "gzip").json(path)
    back = R.scan_json(s, path, "page_id bigint, url string, html string", multi_line=False)
    return back.select("page_id", "url", F.md5("html").alias("digest"))


QUERIES["scan_json"] = _json_files
ORACLES["scan_json"] = "SELECT page_id, url, md5(html) AS digest FROM pages"


def _cells(s, d):
    path = scratch(s, "cells")
    docs = with_stage(table(s, d, "documents"), "doc_id", SEED).select("doc_id", "text", "stage")
    copies = [G.grid(docs, exp=[e], mix=[m]) for e in G.EXPERIMENTS for m in G.MIXES]
    C.write_cells(C.union_cells(copies), path, spread=False)
    every = [C.read_cells(s, path, stage="test", exp=e, mix=m).select(F.lit(e).alias("exp"), F.lit(m).alias("mix"), "doc_id", F.md5("text").alias("digest"))
             for e in G.EXPERIMENTS for m in G.MIXES]
    return C.union_cells(every)


QUERIES["read_cells"] = _cells
ORACLES["read_cells"] = f"""
SELECT exp, mix, doc_id, md5(text) AS digest FROM ({STAGED}) JOIN documents USING (doc_id),
  (VALUES ('Exp_all'), ('Exp_var'), ('Exp_val'), ('Exp_ast')) e(exp), (VALUES ('M1'), ('M2'), ('M3')) m(mix) WHERE stage = 'test'"""


def _manifest(s, d):
    path = scratch(s, "manifest")
    made = P.make_pairs(_staged(s, d), "doc_id", SEED)
    C.write_manifest(G.grid(made.select("stage", "seed_id"), exp=G.EXPERIMENTS, mix=G.MIXES), path, "seed_id")
    return C.read_manifest(s, path).groupBy("stage", "exp", "mix").agg(F.count("*").alias("names"), F.sum(F.col("value").cast("bigint")).alias("ids"))


QUERIES["manifest"] = _manifest
ORACLES["manifest"] = f"""
WITH s AS ({STAGED}) SELECT stage, exp, mix, count(*) AS names, cast(sum(doc_id) AS BIGINT) AS ids FROM s,
  (VALUES ('Exp_all'), ('Exp_var'), ('Exp_val'), ('Exp_ast')) e(exp), (VALUES ('M1'), ('M2'), ('M3')) m(mix) GROUP BY ALL"""


def _records(s, d):
    path = scratch(s, "records")
    R.write_records(table(s, d, "embeddings"), path, chunk=50)
    rows = s.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("f")).count()
    sizes = rows.agg((F.max("count") <= 50).cast("int").alias("small"), F.sum("count").alias("rows"))
    shapes = R.read_shapes(s, path).where("key = 'embedding'").select(F.col("size").alias("width"), "type")
    one = F.lit(1).alias("_1")
    return sizes.select("*", one).join(shapes.select("*", one), "_1").drop("_1")


QUERIES["record_chunks"] = _records
ORACLES["record_chunks"] = "SELECT 1 AS small, count(*) AS rows, 64 AS width, 'float' AS type FROM embeddings"


def _excluded(s, d):
    path = scratch(s, "records")
    R.write_records(table(s, d, "documents"), path)
    return R.read_records(s, path, exclude=["text", "n_chars"])


QUERIES["read_records"] = _excluded
ORACLES["read_records"] = "SELECT doc_id, lang, source FROM documents"


def _merged_runs(s, d):
    """Three runs of one table: a key less, a key more, and keys of wider types."""
    root, docs = scratch(s, "runs"), table(s, d, "documents")
    third = lambda k: docs.where(F.col("doc_id") % 3 == k)
    words = F.size(F.split("text", " "))
    R.add_run(third(0).select(F.col("doc_id").cast("int").alias("doc_id"), "lang", words.alias("size"), F.array(words.cast("short")).alias("sizes")), root)
    R.add_run(third(1).select("doc_id", "source", (words / 2).alias("size"), F.struct("lang").alias("of")), root)
    R.add_run(third(2).select("doc_id", "lang", F.array(words.cast("long"), words.cast("long")).alias("sizes"), F.struct("source", F.length("text").alias("n")).alias("of")), root)
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return R.read_runs(s, root).select(
        F.col("doc_id"), shown(F.col("lang")).alias("lang"), shown(F.col("source")).alias("source"), F.coalesce("size", F.lit(-1.0)).alias("size"),
        shown(F.array_join(F.transform("sizes", lambda x: x.cast("string")), ",")).alias("sizes"), shown(F.col("of.lang")).alias("of_lang"),
        shown(F.col("of.source")).alias("of_source"), F.coalesce(F.col("of.n"), F.lit(-1)).alias("of_n"))


QUERIES["merge_runs"] = _merged_runs
ORACLES["merge_runs"] = """
WITH w AS (SELECT *, doc_id % 3 AS k, len(string_split(text, ' ')) AS n FROM documents)
SELECT doc_id, CASE WHEN k = 1 THEN '-' ELSE lang END AS lang, CASE WHEN k = 1 THEN source ELSE '-' END AS source,
  CASE k WHEN 0 THEN cast(n AS DOUBLE) WHEN 1 THEN n / 2 ELSE -1 END AS size, CASE k WHEN 0 THEN cast(n AS VARCHAR) WHEN 1 THEN '-' ELSE n || ',' || n END AS sizes,
  CASE WHEN k = 1 THEN lang ELSE '-' END AS of_lang, CASE WHEN k = 2 THEN source ELSE '-' END AS of_source, cast(CASE WHEN k = 2 THEN length(text) ELSE -1 END AS INTEGER) AS of_n FROM w"""


def _memo(s, d):
    root = scratch(s, "memo")

    def compute(seed, pos, neg):
        made = P.make_pairs(_staged(s, d), "doc_id", seed, pos, neg)
        return [made.where(F.col("stage") == x) for x in ("train", "validation", "test")]

    R.materialise(s, root, compute, SEED, 1, neg=1)
    again = R.materialise(s, root, compute, SEED, 1, neg=1)
    return again[0].unionByName(again[1]).unionByName(again[2])


QUERIES["materialise"] = _memo
ORACLES["materialise"] = f"WITH s AS ({STAGED}), {sql_pairs('s', 'doc_id')} SELECT * FROM pairs"


def _csv(s, d):
    path = scratch(s, "report")
    r = table(s, d, "documents").select(F.concat(F.lit("data/"), "doc_id").alias("path"), F.length("text").alias("length"))
    C.write_report(r, path)
    return C.read_report(s, path, "path string, length bigint")


QUERIES["csv_report"] = _csv
ORACLES["csv_report"] = "SELECT 'data/' || doc_id AS path, length(text) AS length FROM documents"


def _history(s, d):
    path = scratch(s, "history")
    sc = M.confusion(_scores(s, d), "label", "pred", ["toxic"])
    for epoch in (1, 2):
        C.append_history(sc.withColumn("epoch", F.lit(epoch)), path)
    return C.read_history(s, path, "epoch int, toxic int, tp bigint, fp bigint, fn bigint, tn bigint")


QUERIES["history"] = _history
ORACLES["history"] = f"WITH {SCORES}, c AS ({CM}) SELECT 1 AS epoch, * FROM c UNION ALL SELECT 2, * FROM c"


def _derived(s, d):
    path = scratch(s, "derived")
    t = table(s, d, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    for _ in range(2):  # the second run has nothing left to add
        S.write_derived(S.derive(t, "doc_id", join_tokens(F.col("t")), F.size("t") > 20, "too few tokens"), path, "doc_id")
    back = s.read.parquet(path)
    return back.select("doc_id", "status", F.coalesce("error", F.lit("")).alias("error"), F.coalesce(F.md5("value"), F.lit("")).alias("digest"))


QUERIES["derive"] = _derived
ORACLES["derive"] = f"""
SELECT doc_id, CASE WHEN len(t) > 20 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN len(t) > 20 THEN '' ELSE 'too few tokens' END AS error,
  CASE WHEN len(t) > 20 THEN md5(array_to_string(t, ' ')) ELSE '' END AS digest FROM (SELECT doc_id, {sql_tokens("text")} AS t FROM documents)"""

QUERIES["only_new"] = lambda s, d: N.only_new(
    table(s, d, "documents").select("doc_id", F.md5("text").alias("digest")), table(s, d, "labels"), "doc_id"
)
ORACLES["only_new"] = "SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def _stream(s, d):
    base = scratch(s, "stream")
    docs = table(s, d, "documents")
    count = lambda df: df.select("doc_id", F.size(tokens(F.col("text"))).alias("n_tokens"))
    run = lambda: N.stream_derive(s, f"{base}/in", docs.schema, count, f"{base}/sink", f"{base}/progress")
    half = F.col("doc_id") % 2 == 0
    docs.where(half).write.parquet(f"{base}/in")
    run()
    docs.where(~half).write.mode("append").parquet(f"{base}/in")  # a second batch of files
    run()
    return run()  # finds nothing new


QUERIES["stream_derive"] = _stream
ORACLES["stream_derive"] = f"SELECT doc_id, len({sql_tokens('text')}) AS n_tokens FROM documents"


def _stream_keyed(s, d):
    """A second batch of files repeats keys of the first one, with other values, beside new ones."""
    base = scratch(s, "stream")
    docs = table(s, d, "documents").select("doc_id", F.length("text").alias("chars"))
    run = lambda: N.stream_derive(s, f"{base}/in", docs.schema, lambda df: df.withColumn("even", F.col("chars") % 2 == 0), f"{base}/sink", f"{base}/progress", key="doc_id")
    docs.where("doc_id % 3 < 2").write.parquet(f"{base}/in")
    run()
    docs.where("doc_id % 3 > 0").withColumn("chars", F.when(F.col("doc_id") % 3 == 1, -1).otherwise(F.col("chars"))).write.mode("append").parquet(f"{base}/in")
    run()
    return run().select("doc_id", "chars", F.col("even").cast("int").alias("even"))


QUERIES["stream_by_key"] = _stream_keyed
ORACLES["stream_by_key"] = "SELECT doc_id, cast(length(text) AS INTEGER) AS chars, cast(length(text) % 2 = 0 AS INTEGER) AS even FROM documents"


def _extended(s, d):
    extend.register("long_turns", lambda df: df.where(F.length("text") > 40))
    kept = extend.apply(table(s, d, "conversations"), "long_turns")
    mapper = lambda r: {"conv_id": r["conv_id"], "turn": r["turn"], "words": len(r["text"].split(" "))} if r["role"] == "user" else None
    return extend.map_records(kept, mapper, "conv_id bigint, turn bigint, words bigint")


QUERIES["record_mapper"] = _extended
ORACLES["record_mapper"] = """
SELECT conv_id, turn, len(string_split(text, ' ')) AS words FROM conversations WHERE length(text) > 40 AND role = 'user'"""
