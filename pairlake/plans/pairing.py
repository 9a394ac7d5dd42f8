"""Registered queries: splits, grid, profiles, pair building."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlake.functions.draws import draw
from pairlake.operators import grid as G
from pairlake.operators import pairs as P
from pairlake.operators import splits as S
from pairlake.operators.ranks import shuffled_rank
from pairlake.sources.corpus import filter_names
from pairlake.plans.common import SEED, sql_draw, sql_pairs, sql_rank, sql_split, sql_step, table

QUERIES, ORACLES = {}, {}


def _docs(spark, d):
    return table(spark, d, "documents")


def _staged(spark, d):
    return S.with_stage(_docs(spark, d).select("doc_id"), "doc_id", SEED)


STAGED = sql_split("documents", "doc_id")

QUERIES["name_filter"] = lambda s, d: (
    filter_names(table(s, d, "pages"), "url", ".html", "https://blog.").select("page_id", "url")
)
ORACLES["name_filter"] = (
    "SELECT page_id, url FROM pages WHERE suffix(url, '.html') AND NOT starts_with(url, 'https://blog.')"
)

QUERIES["subset_first"] = lambda s, d: S.subset(_docs(s, d).select("doc_id", "lang", "source"), 100, "doc_id")
ORACLES["subset_first"] = "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 100"

QUERIES["shuffled_rank"] = lambda s, d: shuffled_rank(_docs(s, d), "doc_id", SEED)
ORACLES["shuffled_rank"] = sql_rank("documents", "doc_id")

QUERIES["split_exact"] = lambda s, d: S.with_stage(_docs(s, d), "doc_id", SEED).select(
    "doc_id", "stage", F.md5("text").alias("digest")
)
ORACLES["split_exact"] = f"SELECT doc_id, stage, md5(text) AS digest FROM ({STAGED}) JOIN documents USING (doc_id)"

QUERIES["split_overlap"] = lambda s, d: S.with_stage(
    _docs(s, d).select("doc_id"), "doc_id", SEED, overlap=True
)
ORACLES["split_overlap"] = f"""
WITH r AS ({sql_rank("documents", "doc_id")})
SELECT doc_id, 'train' AS stage FROM r WHERE rank < floor(0.8 * n)
UNION ALL SELECT doc_id, 'validation' FROM r WHERE rank >= floor(0.8 * n) AND rank < floor(0.9 * n)
UNION ALL SELECT doc_id, 'test' FROM r WHERE rank >= floor(0.8 * n)"""

QUERIES["leaked_keys"] = lambda s, d: S.leaked_keys(S.with_stage(_docs(s, d).select("doc_id"), "doc_id", SEED, overlap=True), "doc_id")
ORACLES["leaked_keys"] = f"""
SELECT doc_id, string_agg(stage, ',' ORDER BY stage) AS stages FROM ({ORACLES["split_overlap"]}) GROUP BY doc_id HAVING count(DISTINCT stage) > 1"""

QUERIES["leaked_texts"] = lambda s, d: S.leaked_texts(S.with_stage(_docs(s, d), "doc_id", SEED), "text").select(
    F.md5("text").alias("digest"), "stages", "rows"
)
ORACLES["leaked_texts"] = f"""
SELECT md5(text) AS digest, string_agg(DISTINCT stage, ',' ORDER BY stage) AS stages, count(*) AS rows
FROM ({STAGED}) JOIN documents USING (doc_id) GROUP BY text HAVING count(DISTINCT stage) > 1"""

QUERIES["shard"] = lambda s, d: S.shard(_docs(s, d), "doc_id", 3, 1, SEED).select("doc_id", "rank")
ORACLES["shard"] = f"SELECT doc_id, rank FROM ({sql_rank('documents', 'doc_id')}) WHERE rank % 3 = 1"

QUERIES["grid_cells"] = lambda s, d: G.grid(
    _staged(s, d).groupBy("stage").agg(F.count("*").alias("docs")), exp=G.EXPERIMENTS, mix=G.MIXES
)
ORACLES["grid_cells"] = f"""
SELECT stage, docs, exp, mix FROM (SELECT stage, count(*) AS docs FROM ({STAGED}) GROUP BY stage),
  (VALUES ('Exp_all'), ('Exp_var'), ('Exp_val'), ('Exp_ast')) e(exp), (VALUES ('M1'), ('M2'), ('M3')) m(mix)"""


def _profile_use(s, d):
    names = [r["name"] if i % 2 else r["mode"] for i, r in enumerate(G.profile_rows())]
    pick = F.get(F.array(*[F.lit(x) for x in names]), F.pmod(draw(SEED, "profile", "doc_id"), F.lit(len(names))).cast("int"))
    named = _docs(s, d).select("doc_id", pick.alias("profile"))
    flags = F.array_join(
        F.array_sort(F.transform(F.map_entries("flags"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";"
    )
    counts = named.groupBy("profile").agg(F.count("*").alias("docs"), F.sum("doc_id").alias("id_sum"))
    return G.resolve(counts).select(
        "profile", "name", "mode", "docs", "id_sum", flags.alias("flags"),
        *[F.col(c).cast("int").alias(c) for c in ("partial", "mixed", "to_ast")],
    )


# Written by hand, not from operators.grid: the defaults, the profiles, and what each of them changes.
FLAG_DEFAULTS = """
('compact', 'false'), ('dead', 'false'), ('dead_threshold', '0.4'), ('encoding', 'none'), ('numbers', 'false'), ('permute', 'false'),
('permute_threshold', '0.75'), ('rename', 'false'), ('rename_keys', 'false'), ('reserved_strings', '.*'), ('rotate', 'false'),
('shuffle', 'false'), ('split_length', '9'), ('split_strings', 'false'), ('string_array', 'false'), ('string_array_threshold', '0')"""
PROFILE_VALUES = """
(0, 'w_sco', 'EXP_all_m1', 'w_sco', 1, 0, 0), (1, 'EXP_var_m1', 'EXP_var_m1', 'w_object', 1, 0, 0), (2, 'w_string', 'EXP_val_m1', 'w_string', 1, 0, 0),
(3, 'EXP_ast_m1', 'EXP_ast_m1', 'w_control', 1, 0, 0), (4, 'sco', 'EXP_all_m2', 'sco', 0, 1, 0), (5, 'EXP_var_m2', 'EXP_var_m2', 'object', 0, 1, 0),
(6, 'string', 'EXP_val_m2', 'string', 0, 1, 0), (7, 'EXP_ast_m2', 'EXP_ast_m2', 'control', 0, 1, 0), (8, 'sco_dead', 'EXP_all_m3', 'sco_dead', 0, 1, 0),
(9, 'EXP_var_m3', 'EXP_var_m3', 'object_dead', 0, 1, 0), (10, 'string_dead', 'EXP_val_m3', 'string_dead', 0, 1, 0),
(11, 'EXP_ast_m3', 'EXP_ast_m3', 'control_dead', 0, 1, 0), (12, 'p_control', 'p_control', 'p_control', 1, 1, 0),
(13, 'w_control_ast', 'w_control_ast', 'w_control_ast', 1, 0, 1), (14, 'low', 'low', 'low', 0, 1, 0), (15, 'medium', 'medium', 'medium', 0, 1, 0),
(16, 'hi', 'hi', 'hi', 0, 1, 0), (17, 'minify', 'minify', 'minify', 0, 1, 0), (18, 'A', 'A', 'A', 0, 1, 0), (19, 'B', 'B', 'B', 0, 1, 0), (20, 'C', 'C', 'C', 0, 1, 0)"""
# profiles (a pattern on the name), flag, value
CHANGES = """
('EXP_(all|val)_m.', 'rename', 'true'), ('EXP_(all|val)_m.', 'split_strings', 'true'), ('EXP_(all|val)_m.', 'reserved_strings', ''),
('EXP_(all|var)_m.', 'rename_keys', 'true'), ('EXP_(all|ast)_m.', 'permute', 'true'), ('EXP_..._m3', 'dead', 'true'), ('._control.*', 'permute', 'true'),
('low|medium|hi|A|B|C', 'string_array', 'true'), ('low|medium|hi|A|B|C', 'rotate', 'true'), ('low|medium|hi|A|B|C', 'shuffle', 'true'),
('low|medium|hi|A|B|C', 'rename', 'true'), ('low|medium|hi|minify|A|B|C', 'compact', 'true'), ('low|medium|hi|minify|A|B|C', 'reserved_strings', ''),
('low|medium|hi|A', 'string_array_threshold', '0.75'), ('B|C', 'string_array_threshold', '1'), ('medium|hi', 'encoding', 'base64'),
('medium|hi', 'split_length', '10'), ('B|C', 'split_length', '5'), ('medium|hi|B|C', 'permute', 'true'), ('medium|hi|B|C', 'dead', 'true'),
('medium|hi|B|C', 'rename_keys', 'true'), ('medium|hi|B|C', 'numbers', 'true'), ('medium|hi|B|C', 'split_strings', 'true'),
('B|C', 'permute_threshold', '1'), ('B|C', 'dead_threshold', '1')"""


def _profile_values() -> str:
    return f"""
WITH p(i, profile, name, mode, partial, mixed, to_ast) AS (VALUES {PROFILE_VALUES}),
d(k, v) AS (VALUES {FLAG_DEFAULTS}), c(names, k, v) AS (VALUES {CHANGES}),
f AS (SELECT p.i, string_agg(d.k || '=' || coalesce(c.v, d.v), ';' ORDER BY d.k) AS flags
      FROM p CROSS JOIN d LEFT JOIN c ON c.k = d.k AND regexp_full_match(p.name, c.names) GROUP BY p.i)
SELECT profile, name, mode, partial, mixed, to_ast, flags, count(*) AS docs, cast(sum(doc_id) AS BIGINT) AS id_sum
FROM documents JOIN p ON p.i = {sql_draw("profile", "doc_id")} % 21 JOIN f USING (i) GROUP BY ALL"""


QUERIES["profile_flags"] = _profile_use
ORACLES["profile_flags"] = _profile_values()

QUERIES["random_partner"] = lambda s, d: P.random_partner(_staged(s, d), "doc_id", SEED, "partner", ["stage"])
ORACLES["random_partner"] = f"""
WITH s AS ({STAGED}), r AS ({sql_rank("s", "doc_id", by="stage")})
SELECT a.stage, a.doc_id, b.doc_id AS partner FROM r a JOIN r b ON a.stage = b.stage
 AND b.rank = {sql_step(sql_draw("partner", "a.doc_id"), "a.n", "a.rank")}"""

QUERIES["pairs_positive"] = lambda s, d: P.make_pairs(_staged(s, d), "doc_id", SEED, pos=1, neg=0)
ORACLES["pairs_positive"] = f"WITH s AS ({STAGED}), {sql_pairs('s', 'doc_id', 1, 0)} SELECT * FROM pairs"

QUERIES["pairs_negative"] = lambda s, d: P.make_pairs(_staged(s, d), "doc_id", SEED, pos=0, neg=1)
ORACLES["pairs_negative"] = f"WITH s AS ({STAGED}), {sql_pairs('s', 'doc_id', 0, 1)} SELECT * FROM pairs"

QUERIES["pairs_replicated"] = lambda s, d: P.make_pairs(_staged(s, d), "doc_id", SEED, pos=3, neg=2)
ORACLES["pairs_replicated"] = f"WITH s AS ({STAGED}), {sql_pairs('s', 'doc_id', 3, 2)} SELECT * FROM pairs"


def _first_success(s, d):
    lines = F.size(F.split("text", "\n"))
    ok = _docs(s, d).select("doc_id", (lines >= 2).alias("ok"))
    return P.first_success(_staged(s, d), ok, "doc_id", SEED, 10, ["stage"]).select(
        "stage", "doc_id", "status", F.coalesce("attempt", F.lit(-1)).alias("attempt"),
        F.coalesce("partner", F.lit(-1)).alias("partner"),
    )


QUERIES["first_success"] = _first_success
ORACLES["first_success"] = f"""
WITH s AS ({STAGED}), r AS ({sql_rank("s", "doc_id", by="stage")}),
ok AS (SELECT doc_id, len(string_split(text, chr(10))) >= 2 AS ok FROM documents),
t AS (SELECT stage, doc_id, rank, n, unnest(generate_series(0, 9)) AS attempt FROM r),
c AS (SELECT *, {sql_step(sql_draw("try", "doc_id", "attempt"), "n", "rank")} AS pr FROM t),
g AS (SELECT c.stage, c.doc_id, min(c.attempt) AS attempt, arg_min(b.doc_id, c.attempt) AS partner
      FROM c JOIN r b ON b.stage = c.stage AND b.rank = c.pr JOIN ok ON ok.doc_id = b.doc_id AND ok.ok
      GROUP BY ALL)
SELECT r.stage, r.doc_id, CASE WHEN g.doc_id IS NULL THEN 'failed' ELSE 'ok' END AS status,
       coalesce(attempt, -1) AS attempt, coalesce(partner, -1) AS partner
FROM r LEFT JOIN g ON g.stage = r.stage AND g.doc_id = r.doc_id"""


def _pair_targets(s, d):
    made = P.make_pairs(_staged(s, d), "doc_id", SEED, 1, 0)
    targets = G.grid(
        made.select("stage", F.col("seed_id").alias("source"), F.col("base_id").alias("base")),
        exp=G.EXPERIMENTS, mix=G.MIXES,
    )
    return P.pair_targets(targets, SEED)


QUERIES["pair_targets"] = _pair_targets
ORACLES["pair_targets"] = f"""
WITH s AS ({STAGED}), {sql_pairs("s", "doc_id", 1, 0)},
t AS (SELECT stage, exp, mix, seed_id AS source, base_id AS base FROM pairs,
      (VALUES ('Exp_all'), ('Exp_var'), ('Exp_val'), ('Exp_ast')) e(exp), (VALUES ('M1'), ('M2'), ('M3')) m(mix)),
cr AS ({sql_rank("t", "source", by="stage, exp, mix", salt="counter")}),
k AS (SELECT t.*, a.rank, a.n, b.rank AS base_rank FROM t JOIN cr a USING (stage, exp, mix, source)
      JOIN cr b ON b.stage = t.stage AND b.exp = t.exp AND b.mix = t.mix AND b.source = t.base),
c AS (SELECT k.*, cr.source AS counter FROM k JOIN cr ON cr.stage = k.stage AND cr.exp = k.exp AND cr.mix = k.mix
      AND cr.rank = {sql_step(sql_draw("counter_pick", "k.stage", "k.exp", "k.mix", "k.source"), "k.n", "k.rank", "k.base_rank")})
SELECT stage, exp, mix, counter AS seed, source, base, 0 AS label FROM c
UNION ALL SELECT stage, exp, mix, source, source, base, 1 FROM c"""

QUERIES["attach_texts"] = lambda s, d: P.attach(
    P.make_pairs(_staged(s, d), "doc_id", SEED), _docs(s, d)
).select(
    "pair_id", "label", *[F.md5(f"{c}_text").alias(f"{c}_md5") for c in ("seed", "alt", "base")]
)
ORACLES["attach_texts"] = f"""
WITH s AS ({STAGED}), {sql_pairs("s", "doc_id")}
SELECT pair_id, label, md5(x.text) AS seed_md5, md5(y.text) AS alt_md5, md5(z.text) AS base_md5
FROM pairs JOIN documents x ON x.doc_id = seed_id JOIN documents y ON y.doc_id = alt_id
JOIN documents z ON z.doc_id = base_id"""

QUERIES["missing_names"] = lambda s, d: P.missing(_docs(s, d), table(s, d, "labels"), "doc_id")
ORACLES["missing_names"] = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"

QUERIES["completeness"] = lambda s, d: P.completeness(_docs(s, d), table(s, d, "labels"), "doc_id")
ORACLES["completeness"] = """
SELECT count(*) AS size, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS missing FROM documents"""

QUERIES["two_folder_pairs"] = lambda s, d: P.two_folder_pairs(_docs(s, d), "doc_id", SEED)
ORACLES["two_folder_pairs"] = f"""
WITH r AS ({sql_rank("documents", "doc_id")}),
z AS (SELECT *, {sql_step(sql_draw("zero_first", "doc_id"), "n", "rank")} AS fr FROM r),
z2 AS (SELECT *, {sql_step(sql_draw("zero_second", "doc_id"), "n", "rank", "fr")} AS sr FROM z)
SELECT r.doc_id, r.doc_id AS first, b.doc_id AS second, 1 AS label FROM r
JOIN r b ON b.rank = {sql_step(sql_draw("one", "r.doc_id"), "r.n", "r.rank")}
UNION ALL SELECT z2.doc_id, f.doc_id, g.doc_id, 0 FROM z2 JOIN r f ON f.rank = fr JOIN r g ON g.rank = sr"""

QUERIES["union_pairs"] = lambda s, d: P.union_pairs(
    P.make_pairs(_staged(s, d), "doc_id", SEED, 2, 0), P.make_pairs(_staged(s, d), "doc_id", SEED, 0, 1)
).groupBy("stage", "label").agg(F.count("*").alias("pairs"), F.countDistinct("seed_id").alias("seeds"))
ORACLES["union_pairs"] = f"""
WITH s AS ({STAGED})
SELECT stage, label, reps * count(*) AS pairs, count(*) AS seeds FROM s, (VALUES (1, 2), (0, 1)) v(label, reps)
GROUP BY stage, label, reps"""

QUERIES["union_records"] = lambda s, d: P.union_records(
    _docs(s, d).select(F.col("doc_id").alias("id"), "lang"),
    table(s, d, "pages").select(F.col("page_id").alias("id"), "url"),
)
ORACLES["union_records"] = """
SELECT doc_id AS id, lang, NULL::VARCHAR AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages"""
