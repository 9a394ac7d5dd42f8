"""Registered queries: clone search, shapes, pair classifiers, encoders."""

from __future__ import annotations

import functools

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from pairlake.functions import vectors as V
from pairlake.functions.lexing import lexed_lines
from pairlake.operators import models as K
from pairlake.operators import perturb as E
from pairlake.operators import pairs as P
from pairlake.operators.grid import DEFAULT_FLAGS, EXPERIMENT_FLAGS, EXPERIMENTS, MIXES
from pairlake.operators.search import search
from pairlake.operators.shapes import infer_shapes
from pairlake.operators.splits import with_stage
from pairlake.functions.draws import draw
from pairlake.plans.common import SEED, sql_draw, sql_pairs, sql_split, table, texts
from pairlake.plans.pairing import STAGED, _staged
from pairlake.plans.learning import VOCAB, _vocab
from pairlake.plans.perturbing import ATTACHED, _attached, sql_cell, sql_inject
from pairlake.plans.texts import sql_class, sql_raw, sql_tokens
from pairlake.session import cut, scratch
from pairlake.sources import cells as C

QUERIES, ORACLES = {}, {}


def _search(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = search(
        e.withColumnRenamed("id", "target_id"), e.withColumnRenamed("id", "seed_id"), 5, skip_same=True
    )
    return found.select("target_id", "seed_id", F.round("score", 6).alias("score"), "place")


QUERIES["clone_search"] = _search
ORACLES["clone_search"] = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id AS target_id, b.vec_id AS seed_id,
  round(greatest(0, least(1, (list_cosine_similarity(a.v, b.v) + 1) / 2)), 9) AS score FROM e a, e b WHERE a.vec_id <> b.vec_id)
SELECT target_id, seed_id, round(score, 6) AS score, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, seed_id) AS place
FROM p QUALIFY place <= 5"""


def _shapes(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    lines = F.split("text", "\n")
    both = table(s, d, "documents").join(e, "doc_id", "left").select(
        "doc_id", F.coalesce("embedding", F.array().cast("array<float>")).alias("embedding"), lines.alias("lines"),
        F.transform(lines, lambda x: F.split(x, " ")).alias("words"), F.array().cast("array<int>").alias("nothing"),
    )
    return infer_shapes(both).select("key", "level", F.coalesce(F.col("size").cast("string"), F.lit("variable")).alias("size"), "type")


QUERIES["infer_shapes"] = _shapes
ORACLES["infer_shapes"] = """
WITH t AS (SELECT doc_id, embedding, string_split(text, chr(10)) AS lines FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
w AS (SELECT len(string_split(unnest(lines), ' ')) AS n FROM t),
z(key, level, lo, hi, type) AS (
  SELECT 'doc_id', 0, 1, 1, 'int' UNION ALL SELECT 'nothing', 0, -1, -1, 'int'
  UNION ALL SELECT 'embedding', 0, min(len(embedding)), max(len(embedding)), 'float' FROM t
  UNION ALL SELECT 'lines', 0, min(len(lines)) FILTER (len(lines) > 0), max(len(lines)), 'str' FROM t
  UNION ALL SELECT 'words', 0, min(len(lines)) FILTER (len(lines) > 0), max(len(lines)), 'str' FROM t
  UNION ALL SELECT 'words', 1, min(n), max(n), 'str' FROM w)
SELECT key, level, CASE WHEN lo = hi THEN cast(lo AS VARCHAR) ELSE 'variable' END AS size, type FROM z"""


def _vector_scores(s, d):
    e = table(s, d, "embeddings")
    made = P.make_pairs(with_stage(e.select("vec_id"), "vec_id", SEED), "vec_id", SEED, 0, 2)
    a = e.select(F.col("vec_id").alias("seed_id"), F.col("embedding").alias("a"), F.col("label").alias("la"))
    b = e.select(F.col("vec_id").alias("base_id"), F.col("embedding").alias("b"), F.col("label").alias("lb"))
    j = made.drop("label").join(a, "seed_id").join(b, "base_id")
    return j.select("pair_id", "stage", F.round(V.cosine01(F.col("a"), F.col("b")), 6).alias("score"), (F.col("la") == F.col("lb")).cast("int").alias("label"))


def _evaluated(s, d):
    r = K.evaluate(_vector_scores(s, d), ["stage"])
    return r.select("stage", "tp", "fp", "fn", "tn", *[F.round(c, 8).alias(c) for c in ("accuracy", "precision", "recall", "f1", "loss", "auc")])


QUERIES["evaluate_scores"] = _evaluated
ORACLES["evaluate_scores"] = f"""
WITH s AS ({sql_split("embeddings", "vec_id")}), {sql_pairs("s", "vec_id", 0, 2)},
v AS (SELECT stage, round((list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2, 6) AS score, (a.label = b.label)::INTEGER AS label
  FROM pairs JOIN embeddings a ON a.vec_id = seed_id JOIN embeddings b ON b.vec_id = base_id),
k AS (SELECT *, round_even(score, 0) AS pred, greatest(1e-7, least(1 - 1e-7, score)) AS p,
  rank() OVER (PARTITION BY stage ORDER BY score) + (count(*) OVER (PARTITION BY stage, score) - 1) / 2.0 AS rk FROM v),
c AS (SELECT stage, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn,
  count(*) FILTER (label = 0 AND pred = 0) AS tn, -avg(label * ln(p) + (1 - label) * ln(1 - p)) AS loss, sum(label) AS pos, count(*) AS n, sum(rk) FILTER (label = 1) AS rs FROM k GROUP BY stage),
m AS (SELECT *, tp / (tp + fp + 1e-5) AS pr, tp / (tp + fn + 1e-5) AS re FROM c)
SELECT stage, tp, fp, fn, tn, round(100 * (tp + tn) / n, 8) AS accuracy, round(pr, 8) AS precision, round(re, 8) AS recall,
  round(2 * pr * re / (pr + re + 1e-5), 8) AS f1, round(loss, 8) AS loss, round((rs - pos * (pos + 1) / 2) / (pos * (n - pos)), 8) AS auc FROM m"""


def _lexed(s, d):
    """The documents in lexed form: lexed once each, then paired and mixed by lines."""
    return texts(s, d).select("doc_id", lexed_lines(F.col("text")).alias("text"))


def _mixed(s, d, corpus):
    """Pairs of ``corpus`` (texts, or their lexed form)."""
    made = P.attach(P.make_pairs(_staged(s, d), "doc_id", SEED), corpus, pack=True)
    target = E.inject(F.col("alt_text"), F.col("base_text"), draw(SEED, "inject", "pair_id"))
    return made.select("pair_id", "seed_id", "stage", "label", "seed_text", target.alias("target_text"))


# ---- features of pairs ------------------------------------------------------


def _all_features(s, d):
    corpus = cut(_lexed(s, d), "zstd")  # read for the pairs and for the counts of the seeds
    f = K.pair_features(_mixed(s, d, corpus), vocab=cut(_vocab(s, d)), corpus=corpus, lexed=True)
    return f.select("pair_id", "stage", "label", *[F.round(c, 6).alias(c) for c in (*K.FEATURES, "tf_cosine")])


QUERIES["pair_features"] = _all_features
_hist = lambda c: f"list_transform(string_split('{K.LETTERS}', ''), lambda x: (length({c}) - length(replace({c}, x, '')))::DOUBLE)"
_ratio = lambda a, b: f"round(CASE WHEN {b} = 0 THEN 0 ELSE ({a}) / ({b})::DOUBLE END, 6)"
_made = f"""att AS (SELECT pairs.*, x.text AS seed_text, {sql_inject("y.text", "z.text", sql_draw("inject", "pair_id"))} AS target_text FROM pairs
  JOIN documents x ON x.doc_id = seed_id JOIN documents y ON y.doc_id = alt_id JOIN documents z ON z.doc_id = base_id)"""
_letters_of = lambda c: f"array_to_string(list_transform({sql_raw(c)}, lambda x: {sql_class(True)}), '')"
_features_sql = f"""
l AS MATERIALIZED (SELECT pair_id, stage, label, {_letters_of("seed_text")} AS a, {_letters_of("target_text")} AS b,
  list_distinct({sql_raw("seed_text")}) AS s, list_distinct({sql_raw("target_text")}) AS t FROM att),
h AS (SELECT *, length(a) AS n, length(b) AS m, len(list_intersect(s, t)) AS k FROM l)"""
ORACLES["pair_features"] = f"""
WITH {VOCAB}, {_made}, {_features_sql},
g AS (SELECT doc_id, id, count(*) AS n FROM (SELECT doc_id, unnest({sql_tokens("text", "value")}) AS token FROM documents) JOIN vocab USING (token) GROUP BY ALL),
tu AS (SELECT pair_id, id, count(*) AS n FROM (SELECT pair_id, unnest({sql_tokens("target_text", "value")}) AS token FROM att) JOIN vocab USING (token) GROUP BY ALL),
gg AS (SELECT doc_id, sum(n * n) AS q FROM g GROUP BY doc_id), uu AS (SELECT pair_id, sum(n * n) AS q FROM tu GROUP BY pair_id),
gu AS (SELECT tu.pair_id, sum(g.n * tu.n) AS dot FROM tu JOIN pairs USING (pair_id) JOIN g ON g.doc_id = seed_id AND g.id = tu.id GROUP BY tu.pair_id)
SELECT h.pair_id, h.stage, h.label, {_ratio("least(n, m)", "greatest(n, m)")} AS size_ratio,
  round(greatest(0, least(1, (CASE WHEN n = 0 OR m = 0 THEN 0 ELSE list_cosine_similarity({_hist("a")}, {_hist("b")}) END + 1) / 2)), 6) AS class_cosine,
  {_ratio("k", "len(s) + len(t) - k")} AS overlap, {_ratio("k", "len(s)")} AS containment, {_ratio("levenshtein(a, b)", "greatest(n, m)")} AS token_delta,
  {_ratio("abs(n - m)", "n")} AS size_delta, round(CASE WHEN gg.q * uu.q > 0 THEN coalesce(dot, 0) / sqrt(gg.q * uu.q) ELSE 0 END, 6) AS tf_cosine
FROM h JOIN pairs USING (pair_id) LEFT JOIN gg ON gg.doc_id = seed_id LEFT JOIN uu USING (pair_id) LEFT JOIN gu USING (pair_id)"""

# a rate so large that the validation loss goes up again
PLAIN, RATE = ("size_ratio", "overlap", "size_delta"), 24.0


def _trained_until(s, d):
    """The history of a training that stops, with the best epoch marked and its loss from the scores of the weights that it gives back."""
    features = cut(K.pair_features(_mixed(s, d, _lexed(s, d)), lexed=True).where("stage <> 'test'").select("pair_id", "stage", "label", *[F.round(c, 9).alias(c) for c in PLAIN]))
    path = scratch(s, "history")
    model = K.train_until(features, PLAIN, path, F.col("stage") == "train", 12, 2, RATE)
    held = features.where("stage = 'validation'").select("label", model.score().alias("p"))
    loss = -F.avg(F.col("label") * F.log("p") + (1 - F.col("label")) * F.log(1 - F.col("p")))
    again = held.agg(loss.alias("again")).withColumn("epoch", F.lit(model.best_epoch))
    rows = C.read_history(s, path, "epoch int, train_loss double, validation_loss double").join(again, "epoch", "left")
    return rows.select("epoch", *[F.round(c, 6).alias(c) for c in ("train_loss", "validation_loss")], F.coalesce(F.round("again", 6), F.lit(-1.0)).alias("best"))


QUERIES["train_until"] = _trained_until
_z = ["(x0 - m0) / s0", "(x1 - m1) / s1", "(x2 - m2) / s2"]
ORACLES["train_until"] = f"""
WITH RECURSIVE s AS ({STAGED}), {sql_pairs("s", "doc_id")}, {_made}, {_features_sql},
f AS MATERIALIZED (SELECT stage, label, round(CASE WHEN greatest(n, m) = 0 THEN 0 ELSE least(n, m) / greatest(n, m)::DOUBLE END, 9) AS x0,
  round(CASE WHEN len(s) + len(t) = k THEN 0 ELSE k / (len(s) + len(t) - k)::DOUBLE END, 9) AS x1, round(CASE WHEN n = 0 THEN 0 ELSE abs(n - m) / n::DOUBLE END, 9) AS x2
  FROM h WHERE stage <> 'test'),
o AS (SELECT avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x0) AS s0, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2 FROM f WHERE stage = 'train'),
z AS MATERIALIZED (SELECT stage, label, {_z[0]} AS z0, {_z[1]} AS z1, {_z[2]} AS z2 FROM f, o),
r(epoch, w0, w1, w2, b) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT epoch + 1, w0 - {RATE} * avg((p - label) * z0), w1 - {RATE} * avg((p - label) * z1), w2 - {RATE} * avg((p - label) * z2), b - {RATE} * avg(p - label)
  FROM (SELECT r.*, z.*, 1 / (1 + exp(-(w0 * z0 + w1 * z1 + w2 * z2 + b))) AS p FROM r, z WHERE stage = 'train' AND epoch < 12) GROUP BY epoch, w0, w1, w2, b),
e AS (SELECT epoch, stage, avg(-(label * ln(q) + (1 - label) * ln(1 - q))) AS loss FROM (SELECT epoch, stage, label,
  greatest(1e-7, least(1 - 1e-7, 1 / (1 + exp(-(w0 * z0 + w1 * z1 + w2 * z2 + b))))) AS q FROM r, z WHERE epoch > 0) GROUP BY epoch, stage),
v AS (SELECT a.epoch, a.loss AS tr, b.loss AS va FROM e a JOIN e b USING (epoch) WHERE a.stage = 'train' AND b.stage = 'validation'),
b AS (SELECT x.*, (SELECT arg_min(y.epoch, (y.va, y.epoch)) FROM v y WHERE y.epoch <= x.epoch) AS top FROM v x),
k AS (SELECT * FROM b WHERE epoch <= coalesce((SELECT min(epoch) FROM b WHERE epoch - top >= 2), 12))
SELECT cast(epoch AS INTEGER) AS epoch, round(tr, 6) AS train_loss, round(va, 6) AS validation_loss,
  CASE WHEN epoch = (SELECT arg_min(epoch, (va, epoch)) FROM k) THEN round(va, 6) ELSE -1.0 END AS best FROM k"""


def _arguments(s, d):
    """Arguments as JSON, arguments that cannot be read, and a model of other stages: with that much ridge all scores are the share of label 1."""
    pairs = P.attach(P.make_pairs(_staged(s, d), "doc_id", SEED, 2, 1), _lexed(s, d), pack=True).withColumnRenamed("base_text", "target_text")
    features = cut(K.pair_features(pairs.select("pair_id", "stage", "label", "seed_text", "target_text"), lexed=True))
    K.MODELS["two_features"] = lambda **kw: [VectorAssembler(inputCols=["overlap", "size_delta"], outputCol="features"), LogisticRegression(**{"regParam": 1e4, **kw})]
    out = []
    for name, arguments in (("logistic", '{"regParam": 1e4, "maxIter": 5}'), ("two_features", "{not json"), ("two_features", '{"maxIter": 3}')):
        model = K.train(features.where("stage = 'train'"), name, arguments)
        scored = K.score(model, features).groupBy("stage").agg(F.count("*").alias("rows"), F.round(F.min("score"), 4).alias("least"), F.round(F.max("score"), 4).alias("most"))
        out.append(scored.withColumn("model", F.lit(f"{name} {len(K.parse_arguments(arguments))}")))
    return functools.reduce(lambda a, b: a.unionByName(b), out)


QUERIES["model_arguments"] = _arguments
ORACLES["model_arguments"] = f"""
WITH s AS ({STAGED}), {sql_pairs("s", "doc_id", 2, 1)}, t AS (SELECT round(avg(label), 4) AS share FROM pairs WHERE stage = 'train')
SELECT stage, count(*) AS rows, any_value(share) AS least, any_value(share) AS most, model FROM pairs, t,
  (VALUES ('logistic 2'), ('two_features 0'), ('two_features 1')) m(model) GROUP BY stage, model"""


def _train_evaluate(s, d):
    features = cut(K.pair_features(_mixed(s, d, _lexed(s, d)), lexed=True))  # numbers only; read by every pass of the fit
    model = K.train(features.where("stage = 'train'"))
    r = K.evaluate(K.score(model, features.where("stage <> 'train'")), ["stage"])
    return r.select("stage", "tp", "fp", "fn", "tn", *[F.round(c, 3).alias(c) for c in ("accuracy", "precision", "recall", "f1", "auc")])


QUERIES["train_evaluate"] = _train_evaluate


def _saved(s, d):
    """Scores of a model against those of the same model stored and read again."""
    features = cut(K.pair_features(_mixed(s, d, _lexed(s, d)), lexed=True))
    model, path = K.train(features.where("stage = 'train'")), scratch(s, "model")
    K.save(model, path)
    live = K.score(model, features).select("pair_id", "stage", F.col("score").alias("a"))
    back = K.score(K.load(path), features).select("pair_id", F.col("score").alias("b"))
    return live.join(back, "pair_id").groupBy("stage").agg(F.count("*").alias("rows"), F.count_if(F.col("a") != F.col("b")).alias("different"))


QUERIES["saved_model"] = _saved
ORACLES["saved_model"] = f"""
WITH s AS ({STAGED}), {sql_pairs("s", "doc_id")} SELECT stage, count(*) AS rows, 0::BIGINT AS different FROM pairs GROUP BY stage"""


def _encoder_scores(s, d):
    cells = E.apply_profiles(_attached(s, d), SEED, keep=["stage", "label", "seed_text"])
    scored = K.score_pairs(cells)
    r = K.evaluate(scored.withColumn("score", F.round("score", 9)), ["exp", "mix", "stage"])
    return r.select("exp", "mix", "stage", "tp", "fp", "fn", "tn", F.round("auc", 6).alias("auc"))


QUERIES["encoder_scores"] = _encoder_scores
_bag = lambda key, text, source: f"""
SELECT {key}, bucket, sum(sign) AS c FROM (SELECT {key}, ('0x' || substr(m, 1, 15))::BIGINT % 256 AS bucket,
  CASE WHEN substr(m, 16, 1) < '8' THEN 1 ELSE -1 END AS sign
  FROM (SELECT {key}, md5(unnest(list_filter(regexp_split_to_array({text}, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> ''))) AS m FROM {source})) GROUP BY {key}, bucket"""
_cells = " UNION ALL ".join(
    sql_cell({"exp": e, "mix": m}, {**DEFAULT_FLAGS, **EXPERIMENT_FLAGS[e], "dead": str(m == "M3").lower()}, False, m != "M1", out="hdr || t AS target")
    for e in EXPERIMENTS for m in MIXES
)
ORACLES["encoder_scores"] = f"""
WITH {ATTACHED}, cells AS ({_cells}),
a AS ({_bag("doc_id", "text", "documents")}), na AS (SELECT doc_id, sum(c * c) AS q FROM a GROUP BY doc_id),
b AS ({_bag("pair_id, exp, mix", "target", "cells")}), nb AS (SELECT pair_id, exp, mix, sum(c * c) AS q FROM b GROUP BY ALL),
ab AS (SELECT b.pair_id, exp, mix, sum(a.c * b.c) AS dot FROM b JOIN pairs USING (pair_id) JOIN a ON a.doc_id = seed_id AND a.bucket = b.bucket GROUP BY ALL),
v AS (SELECT cells.exp, cells.mix, stage, pairs.label,
  round((CASE WHEN na.q * nb.q > 0 THEN coalesce(dot, 0) / (sqrt(na.q) * sqrt(nb.q)) ELSE 0 END + 1) / 2, 9) AS score
  FROM cells JOIN pairs USING (pair_id) LEFT JOIN na ON na.doc_id = seed_id LEFT JOIN nb USING (pair_id, exp, mix) LEFT JOIN ab USING (pair_id, exp, mix)),
k AS (SELECT *, round_even(score, 0) AS pred, rank() OVER (PARTITION BY exp, mix, stage ORDER BY score)
  + (count(*) OVER (PARTITION BY exp, mix, stage, score) - 1) / 2.0 AS rk FROM v),
c AS (SELECT exp, mix, stage, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn,
  count(*) FILTER (label = 0 AND pred = 0) AS tn, sum(label) AS pos, count(*) AS n, sum(rk) FILTER (label = 1) AS rs FROM k GROUP BY ALL)
SELECT exp, mix, stage, tp, fp, fn, tn, round((rs - pos * (pos + 1) / 2) / (pos * (n - pos)), 6) AS auc FROM c"""
