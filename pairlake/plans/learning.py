"""Registered queries: metrics, losses, vocabulary, encoding, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlake.functions import vectors as V
from pairlake.functions.draws import draw
from pairlake.functions.lexer import lex, raw_tokens, tokens
from pairlake.functions.lexing import token_text
from pairlake.operators import embedding as B
from pairlake.operators import metrics as M
from pairlake.operators import pairs as P
from pairlake.operators import sequences as Q
from pairlake.operators import vocab as I
from pairlake.plans.common import SEED, sql_draw, sql_pairs, table, texts
from pairlake.plans.measuring import VECTOR_PAIRS, _soft, _vector_pairs
from pairlake.plans.pairing import STAGED, _staged
from pairlake.plans.texts import sql_raw, sql_tokens
from pairlake.session import cut

QUERIES, ORACLES = {}, {}


def _scores(s, d):
    score = (F.pmod(draw(SEED, "score", "doc_id"), F.lit(100)) + 30 * F.col("quality")) / F.lit(130.0)
    return table(s, d, "labels").select("doc_id", F.col("quality").alias("label"), "toxic", score.alias("score")).withColumn(
        "pred", F.rint("score").cast("int"))


SCORES = f"""sc AS (SELECT *, cast(round_even(score, 0) AS INTEGER) AS pred FROM (SELECT doc_id, quality AS label, toxic,
  ({sql_draw("score", "doc_id")} % 100 + 30 * quality) / 130.0 AS score FROM labels))"""
CM = """SELECT toxic, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp,
  count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 0 AND pred = 0) AS tn FROM sc GROUP BY toxic"""
AUC = """SELECT toxic, (sum(rk) FILTER (label = 1) - p * (p + 1) / 2) / (p * (n - p)) AS auc FROM (
  SELECT s.*, (SELECT count(*) FROM sc t WHERE t.toxic = s.toxic AND t.score < s.score)
    + ((SELECT count(*) FROM sc t WHERE t.toxic = s.toxic AND t.score = s.score) + 1) / 2.0 AS rk,
    sum(label) OVER (PARTITION BY toxic) AS p, count(*) OVER (PARTITION BY toxic) AS n FROM sc s) GROUP BY toxic, p, n"""

QUERIES["confusion"] = lambda s, d: M.confusion(_scores(s, d), "label", "pred", ["toxic"])
ORACLES["confusion"] = f"WITH {SCORES} {CM}"


def _rounded(df, *names):
    return df.select(*[F.round(c, 9).alias(c) if c in names else c for c in df.columns])


QUERIES["classification_metrics"] = lambda s, d: _rounded(
    M.classification_metrics(M.confusion(_scores(s, d), "label", "pred", ["toxic"])), "accuracy", "precision", "recall", "f1"
)
ORACLES["classification_metrics"] = f"""
WITH {SCORES}, c AS ({CM}), p AS (SELECT *, tp / (tp + fp + 1e-5) AS pr, tp / (tp + fn + 1e-5) AS re FROM c)
SELECT toxic, tp, fp, fn, tn, round(100 * (tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round(pr, 9) AS precision,
  round(re, 9) AS recall, round(2 * pr * re / (pr + re + 1e-5), 9) AS f1 FROM p"""

QUERIES["roc_auc"] = lambda s, d: _rounded(M.roc_auc(_scores(s, d), "score", "label", ["toxic"]), "auc")
ORACLES["roc_auc"] = f"WITH {SCORES} SELECT toxic, round(auc, 9) AS auc FROM ({AUC})"

QUERIES["threshold_metrics"] = lambda s, d: _rounded(
    M.threshold_metrics(_scores(s, d), "score", "label", ["toxic"]), "accuracy", "precision", "recall", "loss", "auc"
)
ORACLES["threshold_metrics"] = f"""
WITH {SCORES}, x AS (SELECT toxic, label, score, score > 0.5 AS hit, greatest(1e-7, least(1 - 1e-7, score)) AS p FROM sc),
b AS (SELECT toxic, avg(CASE WHEN hit = (label = 1) THEN 1.0 ELSE 0.0 END) AS accuracy,
  coalesce(count(*) FILTER (hit AND label = 1) / nullif(count(*) FILTER (hit), 0), 0.0) AS precision,
  coalesce(count(*) FILTER (hit AND label = 1) / nullif(count(*) FILTER (label = 1), 0), 0.0) AS recall,
  -avg(label * ln(p) + (1 - label) * ln(1 - p)) AS loss FROM x GROUP BY toxic)
SELECT toxic, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall, round(loss, 9) AS loss,
  round(auc, 9) AS auc FROM b JOIN ({AUC}) USING (toxic)"""


def _losses(s, d):
    v = _vector_pairs(s, d).select(
        "partner", (F.col("la") == F.col("lb")).cast("int").alias("label"), V.cosine01(F.col("a"), F.col("b")).alias("score"),
        V.softmax(F.transform("a", lambda x: x.cast("double") * 5)).alias("probs"),
        V.softmax(F.transform("b", lambda x: x.cast("double") * 5)).alias("other"), "la", "lb",
    ).withColumn("overlap", V.overlap_penalty(F.col("probs"), F.col("other"), F.col("la"), F.col("lb")))
    one = [F.col(c) for c in ("score", "label", "probs")]
    r = v.groupBy("label").agg(
        F.count("*").alias("rows"), M.bce(one[0], one[1]).alias("bce"), M.likelihood_loss(*one).alias("likelihood"),
        M.weighted_loss(*one).alias("two_terms"), M.weighted_loss(*one, F.col("overlap")).alias("three_terms"),
    )
    return _rounded(r, "bce", "likelihood", "two_terms", "three_terms")


QUERIES["losses"] = _losses
ORACLES["losses"] = f"""
WITH {VECTOR_PAIRS}, v AS (SELECT la, lb, (la = lb)::INTEGER AS label, greatest(0, least(1, (list_cosine_similarity(a, b) + 1) / 2)) AS score,
  a AS a3, b AS b3 FROM vp),
w AS (SELECT *, {_soft("a3")} AS probs, {_soft("b3")} AS other FROM v),
x AS (SELECT *, greatest(1e-7, least(1 - 1e-7, score)) AS p, list_sum(list_transform(probs, lambda q: -ln(q + 1e-10)))
    * CASE WHEN round_even(score, 0) = label THEN 1 ELSE -1 END AS ml,
  CASE WHEN la <> lb THEN 1 - list_sum(list_transform(list_zip(probs, other), lambda z: z[1] * ln(z[1] / z[2]))) ELSE 0 END AS ov FROM w),
y AS (SELECT label, count(*) AS rows, -avg(label * ln(p) + (1 - label) * ln(1 - p)) AS bce, avg(ml) AS likelihood, avg(ov * ov) AS sq FROM x GROUP BY label)
SELECT label, rows, round(bce, 9) AS bce, round(likelihood, 9) AS likelihood, round(0.2 * bce + 0.8 * likelihood, 9) AS two_terms,
  round(0.2 * bce + 0.8 * likelihood + 0.4 * sq, 9) AS three_terms FROM y"""

# ---- vocabulary -----------------------------------------------------------


def _train_weights(s, d):
    """How often each document stands on either side of a training pair (ids only)."""
    made = P.make_pairs(_staged(s, d), "doc_id", SEED).where("stage = 'train'")
    sides = made.select(F.explode(F.array("seed_id", "base_id")).alias("doc_id"))
    return sides.groupBy("doc_id").agg(F.count("*").alias("times"))


def _vocab(s, d):
    # texts are read once, weighted by their use, instead of once per pair
    docs = texts(s, d).select("doc_id", token_text(F.col("text"), "value")["tokens"].alias("toks"))
    return I.fit_vocab(docs.join(_train_weights(s, d), "doc_id"), ["toks"], weight="times")


VOCAB = f"""s AS ({STAGED}), {sql_pairs("s", "doc_id")},
u AS (SELECT doc_id, count(*) AS times FROM (SELECT seed_id AS doc_id FROM pairs WHERE stage = 'train'
  UNION ALL SELECT base_id FROM pairs WHERE stage = 'train') GROUP BY doc_id),
k AS (SELECT token, cast(sum(times) AS BIGINT) AS freq FROM (SELECT unnest({sql_tokens("text", "value")}) AS token, times FROM documents JOIN u USING (doc_id)) GROUP BY token),
vocab AS (SELECT token, cast(row_number() OVER (ORDER BY freq DESC, token) + 1 AS INTEGER) AS id, freq FROM k ORDER BY freq DESC, token LIMIT 2498)"""

QUERIES["fit_vocab"] = _vocab
ORACLES["fit_vocab"] = f"WITH {VOCAB} SELECT * FROM vocab"


LENGTH = 6000  # fixed value: the sequence length of the models


def _encoded(s, d, n=LENGTH):
    docs = texts(s, d).select("doc_id", token_text(F.col("text"), "value")["tokens"].alias("toks"))
    return I.encode(docs, "doc_id", "toks", _vocab(s, d), n)


_ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
QUERIES["encode"] = lambda s, d: _encoded(s, d).select(
    "doc_id", "length", F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")).alias("ids"), F.size(F.filter(I.padding_mask(F.col("ids")), lambda m: m)).alias("real")
)
ENCODED = f"""{VOCAB},
ex AS (SELECT doc_id, unnest(({sql_tokens("text", "value")})[1:{LENGTH}]) AS token, generate_subscripts(({sql_tokens("text", "value")})[1:{LENGTH}], 1) AS pos FROM documents),
en AS (SELECT documents.doc_id, coalesce(list(coalesce(id, 1) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS ids
  FROM documents LEFT JOIN ex ON ex.doc_id = documents.doc_id LEFT JOIN vocab USING (token) GROUP BY documents.doc_id)"""
ORACLES["encode"] = f"""
WITH {ENCODED} SELECT doc_id, len(ids) AS length, len(ids) AS real,
  md5(array_to_string(list_concat(ids, list_transform(range({LENGTH} - len(ids)), lambda x: 0)), ' ')) AS ids FROM en"""


def _batched(s, d):
    lens = table(s, d, "documents").select("doc_id", F.transform(
        F.split("text", "\n"), lambda x: F.length(x)).alias("ids"))
    return I.batch(lens, "doc_id", "ids", 64, SEED, pad=True).select(
        "doc_id", "batch_id", F.size("ids").alias("width"), _ids("ids"))


QUERIES["batch"] = _batched
ORACLES["batch"] = f"""
WITH r AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS ids,
  (row_number() OVER (ORDER BY {sql_draw("batch", "doc_id")}, doc_id) - 1) // 64 AS batch_id FROM documents),
w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS width FROM r)
SELECT doc_id, batch_id, width, array_to_string(list_concat(ids, list_transform(range(width - len(ids)), lambda x: 0)), ' ') AS ids FROM w"""


def _embedded(s, d):
    part = lambda i: ((F.pmod(draw(SEED, f"dim{i}", "token"), F.lit(2001)) - 1000) / F.lit(1000.0))
    vectors = _vocab(s, d).select("token", F.array(*[part(i) for i in range(4)]).alias("vec"))
    toks = lex(texts(s, d), ["doc_id"], mode="value").select("doc_id", F.col("value").alias("token"))
    e = I.embed(toks, "doc_id", F.broadcast(vectors), 4)  # the vocabulary limit bounds it
    return e.select("doc_id", *[F.round(F.get("vector", F.lit(i)), 6).alias(f"v{i}") for i in range(4)])


QUERIES["embed"] = _embedded
ORACLES["embed"] = f"""
WITH {VOCAB}, t AS (SELECT doc_id, unnest({sql_tokens("text", "value")}) AS token FROM documents)
SELECT doc_id, {", ".join(f"round(avg(({sql_draw(f'dim{i}', 'token')} % 2001 - 1000) / 1000.0), 6) AS v{i}" for i in range(4))}
FROM t JOIN vocab USING (token) GROUP BY doc_id"""



def _cooccurring(s, d):
    docs = texts(s, d).select(tokens(F.col("text"), "value").alias("toks"))
    return B.cooccurrence(docs, "toks", _vocab(s, d), 2)


QUERIES["cooccurrence"] = _cooccurring
ORACLES["cooccurrence"] = f"""
WITH {VOCAB}, t AS (SELECT doc_id, unnest({sql_tokens("text", "value")}) AS token, generate_subscripts({sql_tokens("text", "value")}, 1) AS pos FROM documents),
i AS (SELECT doc_id, pos, id FROM t JOIN vocab USING (token)),
p AS (SELECT x.id AS a, y.id AS b FROM i x JOIN i y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1 UNION ALL
  SELECT x.id, y.id FROM i x JOIN i y ON x.doc_id = y.doc_id AND y.pos = x.pos + 2)
SELECT a, b, count(*) AS n FROM (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) GROUP BY a, b"""


def _trained(s, d):
    """Documents by the mean of trained vectors. The directions are orthogonal, so their products over the vocabulary vanish."""
    docs = texts(s, d).select("doc_id", tokens(F.col("text"), "value").alias("toks"))
    vectors = cut(B.train_table(docs, "toks", _vocab(s, d), 4, 2))
    toks = docs.select("doc_id", F.explode("toks").alias("token"))
    e = I.embed(toks, "doc_id", F.broadcast(vectors), 4)  # the vocabulary limit bounds it
    return e.select("doc_id", *[F.round(F.get("vector", F.lit(i)), 4).alias(f"v{i}") for i in range(4)])


QUERIES["embed_trained"] = _trained

# ---- sequences ------------------------------------------------------------

KERNELS = ([1, 2, 3, 2, 1], [1, -1, 1, -1], [2, 0, 1])


def _sizes(s, d):
    return texts(s, d).select("doc_id", F.transform(raw_tokens(F.col("text")), lambda t: F.length(t)).alias("seq"))


_sizes_sql = f"SELECT doc_id, list_transform({sql_raw('text')}, lambda x: length(x)) AS seq FROM documents"
_score_sql = lambda k: "list_transform(seq, lambda x, i: " + " + ".join(
    f"{w} * coalesce(CASE WHEN i + {j - (len(k) - 1) // 2} >= 1 THEN seq[i + {j - (len(k) - 1) // 2}] END, 0)" for j, w in enumerate(k)
) + ")"

QUERIES["window_score"] = lambda s, d: _sizes(s, d).select(
    "doc_id", *[F.md5(F.array_join(F.transform(Q.window_score(F.col("seq"), k), lambda x: x.cast("int").cast("string")), ",")).alias(f"k{len(k)}") for k in KERNELS]
)
ORACLES["window_score"] = "SELECT doc_id, " + ", ".join(
    f"md5(array_to_string(list_transform({_score_sql(k)}, lambda x: cast(x AS VARCHAR)), ',')) AS k{len(k)}" for k in KERNELS
) + f" FROM ({_sizes_sql})"

QUERIES["select_segments"] = lambda s, d: Q.select_segments(_sizes(s, d), "doc_id", "seq", KERNELS, 16).select(
    "doc_id", *[F.get("peaks", F.lit(i)).alias(f"peak{i}") for i in range(3)],
    *[F.round(F.get("probs", F.lit(i)), 6).alias(f"prob{i}") for i in range(3)], _ids("selected"),
)
_sm = [f"(SELECT doc_id, seq, {_score_sql(k)} AS z FROM q)" for k in KERNELS]
ORACLES["select_segments"] = f"""
WITH q AS ({_sizes_sql}), """ + ", ".join(
    f"""f{i} AS (SELECT doc_id, seq, list_position(z, list_max(z)) - 1 AS at, 1 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) AS pr FROM {t})"""
    for i, t in enumerate(_sm)
) + """, g AS (SELECT f0.doc_id, f0.seq, [f0.at, f1.at, f2.at] AS peaks, f0.pr AS p0, f1.pr AS p1, f2.pr AS p2 FROM f0 JOIN f1 USING (doc_id) JOIN f2 USING (doc_id))
SELECT doc_id, peaks[1] AS peak0, peaks[2] AS peak1, peaks[3] AS peak2, round(p0, 6) AS prob0, round(p1, 6) AS prob1, round(p2, 6) AS prob2,
  array_to_string(list_transform(flatten(list_transform(peaks, lambda p: list_transform(range(16), lambda o:
    seq[least(least(p, greatest(len(seq) - 16, 0)) + o, len(seq) - 1) + 1]))), lambda v: cast(v AS VARCHAR)), ' ') AS selected FROM g"""


def _shown(name, places):
    """All places of a vector as text."""
    return F.array_join(F.transform(name, lambda x: F.format_string(f"%.{places}f", x)), ",").alias(name)


def _softmaxed(s, d):
    e = texts(s, d, "embeddings")
    soft = V.softmax(F.transform("embedding", lambda x: x.cast("double")))
    noisy = Q.gumbel_softmax(F.col("embedding"), SEED, "vec_id", temperature=0.5)
    return e.select("vec_id", soft.alias("p"), noisy.alias("g")).select(
        "vec_id", _shown("p", 9), F.round(V.total(F.col("p")), 6).alias("p_sum"),
        Q.peak(F.col("p"))["at"].alias("p_peak"), Q.peak(F.col("g"))["at"].alias("g_peak"), _shown("g", 7),
    )


QUERIES["softmax"] = _softmaxed
ORACLES["softmax"] = f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT vec_id, v, list_transform(v, lambda x, i: (x - ln(-ln(({sql_draw("soft", "vec_id", "(i - 1)")}::DOUBLE + 0.5) / 1152921504606846976.0))) / 0.5) AS y FROM e),
z AS (SELECT vec_id, v, y, list_sum(list_transform(v, lambda x: exp(x - list_max(v)))) AS sv, list_sum(list_transform(y, lambda x: exp(x - list_max(y)))) AS sy FROM n)
SELECT vec_id, array_to_string(list_transform(v, lambda x: printf('%.9f', exp(x - list_max(v)) / sv)), ',') AS p, 1.0::DOUBLE AS p_sum, list_position(v, list_max(v)) - 1 AS p_peak,
  list_position(y, list_max(y)) - 1 AS g_peak, array_to_string(list_transform(y, lambda x: printf('%.7f', exp(x - list_max(y)) / sy)), ',') AS g FROM z"""


def _early(s, d):
    daily = table(s, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))
    r = Q.early_stop(daily, "day", "v", 5, ["event_type"])
    return r.select("event_type", F.date_format("best_epoch", "yyyy-MM-dd").alias("best_epoch"), "best_value",
                    F.coalesce(F.date_format("stop_epoch", "yyyy-MM-dd"), F.lit("-")).alias("stop_epoch"))


QUERIES["early_stop"] = _early
ORACLES["early_stop"] = """
WITH d AS (SELECT event_type, cast(ts AS DATE) AS day, round(avg(value), 6) AS v FROM events GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i FROM d),
b AS (SELECT *, (SELECT max(y.i) FROM i y WHERE y.event_type = x.event_type AND y.i <= x.i AND NOT EXISTS
   (SELECT 1 FROM i z WHERE z.event_type = y.event_type AND z.i < y.i AND z.v <= y.v)) AS best FROM i x),
s AS (SELECT event_type, min(i) AS stop FROM b WHERE i - best >= 5 GROUP BY event_type),
r AS (SELECT b.*, stop FROM b LEFT JOIN s USING (event_type) WHERE stop IS NULL OR i <= stop)
SELECT event_type, strftime(arg_min(day, (v, i)), '%Y-%m-%d') AS best_epoch, min(v) AS best_value,
  coalesce(strftime(max(day) FILTER (i = stop), '%Y-%m-%d'), '-') AS stop_epoch FROM r GROUP BY event_type"""

QUERIES["gumbel_sample"] = lambda s, d: Q.gumbel_sample(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 50, SEED).select(
    "doc_id", "n_chars", F.round("score", 6).alias("score"))
ORACLES["gumbel_sample"] = f"""
SELECT doc_id, n_chars, round(score, 6) AS score FROM (SELECT doc_id, n_chars, ln(n_chars) - ln(-ln(({sql_draw("gumbel", "doc_id")}::DOUBLE + 0.5) / 1152921504606846976.0)) AS score
FROM documents WHERE n_chars > 0) ORDER BY score DESC, doc_id LIMIT 50"""
