"""The whole way from a corpus to the question: how far is a target from its seed?"""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlake.functions import edit
from pairlake.functions.draws import draw
from pairlake.functions.lexer import class_lines
from pairlake.operators import pairs as P
from pairlake.operators import perturb as E
from pairlake.operators.splits import with_stage
from pairlake.plans.common import SEED, sql_draw, table, texts
from pairlake.plans.perturbing import ATTACHED, sql_inject
from pairlake.session import fan_out
from pairlake.plans.texts import sql_class, sql_raw


def flagship(spark, folder):
    """Split, positive and negative pairs, alt mixed into base, whole texts lexed, token
    distance, report per stage and label.

    Lexing is per document and before the pairing: what is shuffled to the pairs
    is one letter per token with the line breaks, which is all that mixing by
    lines and the distance need.
    """
    docs = table(spark, folder, "documents")
    keys = with_stage(docs.select("doc_id"), "doc_id", SEED)
    letters = texts(spark, folder).select("doc_id", class_lines(F.col("text")).alias("text"))
    made = P.attach(P.make_pairs(keys, "doc_id", SEED), letters)
    target = E.inject(F.col("alt_text"), F.col("base_text"), draw(SEED, "inject", "pair_id"))
    flat = lambda c: F.replace(c, F.lit("\n"), F.lit(""))
    lexed = fan_out(made.select("pair_id", "stage", "label", flat(F.col("seed_text")).alias("seed"), flat(target).alias("target")), "pair_id")
    far = edit.string_distance(F.col("seed"), F.col("target"))
    sized = lexed.select("stage", "label", F.length("seed").alias("n"), F.length("target").alias("m"), far.alias("ed"))
    return sized.groupBy("stage", "label").agg(
        F.count("*").alias("pairs"), F.sum(F.col("n").cast("bigint")).alias("seed_tokens"),
        F.sum(F.col("m").cast("bigint")).alias("target_tokens"), F.sum("ed").alias("token_ed"),
        F.max("ed").alias("max_ed"), F.round(F.avg(F.try_divide("ed", "n")), 6).alias("token_delta"),
    )


QUERIES = {"flagship": flagship}
_letters = lambda c: f"array_to_string(list_transform({sql_raw(c)}, lambda x: {sql_class(True)}), '')"
ORACLES = {
    "flagship": f"""
WITH {ATTACHED},
m AS (SELECT stage, label, seed_text, {sql_inject("alt_text", "base_text", sql_draw("inject", "pair_id"))} AS target_text FROM att),
l AS (SELECT stage, label, {_letters("seed_text")} AS a, {_letters("target_text")} AS b FROM m),
e AS (SELECT stage, label, length(a) AS n, length(b) AS m, levenshtein(a, b) AS ed FROM l)
SELECT stage, label, count(*) AS pairs, cast(sum(n) AS BIGINT) AS seed_tokens, cast(sum(m) AS BIGINT) AS target_tokens,
  cast(sum(ed) AS BIGINT) AS token_ed, max(ed) AS max_ed, round(avg(ed / nullif(n, 0)), 6) AS token_delta FROM e GROUP BY stage, label"""
}
