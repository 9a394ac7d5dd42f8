"""A corpus pipeline: quality rules, line dedup, near-duplicates, mixing, piece codes.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All but the last return the columns of ``documents``. Stages that hand texts to Python
workers set the session to small Arrow batches, as four of them share an executor. Null texts count as
empty, and so go with the first stage; the other stages keep their own rules for
nulls, repeated rows and empty tables (see the operators).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairlake.llm import linededup, mixing, ngramjoin, pieces, quality
from pairlake.llm.common import table
from pairlake.session import cut, cuts, drop_cuts, small_batches


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go."""
    small_batches(spark)
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    judged = quality.judge(docs, trusted)
    return judged.where(F.col(judged.columns[-1])).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages and chunks of lines go, no document does; ``n_chars`` follows the text."""
    small_batches(spark)
    less = linededup.dedup(docs, words=linededup.PASSAGE_WORDS).select(*docs.columns)
    return less.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else less


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    small_batches(spark)
    return ngramjoin.keep_first(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the mixed order."""
    return mixing.ordered(docs)


def piece_codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, text, position): the codes of each document, the text that they decode to, and its place in the mixed order."""
    small_batches(spark)
    placed, position = mixing.read_position(docs)
    coded = pieces.encode(placed).select("doc_id", "lang", "source", "ids", F.col(position).alias("position"))
    return coded.select("doc_id", "lang", "source", "ids", pieces.decode(coded).alias("text"), "position")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("piece_codes", piece_codes),
]

#: The likelihood ratios, content-defined chunks, shingle sets and merges have no practical SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs, before = table(spark, sf_dir, "documents"), set(cuts(spark))
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            used = [path for path in cuts(spark) if path not in before]
            docs = cut(docs)
            drop_cuts(spark, used)  # the next stage reads what is written now
    return docs
