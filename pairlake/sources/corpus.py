"""Corpus files: scans, list-driven scans, renumbering, derived files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairlake.operators.ranks import join_hot, running
from pairlake.session import cut


def scan_corpus(spark: SparkSession, path: str, glob: str = "*.js", recursive: bool = False) -> DataFrame:
    """(path, name, content): one row per file that fits the pattern."""
    reader = spark.read.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    where = F.col("_metadata.file_path")
    return reader.text(path, wholetext=True).select(
        where.alias("path"), F.element_at(F.split(where, "/"), -1).alias("name"), F.col("value").alias("content")
    )


def filter_names(df: DataFrame, name: str, suffix: str = "", not_prefix: str | None = None) -> DataFrame:
    keep = F.col(name).endswith(suffix)
    if not_prefix:
        keep = keep & ~F.col(name).startswith(not_prefix)
    return df.where(keep)


def renumber_corpus(df: DataFrame, path: str, prefix: str, suffix: str = "", ending: str = ".js") -> DataFrame:
    """(path, new_name): ``prefix-i[-j..]`` from the place of each entry in its directory.

    Places count files and directories alike, by name, from 0. They come from
    running counts over range partitions: a directory with most of all files is
    numbered by many tasks.
    """
    paths = df.select(F.col(path).alias("path")).distinct().withColumn("parts", F.split("path", "/"))
    levels = paths.select("path", F.posexplode("parts").alias("level", "name"), "parts").select(
        "path", "level", "name", F.array_join(F.slice("parts", F.lit(1), F.col("level")), "/").alias("parent")
    )
    entries = levels.groupBy("parent", "level", "name").agg(F.count("*").alias("uses"))
    placed = cut(running(entries, ["name"], {"upto": F.lit(1)}, by=["parent", "level"]))
    placed = placed.select("parent", "level", "name", "uses", (F.col("upto") - 1).alias("place"))
    # a top directory is an entry of very many paths
    found = join_hot(levels, placed, ["parent", "level", "name"], "uses")
    named = found.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("level", "place"))).alias("p")  # as many as the path is deep
    )
    numbers = F.array_join(F.transform("p", lambda r: r["place"].cast("string")), "-")
    return named.where(F.col("path").endswith(suffix)).select(
        "path", F.concat(F.lit(prefix + "-"), numbers, F.lit(ending)).alias("new_name")
    )


def scan_listed(listed: DataFrame, corpus: DataFrame, path: str, exclude_prefix: str) -> DataFrame:
    """The corpus rows of the listed paths with status 'ok', or 'failed' where the file is missing."""
    wanted = listed.where(~F.col(path).startswith(exclude_prefix)).select(path)
    found = corpus.withColumn("_found", F.lit(True))
    status = F.when(F.col("_found"), "ok").otherwise("failed")
    return wanted.join(found, path, "left").withColumn("status", status).drop("_found")


def derive(df: DataFrame, key: str, value: Column, ok: Column, reason: str) -> DataFrame:
    """(key, value, status, error): a derived text per input; failures are kept, not raised."""
    return df.select(
        key, F.when(ok, value).alias("value"), F.when(ok, "ok").otherwise("failed").alias("status"),
        F.when(~ok, F.lit(reason)).alias("error"),
    )


def write_derived(derived: DataFrame, path: str, key: str) -> None:
    """One pass over the rows, one folder per status; keys that are stored already are left out, so a rerun adds nothing."""
    spark = derived.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        known = spark.read.schema(derived.schema).parquet(path).select(key)
        derived = derived.join(known, key, "left_anti")
    derived.write.mode("append").partitionBy("status").parquet(path)
