"""Tables laid out by stage, experiment and mixing strategy; reports and histories."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

CELL = ("stage", "exp", "mix")


def write_cells(df: DataFrame, path: str, by: Sequence[str] = CELL, spread: bool = True) -> None:
    """One folder per cell.

    Rows are first spread by cell and key hash through AQE's rebalance, which
    keeps files large and splits a cell that holds most of the rows. Without ``spread`` each
    task writes its rows as they are: for a corpus that is laid out in several cells, one after
    another (``union_cells``), so that no copy of it is shuffled and a task sorts no more than one. Files are packed by zstd.
    """
    df = df.hint("rebalance", *[F.col(c) for c in by]) if spread else df
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)


def union_cells(copies: Sequence[DataFrame]) -> DataFrame:
    """The rows of all cells; a partition holds rows of one of ``copies`` only."""
    return functools.reduce(lambda a, b: a.unionByName(b), copies)


def read_cells(spark: SparkSession, path: str, **cell: str) -> DataFrame:
    """The rows of the wanted cells; other folders are not listed as input."""
    out = spark.read.parquet(path)
    for name, value in cell.items():
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def write_manifest(df: DataFrame, path: str, name: str, by: Sequence[str] = CELL) -> None:
    """The distinct source names of each cell as text lines."""
    names = df.select(*by, F.col(name).cast("string").alias("value")).distinct()
    names.write.mode("overwrite").partitionBy(*by).text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_report(df: DataFrame, path: str, append: bool = False) -> None:
    """A report as CSV with a header."""
    df.write.mode("append" if append else "overwrite").option("header", "true").csv(path)


def read_report(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.option("header", "true").schema(schema).csv(path)


def append_history(df: DataFrame, path: str) -> None:
    """Adds metric rows to a history of JSON lines."""
    df.write.mode("append").json(path)


def read_history(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
