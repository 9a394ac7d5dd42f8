"""Connected components of a link table by stars that grow and shrink; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairlake.session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of (a, b): the least node of its component.

    Each round links the larger neighbours of a node, then the smaller ones, to
    its least neighbour; it ends when nothing changes, after a logarithmic number
    of rounds. Minima are aggregated before they are shuffled, so a node with
    many links is no hot task. Rows with a = b give a node of its own; repeated
    links and an empty table are fine; null ends are left out.
    """
    links = cut(links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("a is not null and b is not null").distinct())
    edges, state = links.where("low < high"), None
    while True:
        both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(
            edges.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high"))
        large = large.where("low < high").distinct()
        down = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(down, "high")
        small = small.select(F.col("m").alias("low"), "high").unionByName(small.select(F.col("m").alias("low"), F.col("low").alias("high")))
        edges = cut(small.where("low < high").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
    nodes = links.select(F.col("low").alias("node")).unionByName(links.select(F.col("high").alias("node"))).distinct()
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
