"""Connected components of a graph given as a table of links; links, nodes and components stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagweave.llm.common import written


def stars(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of every node but the roots.

    ``links`` has bigint columns ``a`` and ``b``. Large and small stars by turns: each round hangs every neighbour of
    a node on the smallest one, by a grouped minimum and a join, and is written out, so a lost executor costs one
    round at most. Rounds grow with the logarithm of the longest chain. A node with many links is no hot group: the
    minimum is combined before the shuffle, and the join is one whose large keys Spark splits.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .distinct(), "links")
    seen = _sum(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written out, the minima meet the links in a join that Spark deals anew on both sides, so it can split it.
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = (both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        large = written(large, "links")
        lowest = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _sum(edges)
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def _sum(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
