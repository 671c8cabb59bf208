"""Connected components by alternating large and small stars over edge tables; nothing reaches the driver but two sums a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def connected(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) with the smallest node reachable by edges (a, b), for every node of an edge.

    Each round hangs neighbours on the smallest neighbour of their node, first the larger ones, then the smaller ones; the
    rounds grow with the logarithm of the nodes. Nodes with very many neighbours are pre-aggregated before the shuffle
    and their join can be split. Every round is a written table. Self-loops and nulls are dropped, edges may repeat.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, last = materialize(large, label), now
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label)
        drop(now.sparkSession, large, last)
