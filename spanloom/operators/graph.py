"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """From edges (a, b): one row (node, component) per node of an edge, component = smallest node reachable.

    Alternates two star operations until the edges stop changing: every node hands its larger neighbours, then its
    smaller ones, to the smallest node it sees. Each is an aggregate and an equi-join on the node, so a hub's rows can
    be split by adaptive execution; the number of rounds grows with the logarithm of the longest path. ``store``
    materialises a round (a written table or a checkpoint), which cuts the lineage. Null ends and self-loops are ignored.
    """
    wide = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = store(wide.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        now = store(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(
        F.min("component").alias("component")
    )
