"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step moves edges towards the smallest node around; the steps end when nothing moves, after a number of rounds that
grows with the logarithm of the nodes. Rounds are written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; component is the smallest node reachable, itself included.

    Edges may repeat, run in either direction or be loops; nulls in either end are ignored. No edges: an empty result.
    The minima are written before they are joined back, so that Spark can split a node with very many edges.
    """
    a, b = F.col(left), F.col(right)
    now = materialize(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc-edges")
    while True:
        # Done when no node has two edges down, and none that has one is at the lower end of another.
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        ends = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        if not ends.where("down > 1 OR (down > 0 AND up > 0)").agg(F.count(F.lit(1))).first()[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc-large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = materialize(small.distinct(), "cc-edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
