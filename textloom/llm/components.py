"""Connected components of links by alternating large and small stars, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's greater (large) or smaller (small) neighbours to the least node it knows, itself included."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    near = both.join(least, "u")
    if large:
        out = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``links`` that has a link to another; component: the least node reached.

    Each round halves the depth of the trees, so rounds grow with the logarithm of the longest chain. No round
    gathers a component: stars are formed by a partial minimum and a join that Spark can split.
    """
    edges = materialise(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct(), "links")
    while not edges.isEmpty():
        edges = materialise(_star(_star(edges, True), False).distinct(), "stars")
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        # Done when each node has one link up and none that is linked up is linked to: all trees are flat.
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
