"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; root is the component's smallest node.

    ``edges`` has two long columns, a and b; direction, repeats and loops don't matter
    (a node with loops only has no row).  Each round replaces edges by links to smaller
    nodes of the same component, in two grouped minima with map-side combine and two
    joins on narrow rows; rounds grow with the logarithm of the longest chain.  The
    edges stay in Spark throughout, each round ends in a checkpoint.
    """
    e = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while not _only_stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        low = large.join(least, "u")
        small = low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = cut(small.distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _only_stars(e: DataFrame) -> bool:
    """No node has two smaller neighbours or both a smaller and a larger one."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("v", F.lit(0), F.lit(1)))
    per_node = ends.groupBy("n").agg(F.sum("down").alias("d"), F.max("up").alias("p"))
    return per_node.where("d > 1 or (d = 1 and p = 1)").limit(1).count() == 0
