"""Connected components of an edge list by alternating large and small stars (Kiveris et al. 2014).

Each round joins and groups the edges once or twice and halves long paths, so rows of points that chain up
need a logarithmic number of rounds. Nothing is collected; every round is cut off from the last by
``checkpoint`` (a reliable one, in the shared folder).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the least of them and the node (``a`` is the node)."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        linked = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return linked.where(F.col("a") != F.col("b")).distinct()


def _is_forest_of_stars(links: DataFrame) -> bool:
    """Whether every node either has one smaller neighbour or only larger ones: nothing is left to do."""
    ends = links.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(links.select(F.col("b").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    odd = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)")
    return not odd.limit(1).count()


def least_reached(edges: DataFrame, checkpoint: Callable[[DataFrame], DataFrame], src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` of all nodes of ``edges`` but the smallest of each component, which is ``component``."""
    links = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where(F.col("a") != F.col("b")).distinct()
    links = checkpoint(links)
    while not _is_forest_of_stars(links):
        links = checkpoint(_star(_star(links, large=True), large=False))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))


def connected_components(edges: DataFrame, checkpoint: Callable[[DataFrame], DataFrame], src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` of all nodes of ``edges``; ``component`` is the smallest node reachable."""
    nodes = edges.select(F.explode(F.array(src, dst)).alias("node")).distinct()
    return nodes.join(least_reached(edges, checkpoint, src, dst), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
