"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthomill.llm.tables import dropped, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"))
    return edges.join(least, "a").select(F.col("root").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie the smaller neighbours of a node, and the node, to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("root"))
    return edges.join(least, "b").select(F.col("root").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges (a < b) are stars around their smallest node: each ``b`` has one edge and is no ``a``."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("below")).unionByName(edges.select(F.col("b").alias("node"), F.lit(1).alias("below")))
    return (ends.groupBy("node").agg(F.sum("below").alias("edges"), F.min("below").alias("least"))
            .filter("edges > 1 or edges = 1 and least = 0").isEmpty())


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of an edge; ``root`` is the smallest node of its component.

    ``edges`` holds long columns ``a`` and ``b``; loops, repeated and null edges are
    ignored. A round needs two joins; the number of rounds grows with the logarithm
    of the components' size, and edges that are stars already need none. A round's table goes when the next one is written.
    Minima combine before the shuffle and the joins
    can be split, so a hub with a third of all edges spreads over many tasks. Raises if
    ``max_rounds`` is reached before the edges settle.
    """
    current = stored(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter("a < b").distinct(), "cc-edges")
    for _ in range(max_rounds):
        if _settled(current):
            roots = current.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        large = stored(_large_star(current), "cc-large")
        dropped(current)
        current = stored(_small_star(large), "cc-round")
        dropped(large)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
