"""Connected components of an edge table, by alternating star contraction.

Each round is two aggregates by node with map-side minima; the edge table shrinks towards stars.
A hub's edges meet its row of the aggregate in several tasks. Rounds are cut by tables in the shared
folder; the driver sees only counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lookup, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's least neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return lookup(both.where("b > a"), least, ["a"], "n", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them; ``a > b`` in every edge."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = lookup(edges, least, ["a"], "n", "b").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (longs ``a``, ``b``); the root is the least node.

    Loops and repeated edges are allowed; without edges the result is empty.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = written(edges, "edges")
    for _ in range(most_rounds):
        after = written(_small_star(_large_star(edges)), "edges")
        # Stars: each node has one edge, and no centre is itself linked on.
        flags = after.groupBy("a").agg(F.count("*").alias("n"))
        if flags.where("n > 1").isEmpty() and after.join(after.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            discard(edges)
            edges = after
            break
        discard(edges)
        edges = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
