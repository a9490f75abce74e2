"""Connected components of a graph that no single machine has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import cut, split_join


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return split_join(both.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = split_join(down, least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges, self loops allowed -> (node, root): root is the smallest reachable node.

    Alternates large-star and small-star until every node points at a root.
    Each step only takes minima by key (combined before the shuffle) and one
    equi-join on the node, whose hot side Spark can split; a hub with a third of
    all edges does not meet in one task.  Each round is written to the shared
    folder, so the plan does not grow.  Nodes without an edge to another node
    do not appear.
    """
    edges = cut(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        inner = edges.select(F.col("v").alias("u")).distinct()
        tall = edges.join(inner, "u", "left_semi").limit(1).count()
        several = 0 if tall else edges.groupBy("u").count().filter("count > 1").limit(1).count()
        if not tall and not several:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = cut(_small_star(_large_star(edges)), "edges")
