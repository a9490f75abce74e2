"""The match graph: components, tracks, tombstones and validity of frames."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> None:
    """Where no checkpoint folder is set, that of ``spark.checkpoint.dir``; a local master may do with a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="framequarry-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's smallest one."""
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the smallest of these."""
    down = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) -> (node, root): the smallest node that each node of an edge reaches; ends in a number of rounds that grows with the logarithm of the longest path.

    Alternates large and small stars until every node hangs on its root.  A round
    takes minima by key, combined before the shuffle, and one join on the node.
    Rounds are checkpointed: set ``spark.checkpoint.dir`` to a folder that executors
    share.  Edges with a null end are left out.
    """
    checkpoint_folder(edges.sparkSession)
    edges = edges.select("u", "v").filter("u is not null and v is not null").distinct().checkpoint()  # read three times
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    pairs = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    while True:
        tall = pairs.join(pairs.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()
        if not tall and not pairs.groupBy("u").count().filter("count > 1").limit(1).count():
            return nodes.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("r")), "node", "left").select("node", F.coalesce("r", "node").alias("root"))
        pairs = _small_star(_large_star(pairs)).checkpoint()


def drop_pairs(links: DataFrame, bad: DataFrame, on: list[str]) -> DataFrame:
    """Links without those of the bad pairs."""
    return links.join(bad.select(*on), on, "left_anti")


def isolated(nodes: DataFrame, links: DataFrame, node: str, *ends: str) -> DataFrame:
    """Nodes that no link has at any of its ends."""
    for end in ends:
        nodes = nodes.join(links.select(F.col(end).alias(node)), node, "left_anti")
    return nodes


def linked_frames(frames: DataFrame, links: DataFrame) -> DataFrame:
    """(idx) and (i, j) with i < j -> idx, previous: the newest earlier frame that a frame is linked to, null if none."""
    newest = links.groupBy(F.col("j").alias("idx")).agg(F.max("i").alias("previous"))
    return frames.join(newest, "idx", "left")


def worst(links: DataFrame, group: list[str], residual: str, key: list[str]) -> DataFrame:
    """The largest residual of each group and its link; ties go to the smallest key."""
    first = F.min(F.struct((-F.col(residual)).alias("r"), *key))
    return links.groupBy(*group).agg(first.alias("x")).select(*group, (-F.col("x.r")).alias(residual), *[F.col("x")[c].alias(c) for c in key])


def tracks(links: DataFrame, points: DataFrame) -> DataFrame:
    """Mean position and size of each track: the components of keypoint links, over points (node, x, y, z)."""
    found = components(links)
    return found.join(points, "node").groupBy("root").agg(*[F.avg(c).alias(c) for c in "xyz"], F.count("*").alias("members"))
