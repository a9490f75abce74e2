"""Chunks become key frames: keypoints fused over their tracks, poses handed on, states of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.functions.camera import Camera, multiply, transform_point

from .graph import components


def fuse_chunks(keypoints: DataFrame, links: DataFrame, poses: DataFrame, camera: Camera) -> DataFrame:
    """chunk, key, u, v, x, y, z, scale, descriptor, members: one keypoint for each track of a chunk.

    ``keypoints``: chunk, frame, key, x, y, z, scale, descriptor; ``links``: frame i, key_i,
    frame j, key_j of one chunk; ``poses``: frame, transform into the chunk.  A track is a
    component of linked keypoints.  Its place is the mean of its members' places in the
    chunk, its pixel that place seen by the chunk's first frame, scale and descriptor
    those of its first member (by frame and key), whose key names it within the chunk
    with its frame.  Tracks seen outside the image or behind the camera are left out, and so are frames
    without a pose.
    """
    node = lambda f, k: F.struct(F.col(f).cast("long").alias("frame"), F.col(k).cast("long").alias("key"))
    roots = components(links.select(node("i", "key_i").alias("u"), node("j", "key_j").alias("v")))
    placed = keypoints.join(poses.select("frame", "transform"), "frame").withColumn("node", node("frame", "key")).withColumn("p", transform_point(F.col("transform"), F.col("x"), F.col("y"), F.col("z")))
    first = F.struct("frame", "key")
    fused = placed.join(roots, "node").groupBy("chunk", "root").agg(
        *[F.avg(f"p.{c}").alias(c) for c in "xyz"], F.min_by("scale", first).alias("scale"), F.min_by("descriptor", first).alias("descriptor"), F.count("*").alias("members")
    )
    u, v = camera.project(F.col("x"), F.col("y"), F.col("z"))
    seen = fused.withColumns({"u": u, "v": v}).filter(F.col("u").between(0, camera.width - 1) & F.col("v").between(0, camera.height - 1))
    return seen.select("chunk", F.col("root.frame").alias("frame"), F.col("root.key").alias("key"), "u", "v", "x", "y", "z", "scale", "descriptor", "members")


def next_starts(chunks: DataFrame, local: DataFrame, n: int) -> DataFrame:
    """chunk, pose: where the chunk after each one starts: its pose x the local pose of its last valid frame.

    ``chunks``: chunk, pose; ``local``: idx, local_pose, valid.  The frame that closes a chunk
    counts for it.  A chunk without a valid frame hands its own pose on.
    """
    of = F.floor(F.greatest(F.col("idx") - 1, F.lit(0)) / n).cast("long")
    last = local.filter("valid and local_pose is not null").groupBy(of.alias("chunk")).agg(F.max_by("local_pose", "idx").alias("local_pose"))
    both = chunks.join(last, "chunk", "left")
    return both.select((F.col("chunk") + 1).alias("chunk"), F.when(F.col("local_pose").isNull(), F.col("pose")).otherwise(multiply(F.col("pose"), F.col("local_pose"))).alias("pose"))


def confirm(states: DataFrame, done: DataFrame) -> DataFrame:
    """(idx, state) after the frames in ``done`` (idx) were integrated; invalid frames stay invalid."""
    marked = states.join(done.select("idx").distinct().withColumn("done", F.lit(True)), "idx", "left")
    return marked.select("idx", F.when(F.col("done") & (F.col("state") != "invalid"), "integrated").otherwise(F.col("state")).alias("state"))


def invalidate(states: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((idx, state), removals): the frames in ``gone`` (idx) become invalid; those that were integrated have to be taken out again."""
    marked = states.join(gone.select("idx").distinct().withColumn("gone", F.lit(True)), "idx", "left")
    removals = marked.filter("gone and state = 'integrated'").select("idx", F.lit("remove").alias("op"))
    return marked.select("idx", F.when(F.col("gone"), "invalid").otherwise(F.col("state")).alias("state")), removals
