"""Pose tables: versions, change logs, work lists, composition, pose files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.functions.camera import invert_rigid, multiply


def latest(versions: DataFrame, key: list[str], version: str) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in versions.columns if c not in key]
    return versions.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*key, *[F.col("r")[c].alias(c) for c in rest])


def changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Change log between two versions: key, op (add, remove, move), old and new value; null values count as absent."""
    a = old.filter(F.col(value).isNotNull()).select(F.col(key), F.col(value).alias("old_value"))
    b = new.filter(F.col(value).isNotNull()).select(F.col(key), F.col(value).alias("new_value"))
    op = F.when(F.col("old_value").isNull(), "add").when(F.col("new_value").isNull(), "remove").when(F.col("old_value") != F.col("new_value"), "move")
    return a.join(b, key, "full_outer").withColumn("op", op).filter("op is not null").select(key, "op", "old_value", "new_value")


def signed(log: DataFrame, key: str) -> DataFrame:
    """A change log as retractions (-1) and insertions (+1)."""
    out = log.filter(F.col("old_value").isNotNull()).select(key, F.lit(-1).alias("sign"), F.col("old_value").alias("value"))
    return out.unionByName(log.filter(F.col("new_value").isNotNull()).select(key, F.lit(1).alias("sign"), F.col("new_value").alias("value")))


def work_list(rows: DataFrame, first: str, distance: str, tie: str, least: float, most: int) -> DataFrame:
    """Up to ``most`` rows farther than ``least``: those of ``first`` before others, then by distance."""
    return rows.filter(F.col(distance) > least).orderBy(F.desc(first), F.desc(distance), tie).limit(most)


def corrections(log: DataFrame, key: str, most: int = 10) -> DataFrame:
    """The next changes to apply: removals, additions, moves, each in order of key."""
    priority = F.when(F.col("op") == "remove", 0).when(F.col("op") == "add", 1).otherwise(2)
    return log.withColumn("priority", priority).orderBy("priority", key).limit(most)


def complete(chunks: DataFrame, local: DataFrame, n: int) -> DataFrame:
    """(chunk, pose) and (idx, local_pose, valid) -> pose of every frame; null where either is missing or invalid."""
    keyed = local.withColumn("chunk", F.floor(F.col("idx") / n).cast("long"))
    return keyed.join(chunks, "chunk", "left").select("idx", F.when(F.col("valid"), multiply(F.col("pose"), F.col("local_pose"))).alias("pose"))


def rebase(old: DataFrame, new_chunks: DataFrame, old_chunks: DataFrame, n: int) -> DataFrame:
    """Poses (idx, pose) moved with their chunk: new chunk pose x inverse of the old one x old pose."""
    keyed = old.withColumn("chunk", F.floor(F.col("idx") / n).cast("long"))
    both = keyed.join(new_chunks.select("chunk", F.col("pose").alias("new")), "chunk").join(old_chunks.select("chunk", F.col("pose").alias("was")), "chunk")
    return both.select("idx", multiply(multiply(F.col("new"), invert_rigid(F.col("was"))), F.col("pose")).alias("pose"))


def trajectory_error(left: DataFrame, right: DataFrame) -> DataFrame:
    """Root mean square distance of the positions of two trajectories (idx, x, y, z), over common frames."""
    both = left.join(right.select("idx", *[F.col(c).alias(c + "_r") for c in "xyz"]), "idx")
    square = sum(((F.col(c) - F.col(c + "_r")) ** 2 for c in "xyz"), F.lit(0.0))
    return both.agg(F.sqrt(F.avg(square)).alias("rmse"), F.count("*").alias("frames"))
