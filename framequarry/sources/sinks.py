"""Sinks: pose files, run summaries, timing tables, meshes."""

from __future__ import annotations

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from framequarry.functions.camera import quaternion


def pose_lines(poses: DataFrame) -> DataFrame:
    """(idx, pose) -> value: ``idx tx ty tz qx qy qz qw`` of every valid pose."""
    valid = poses.filter(F.col("pose").isNotNull() & F.forall("pose", lambda x: F.abs(x) < float("inf"))).withColumn("q", quaternion(F.col("pose")))
    return valid.select(F.concat_ws(" ", F.col("idx").cast("string"), *[F.col("pose")[i].cast("string") for i in (3, 7, 11)], *[F.col(f"q.{c}").cast("string") for c in ("qx", "qy", "qz", "qw")]).alias("value"))


def write_poses(poses: DataFrame, path: str) -> None:
    """Text files in order of idx; valid poses only."""
    pose_lines(poses.orderBy("idx")).write.text(path)


def run_summary(frames: DataFrame, free_blocks: int, least_free: int = 800, share: float = 0.5) -> DataFrame:
    """One row: frames, valid frames, and whether the run counts."""
    good = F.count_if("valid")
    return frames.agg(F.count("*").alias("frames"), good.alias("valid_frames"), (F.lit(free_blocks >= least_free) & (good >= F.round(share * F.count("*")))).alias("valid"))


def timing_table(timings: DataFrame, frames: list[int]) -> DataFrame:
    """stage by frame: one row a stage, one column for each wanted frame."""
    return timings.groupBy("stage").pivot("frame", frames).agg(F.first("ms", ignorenulls=True))


def timing_means(timings: DataFrame) -> DataFrame:
    return timings.groupBy("stage").agg(F.avg("ms").alias("ms"), F.count("*").alias("frames"))


class PlyWriter(ds.DataSourceWriter):
    """Each task writes one complete PLY file of its triangles; a failed job leaves none."""

    def __init__(self, path: str):
        self.path = path

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator):
        from pyspark import TaskContext

        where, folder = self._place()
        where.create_dir(folder, recursive=True)
        rows = np.array([[r["v0"], r["v1"], r["v2"]] for r in iterator], float).reshape(-1, 3)
        corners, index = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, int))
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.ply"
        head = f"ply\nformat ascii 1.0\nelement vertex {len(corners)}\nproperty double x\nproperty double y\nproperty double z\nelement face {len(rows) // 3}\nproperty list uchar int vertex_indices\nend_header\n"
        body = "".join(f"{x!r} {y!r} {z!r}\n" for x, y, z in corners.tolist()) + "".join(f"3 {a} {b} {c}\n" for a, b, c in index.reshape(-1, 3).tolist())
        with where.open_output_stream(name) as out:
            out.write((head + body).encode())
        return _Written(name)

    def commit(self, messages):
        pass

    def abort(self, messages):
        where, _ = self._place()
        for m in messages:
            if m is not None:
                where.delete_file(m.name)


class _Written(ds.WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class PlySink(ds.DataSource):
    """``df.write.format("ply").mode("append").save(path)`` for triangles (v0, v1, v2)."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return "v0 array<double>, v1 array<double>, v2 array<double>"

    def writer(self, schema, overwrite) -> PlyWriter:
        return PlyWriter(self.options["path"])


def write_mesh(triangles: DataFrame, path: str) -> None:
    triangles.sparkSession.dataSource.register(PlySink)
    triangles.select("v0", "v1", "v2").write.format("ply").mode("append").save(path)
