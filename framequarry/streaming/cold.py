"""The cold tier of a voxel grid: far blocks with their voxels in a Parquet store by chunk.

A chunk is a cube of ``per`` blocks a side and a partition of the store.  Blocks move
out by appending to their chunks' partitions; they move in by reading only the
chunks that the sphere touches, after which just these partitions are rewritten.
Rows are voxels: bx, by, bz (block) and any payload columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.operators.graph import checkpoint_folder

BLOCK = ("bx", "by", "bz")
CHUNK = ("cx", "cy", "cz")


class ColdStore:
    """``size``: edge of a block in metres; chunks beyond ``limit`` in any direction do not exist."""

    def __init__(self, spark: SparkSession, path: str, size: float, per: int = 16, limit: int = 1 << 15):
        self.spark, self.path, self.size, self.per, self.limit = spark, path.rstrip("/"), size, per, limit

    def _files(self):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def rows(self, schema=None) -> DataFrame | None:
        """All cold voxels with their chunk; None before the first move."""
        files, where = self._files()
        if not files.exists(where) or not any(f.getPath().getName().startswith("cx=") for f in files.listStatus(where)):
            return None
        reader = self.spark.read.option("basePath", self.path)
        return (reader.schema(schema) if schema is not None else reader).parquet(self.path)

    def chunk(self) -> list[Column]:
        return [F.floor(F.col(b) / self.per).cast("int").alias(c) for b, c in zip(BLOCK, CHUNK)]

    def _near(self, centre: tuple[float, float, float], radius: float) -> Column:
        """Whether a block's centre lies within the sphere."""
        return sum((((F.col(b) + 0.5) * self.size - c) ** 2 for b, c in zip(BLOCK, centre)), F.lit(0.0)) < radius * radius

    def _touched(self, centre: tuple[float, float, float], radius: float) -> Column:
        """Whether a chunk's cube comes nearer than the radius: a filter on partition columns alone."""
        edge = self.size * self.per
        away = [F.greatest(F.lit(0.0), F.col(k) * edge - c, F.lit(c) - (F.col(k) + 1) * edge) for k, c in zip(CHUNK, centre)]
        return sum((a * a for a in away), F.lit(0.0)) < radius * radius

    def move_out(self, hot: DataFrame, centre: tuple[float, float, float], radius: float, step: int = 0, steps: int = 1) -> DataFrame:
        """Stores the far blocks' voxels and returns the rest.

        Only the ``step``-th of ``steps`` shares of the chunks is swept, so the work of a
        sweep can be spread over many frames.  Voxels whose chunk does not exist stay.
        """
        checkpoint_folder(self.spark)
        exists = F.lit(True)
        for b in BLOCK:
            exists = exists & F.floor(F.col(b) / self.per).between(-self.limit, self.limit)
        turn = F.pmod(F.xxhash64(*[F.floor(F.col(b) / self.per) for b in BLOCK]), F.lit(steps)) == step
        leaves = F.coalesce(~self._near(centre, radius) & exists & turn, F.lit(False))
        marked = hot.withColumn("leaves", leaves).checkpoint()
        gone = marked.filter("leaves").drop("leaves").select("*", *self.chunk())
        if gone.limit(1).count():
            gone.repartition(*CHUNK).write.mode("append").partitionBy(*CHUNK).parquet(self.path)
        return marked.filter("not leaves").drop("leaves")

    def move_in(self, centre: tuple[float, float, float], radius: float) -> tuple[DataFrame | None, Callable[[], None]]:
        """(voxels of the cold blocks within the radius, a function that takes them out of the store).

        Call the function once the voxels are kept elsewhere.  If the run ends before
        that, they are in both tiers, which :meth:`check` tells, and none is lost.
        """
        checkpoint_folder(self.spark)
        cold = self.rows()
        if cold is None:
            return None, lambda: None
        touched = cold.filter(self._touched(centre, radius)).withColumn("near", self._near(centre, radius)).checkpoint()
        changed = touched.filter("near").select(*CHUNK).distinct()

        def take_out() -> None:
            stay = touched.filter("not near").drop("near").join(changed, list(CHUNK), "left_semi")
            stay.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*CHUNK).parquet(self.path)
            files, _ = self._files()
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
            for r in changed.join(stay.select(*CHUNK).distinct(), list(CHUNK), "left_anti").toLocalIterator():  # chunks that are empty now
                files.delete(path(f"{self.path}/" + "/".join(f"{c}={r[c]}" for c in CHUNK)), True)

        return touched.filter("near").drop("near", *CHUNK), take_out

    def check(self, hot: DataFrame, voxel: list[str]) -> None:
        """ValueError if a voxel (``voxel``: columns within its block) is in both tiers or twice in one."""
        keys = [*BLOCK, *voxel]
        cold = self.rows()
        both = hot.select(*keys) if cold is None else hot.select(*keys).unionByName(cold.select(*keys))
        twice = both.groupBy(*keys).count().filter("count > 1").limit(3).collect()
        if twice:
            raise ValueError(f"held twice: {[tuple(r)[:-1] for r in twice]}")
