"""Streams of frames: closing overlapping chunks, fusing voxels with retraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framequarry.operators.voxels import fuse


def closed_chunks(stream: DataFrame, n: int) -> DataFrame:
    """(session, idx, value) in any order -> session, chunk, first, last, total of every chunk of n + 1 frames once it is whole.

    Frames that come early wait in the state; the frame that closes a chunk also
    opens the next.  A frame that comes twice counts once; one that belongs to a
    chunk already closed is dropped.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunk, idx, values = state.get if state.exists else (0, [], [])
        have = dict(zip(idx, values))
        for part in parts:
            for i, v in zip(part.idx, part.value):
                if i >= chunk * n:
                    have.setdefault(int(i), float(v))
        out = []
        while all(i in have for i in range(chunk * n, chunk * n + n + 1)):
            rows = [have[i] for i in range(chunk * n, chunk * n + n + 1)]
            out.append((key[0], chunk, rows[0], rows[-1], sum(rows)))
            for i in range(chunk * n, chunk * n + n):
                del have[i]
            chunk += 1
        state.update((chunk, list(have), list(have.values())))
        yield pd.DataFrame(out, columns=["session", "chunk", "first", "last", "total"])

    return stream.groupBy("session").applyInPandasWithState(step, "session string, chunk long, first double, last double, total double", "chunk long, idx array<long>, waiting array<double>", "append", GroupStateTimeout.NoTimeout)


class VoxelTable:
    """Signed sample sums kept as one Parquet folder a batch, merged on reading.

    A batch that runs again overwrites its own folder, so results are exactly once.
    """

    def __init__(self, path: str, keys: list[str]):
        self.path, self.keys = path.rstrip("/"), keys

    def add(self, batch: DataFrame, epoch: int) -> None:
        """A micro-batch of (keys, value, weight, sign)."""
        sums = batch.groupBy(*self.keys).agg(F.sum(F.col("sign") * F.col("value") * F.col("weight")).alias("vw"), F.sum(F.col("sign") * F.col("weight")).alias("w"), F.sum("sign").alias("n"))
        sums.write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self, spark) -> DataFrame:
        """keys, mean, weight, samples after all batches."""
        rows = spark.read.parquet(self.path).groupBy(*self.keys).agg(F.sum("vw").alias("vw"), F.sum("w").alias("w"), F.sum("n").alias("samples"))
        kept = F.col("w") > 0.001
        return rows.select(*self.keys, F.when(kept, F.col("vw") / F.col("w")).alias("mean"), F.when(kept, F.col("w")).otherwise(0.0).alias("weight"), "samples")


def fuse_batch(samples: DataFrame, keys: list[str]) -> DataFrame:
    """The same result from a bounded table."""
    return fuse(samples, keys, F.col("value"), F.col("weight"), F.col("sign"))


def retry(failed: DataFrame, attempts: DataFrame, most: int) -> DataFrame:
    """Failed keys with fewer than ``most`` attempts, newest first, with the number of the next attempt."""
    counted = attempts.groupBy("key").agg(F.count("*").alias("done"))
    return failed.join(counted, "key", "left").withColumn("attempt", F.coalesce("done", F.lit(0)) + 1).filter(F.col("attempt") <= most).drop("done").orderBy(F.desc("key"))
