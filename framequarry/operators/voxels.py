"""Weighted voxel aggregates that samples can be taken out of again, and range queries on chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fuse(samples: DataFrame, keys: list[str], value: Column, weight: Column, sign: Column | None = None, most: float | None = None) -> DataFrame:
    """Keys, mean (weighted by ``weight``), weight and number of samples of each voxel.

    With ``sign`` (+1 or -1) samples are added or retracted; a voxel whose weight
    falls to 0.001 or less is empty: mean null, weight 0.  Sums are combined
    before the shuffle, so a voxel that many samples hit is no hot key.
    """
    sign = F.lit(1) if sign is None else sign
    sums = samples.groupBy(*keys).agg(F.sum(sign * value * weight).alias("_vw"), F.sum(sign * weight).alias("_w"), F.sum(sign).alias("samples"))
    kept = F.col("_w") > 0.001
    held = F.col("_w") if most is None else F.least(F.col("_w"), F.lit(most))
    return sums.select(*keys, F.when(kept, F.col("_vw") / F.col("_w")).alias("mean"), F.when(kept, held).otherwise(0.0).alias("weight"), "samples")


def merge(left: DataFrame, right: DataFrame, keys: list[str], most: float | None = None) -> DataFrame:
    """Two fused tables as one."""
    both = left.unionByName(right)
    merged = fuse(both, keys, F.coalesce("mean", F.lit(0.0)), F.col("weight"), most=most).drop("samples")
    return merged.join(both.groupBy(*keys).agg(F.sum("samples").alias("samples")), keys)


def blend_colours(samples: DataFrame, keys: list[str], order: str, colour: str) -> DataFrame:
    """The first colour, then 0.8 old + 0.2 new rounded, in order of ``order``: an ordered fold per voxel."""
    collected = samples.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(colour).cast("double").alias("c")))).alias("s"))
    fold = F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.col("s")[0]["c"], lambda acc, x: F.round(acc * 0.8 + x["c"] * 0.2))
    return collected.select(*keys, fold.alias("colour"))


def starve(voxels: DataFrame, weight: str = "weight") -> DataFrame:
    """One observation less for every voxel, not below 0."""
    return voxels.withColumn(weight, F.greatest(F.lit(0.0), F.floor(weight) - 1))


def live_blocks(voxels: DataFrame, block: list[str], weight: str = "weight") -> DataFrame:
    """Blocks with any voxel of weight 1 or more; the others are garbage."""
    return voxels.groupBy(*block).agg(F.max(F.floor(weight)).alias("most")).filter("most > 0")


def collect_garbage(voxels: DataFrame, block: list[str], weight: str = "weight") -> DataFrame:
    return voxels.join(live_blocks(voxels, block, weight).select(*block), block, "left_semi")


def look_up(points: DataFrame, voxels: DataFrame, keys: list[str]) -> DataFrame:
    """Points with their voxel; a miss is the empty voxel."""
    return points.join(voxels, keys, "left").fillna({"weight": 0.0})


def within_box(rows: DataFrame, limits: dict[str, tuple]) -> DataFrame:
    """Rows whose columns lie within closed limits."""
    keep = F.lit(True)
    for name, (low, high) in limits.items():
        keep = keep & F.col(name).between(low, high)
    return rows.filter(keep)


def chunks_in_sphere(chunks: DataFrame, centre: tuple[float, float, float], radius: float, extent: float) -> DataFrame:
    """Chunks (x, y, z) whose eight corners all lie in a sphere: a box on the coordinates, then the exact test."""
    box, exact = F.lit(True), F.lit(0.0)
    for name, c in zip("xyz", centre):
        box = box & F.col(name).between(int((c - radius) // extent), int((c + radius) // extent) + 1)
        far = F.abs(F.col(name) * extent - c) + extent / 2
        exact = exact + far * far
    return chunks.filter(box & (exact <= radius * radius))


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Points joined with the ranges [low, high] that hold their value, through equi-joined bins of ``width``.

    A range lies in as many bins as it spans; each point in one, so no pair is
    reported twice and no side is compared with all of the other.
    """
    bins = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("_bin", F.floor(F.col(value) / width)).join(bins, "_bin").filter(F.col(value).between(F.col(low), F.col(high))).drop("_bin")


def occupancy_histogram(rows: DataFrame, bucket: Column) -> DataFrame:
    """How many buckets hold n rows, for every n."""
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("held")).groupBy("held").agg(F.count("*").alias("buckets"))
