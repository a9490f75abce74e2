"""Sets of pixels: presence in cells and patches, numbering, and the depth interval of blocks at each pixel."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framequarry.functions import voxel
from framequarry.functions.camera import Camera, invert_rigid, transform_point


def presence(pixels: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """keys, level, u, v, n: how many of the pixels (u, v) lie in each cell of 2^level x 2^level, levels 1 to ``levels``."""
    cells = pixels.select(*keys, "u", "v", F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level"))
    size = F.pow(F.lit(2.0), F.col("level"))
    return cells.groupBy(*keys, "level", F.floor(F.col("u") / size).alias("u"), F.floor(F.col("v") / size).alias("v")).agg(F.count("*").alias("n"))


def cell_order(u: Column, v: Column, bits: int = 16) -> Column:
    """A number that orders pixels cell by cell at every level: the bits of v and u in turn."""
    bit = lambda c, b: F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1))
    return sum((F.shiftleft(bit(u, b), 2 * b) + F.shiftleft(bit(v, b), 2 * b + 1) for b in range(bits)), F.lit(0).cast("long"))


def listed(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels with their gapless place (from 0) in the list that walks the cells of all levels; a frame is a bounded group."""
    return pixels.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(cell_order(F.col("u"), F.col("v")))) - 1)


def patches(pixels: DataFrame, keys: list[str], flag: Column, size: int = 2) -> DataFrame:
    """keys, u, v of each patch of ``size`` x ``size`` pixels; ``some`` and ``every``: whether any, and whether all, of its pixels are set (a pixel that repeats is one)."""
    place = F.pmod(F.col("u"), F.lit(size)) * size + F.pmod(F.col("v"), F.lit(size))
    held = pixels.groupBy(*keys, F.floor(F.col("u") / size).alias("u"), F.floor(F.col("v") / size).alias("v")).agg(F.count_distinct(F.when(flag, place)).alias("n"))
    return held.select(*keys, "u", "v", (F.col("n") > 0).alias("some"), (F.col("n") == size * size).alias("every"))


def patch_numbers(found: DataFrame, keys: list[str]) -> DataFrame:
    """Patches that have any pixel set, numbered without gaps from 0, row by row."""
    return found.filter("some").withColumn("number", F.row_number().over(W.partitionBy(*keys).orderBy("v", "u")) - 1)


def ray_intervals(blocks: DataFrame, camera: Camera, size: float) -> DataFrame:
    """(frame, transform, bx, by, bz) -> frame, u, v, near, far: the least and largest depth of the blocks that may cover a pixel.

    A block covers the box of pixels around its eight projected corners; a block
    with a corner behind the camera covers nothing.
    """
    corners = []
    for at in product((0, voxel.BLOCK), repeat=3):
        world = [(F.col(b) * voxel.BLOCK + o - 0.5) * size for b, o in zip(("bx", "by", "bz"), at)]
        corners.append(transform_point(invert_rigid(F.col("transform")), *world))
    placed = blocks.select("frame", F.array(*corners).alias("c")).filter(F.forall("c", lambda p: p["z"] > 0))
    image = [F.transform("c", lambda p: camera.project(p["x"], p["y"], p["z"])[0]), F.transform("c", lambda p: camera.project(p["x"], p["y"], p["z"])[1])]
    depth = F.transform("c", lambda p: p["z"])
    boxes = placed.select("frame", *[e(x).alias(f"{n}{k}") for x, n in zip((*image, depth), "uvz") for e, k in ((F.array_min, 0), (F.array_max, 1))])
    for c, most in (("u", camera.width), ("v", camera.height)):
        low, high = F.greatest(F.floor(F.col(f"{c}0")), F.lit(0)), F.least(F.ceil(F.col(f"{c}1")), F.lit(most - 1))
        boxes = boxes.filter(low <= high).withColumn(c, F.explode(F.sequence(low, high)))
    return boxes.groupBy("frame", "u", "v").agg(F.min("z0").alias("near"), F.max("z1").alias("far"))
