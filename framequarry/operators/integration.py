"""Depth frames into a voxel grid, and samples of the grid between voxels."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.functions import voxel
from framequarry.functions.camera import Camera, invert_rigid, transform_point

from .voxels import fuse

BLOCK_KEYS = ["bx", "by", "bz"]
VOXEL_KEYS = [*BLOCK_KEYS, "li"]


def segment_blocks(start: list[Column], end: list[Column]) -> Column:
    """The blocks that a segment passes, in order: array of (bx, by, bz); ends in units of blocks.

    Between two neighbouring crossings of a block border the segment is in one
    block, which its middle names.
    """

    def crossings(a: Column, b: Column) -> Column:
        low, high = F.floor(F.least(a, b)), F.floor(F.greatest(a, b))
        borders = F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(borders, lambda k: (k - a) / (b - a))

    steps = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), *[crossings(a, b) for a, b in zip(start, end)], F.array(F.lit(1.0)))))
    middles = F.zip_with(F.slice(steps, 1, F.size(steps) - 1), F.slice(steps, 2, F.size(steps) - 1), lambda s, t: (s + t) / 2)
    at = lambda t: F.struct(*[F.floor(a + (b - a) * t).cast("int").alias(k) for a, b, k in zip(start, end, BLOCK_KEYS)])
    return F.array_distinct(F.transform(middles, at))


def _rays(pixels: DataFrame, poses: DataFrame, camera: Camera, far: float, base: float, per_metre: float) -> DataFrame:
    """Pixels with their pose and the depths ``near``, ``far`` where their band around the surface begins and ends."""
    band = voxel.truncation(F.col("depth"), base, per_metre)
    seen = pixels.filter((F.col("depth") > 0) & (F.col("depth") < far)).join(poses, "frame")
    return seen.withColumns({"near": F.greatest(F.col("depth") - band, F.lit(0.0)), "far": F.col("depth") + band})


def allocated_blocks(pixels: DataFrame, poses: DataFrame, camera: Camera, size: float, far: float = 4.0, base: float = 0.06, per_metre: float = 0.02) -> DataFrame:
    """bx, by, bz: the blocks that some pixel's viewing ray passes within its truncation band."""

    def end(depth: str) -> list[Column]:
        p = camera.back_project(F.col("u"), F.col("v"), F.col(depth))
        world = transform_point(F.col("transform"), p["x"], p["y"], p["z"])
        return [(world[c] / size + 0.5) / voxel.BLOCK for c in "xyz"]

    rays = _rays(pixels, poses, camera, far, base, per_metre)
    return rays.select(F.explode(segment_blocks(end("near"), end("far"))).alias("b")).select("b.*").distinct()


def depth_samples(pixels: DataFrame, poses: DataFrame, camera: Camera, size: float, far: float = 4.0, base: float = 0.06, per_metre: float = 0.02) -> DataFrame:
    """(frame, u, v, depth, ...) and (frame, transform of the camera into the world) -> bx, by, bz, li, frame, sdf and the pixels' other columns.

    Every voxel whose projection into a frame hits a pixel nearer than ``far``, and
    that lies within the truncation band of its depth.  A frame's candidates are
    the blocks in the boxes around its pixels' bands; the box of a pixel is widened
    by half a pixel, so no voxel that rounds to the pixel is missed.  Pixels without
    depth give nothing.
    """
    rays = _rays(pixels.select("frame", "u", "v", "depth"), poses.select("frame", "transform"), camera, far, base, per_metre)
    corners = []
    for du, dv, depth in product((-0.5, 0.5), (-0.5, 0.5), ("near", "far")):
        p = camera.back_project(F.col("u") + du, F.col("v") + dv, F.col(depth))
        corners.append(transform_point(F.col("transform"), p["x"], p["y"], p["z"]))
    index = lambda c: F.floor((c / size + 0.5) / voxel.BLOCK)
    boxes = rays.select("frame", *[F.sequence(index(F.array_min(F.array(*[p[c] for p in corners]))), index(F.array_max(F.array(*[p[c] for p in corners])))).alias(k) for c, k in zip("xyz", BLOCK_KEYS)])
    for k in BLOCK_KEYS:
        boxes = boxes.withColumn(k, F.explode(k))
    blocks = boxes.select("frame", *[F.col(k).cast("int").alias(k) for k in BLOCK_KEYS]).distinct()
    cells = blocks.withColumn("li", F.explode(F.sequence(F.lit(0), F.lit(voxel.BLOCK**3 - 1)))).join(poses.select("frame", invert_rigid(F.col("transform")).alias("inverse")), "frame")
    world = [voxel.voxel_to_world(voxel.block_to_voxel(F.col(k)) + at, size) for k, at in zip(BLOCK_KEYS, voxel.local_position(F.col("li")))]
    placed = cells.withColumn("p", transform_point(F.col("inverse"), *world))
    u, v = camera.pixel(F.col("p.x"), F.col("p.y"), F.col("p.z"))
    shown = placed.select("frame", *VOXEL_KEYS, u.alias("u"), v.alias("v"), F.col("p.z").alias("pz")).filter(camera.inside(F.col("u"), F.col("v")))
    hit = shown.join(pixels.filter((F.col("depth") > 0) & (F.col("depth") < far)), ["frame", "u", "v"])
    sdf = F.col("depth") - F.col("pz")
    return hit.withColumn("sdf", sdf).filter(F.abs("sdf") < voxel.truncation(F.col("depth"), base, per_metre)).drop("u", "v", "depth", "pz")


def integrate(samples: DataFrame, sign: Column | None = None, most: float = 255.0) -> DataFrame:
    """bx, by, bz, li, sdf (mean), weight, samples; ``sign`` -1 takes samples out again, and voxels without any left go."""
    return fuse(samples, VOXEL_KEYS, F.col("sdf"), F.lit(1.0), sign, most).filter("weight > 0").withColumnRenamed("mean", "sdf")


def integrate_coloured(samples: DataFrame, sign: Column | None = None, most: float = 255.0, order: str = "frame", colours: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """:func:`integrate` with a colour for each voxel: the first sample's, then 0.8 old + 0.2 new, rounded and kept within 0 and 254, in order of ``order``.

    A sample that is taken out again leaves the fold, so the colour is that of the
    samples that are left (of equal ``order`` the first by colour); a null colour does
    not count, and a voxel without any has null colours.  A voxel's colours are one
    list of at most as many entries as there are frames.
    """
    sign = F.lit(1) if sign is None else sign
    left = samples.dropna(subset=list(colours)).groupBy(*VOXEL_KEYS, order, *colours).agg(F.sum(sign).alias("_n")).filter("_n > 0")
    ordered = left.groupBy(*VOXEL_KEYS).agg(F.sort_array(F.collect_list(F.struct(order, *[F.col(c).cast("double").alias(c) for c in colours]))).alias("_s"))
    within = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(254.0), F.round(x)))

    def fold(c: str) -> Column:
        rest = F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0)))
        return F.aggregate(rest, within(F.col("_s")[0][c]), lambda old, x: within(old * 0.8 + x[c] * 0.2)).cast("int").alias(c)

    return integrate(samples, sign, most).join(ordered.select(*VOXEL_KEYS, *map(fold, colours)), VOXEL_KEYS, "left")


def trilinear(points: DataFrame, voxels: DataFrame, size: float, key: str = "id") -> DataFrame:
    """(key, x, y, z) over voxels (vx, vy, vz, sdf, weight) -> key, sdf at the point from the eight voxels around it.

    A point with a voxel missing or of weight 0 among the eight has no row.
    """
    scaled = [F.col(c) / size for c in "xyz"]
    corners = F.explode(F.array(*[F.struct(*[F.lit(o).alias(n) for o, n in zip(at, ("ox", "oy", "oz"))]) for at in product((0, 1), repeat=3)]))
    spread = points.select(key, *[F.floor(s).alias(f"v{c}") for s, c in zip(scaled, "xyz")], *[(s - F.floor(s)).alias(f"f{c}") for s, c in zip(scaled, "xyz")], corners.alias("o"))
    share = F.lit(1.0)
    for c in "xyz":
        share = share * F.when(F.col(f"o.o{c}") == 1, F.col(f"f{c}")).otherwise(1 - F.col(f"f{c}"))
    asked = spread.select(key, *[(F.col(f"v{c}") + F.col(f"o.o{c}")).alias(f"v{c}") for c in "xyz"], share.alias("share"))
    met = asked.join(voxels.filter("weight > 0").select("vx", "vy", "vz", "sdf"), ["vx", "vy", "vz"])
    return met.groupBy(key).agg(F.sum(F.col("share") * F.col("sdf")).alias("sdf"), F.count("*").alias("n")).filter("n = 8").drop("n")


def gradients(points: DataFrame, voxels: DataFrame, size: float, key: str = "id") -> DataFrame:
    """key, nx, ny, nz: unit direction in which the distance grows, from samples half a voxel to both sides; zeros where it is flat.

    A point with any of the six samples missing has no row.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(s).alias("side")) for a in range(3) for s in (-1, 1)]))
    moved = points.select(key, "x", "y", "z", sides.alias("o")).select(
        F.struct(key, "o.axis", "o.side").alias("at"), *[(F.col(c) + F.when(F.col("o.axis") == i, F.col("o.side") * (size / 2)).otherwise(0.0)).alias(c) for i, c in enumerate("xyz")]
    )
    found = trilinear(moved, voxels, size, "at").select("at.*", "sdf")
    slopes = found.groupBy(key).agg(*[F.sum(F.when(F.col("axis") == i, F.col("side") * F.col("sdf")).otherwise(0.0)).alias(f"n{c}") for i, c in enumerate("xyz")], F.count("*").alias("n")).filter("n = 6")
    length = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    return slopes.withColumn("l", length).select(key, *[F.when(F.col("l") > 0, F.col(f"n{c}") / F.col("l")).otherwise(0.0).alias(f"n{c}") for c in "xyz"])


def ray_crossings(rays: DataFrame, voxels: DataFrame, size: float, key: str = "id", steps: int = 3) -> DataFrame:
    """Rays (key, ox, oy, oz, dx, dy, dz, t0, s0, t1, s1 with distances s0, s1 of opposite sign) -> key, t where the distance is zero.

    Each step is a secant through both ends and a sample there that replaces the
    end of its sign; a ray that leaves the known voxels has no row.
    """
    now, secant = rays, F.col("t0") + F.col("s0") / (F.col("s0") - F.col("s1")) * (F.col("t1") - F.col("t0"))
    for _ in range(steps):
        now = now.withColumn("t", secant)
        at = trilinear(now.select(key, *[(F.col(f"o{c}") + F.col("t") * F.col(f"d{c}")).alias(c) for c in "xyz"]), voxels, size, key)
        now = now.join(at, key)
        same = F.col("s0") * F.col("sdf") > 0
        ends = {"t0": F.when(same, F.col("t")).otherwise(F.col("t0")), "s0": F.when(same, F.col("sdf")).otherwise(F.col("s0")), "t1": F.when(same, F.col("t1")).otherwise(F.col("t")), "s1": F.when(same, F.col("s1")).otherwise(F.col("sdf"))}
        now = now.withColumns(ends).drop("sdf")
    return now.select(key, "t")


def move_out(blocks: DataFrame, centre: tuple[float, float, float], radius: float, extent: float) -> tuple[DataFrame, DataFrame]:
    """(near, far): blocks by whether their centre is less than ``radius`` away; the far ones go to the cold table."""
    square = sum(((F.col(k) * extent + extent / 2 - c) ** 2 for k, c in zip(BLOCK_KEYS, centre)), F.lit(0.0))
    near = square < radius * radius
    return blocks.filter(near), blocks.filter(~near)


def move_in(hot: DataFrame, cold: DataFrame, centre: tuple[float, float, float], radius: float, extent: float) -> tuple[DataFrame, DataFrame]:
    """(hot, cold) after the cold blocks within ``radius`` came back."""
    near, far = move_out(cold, centre, radius, extent)
    return hot.unionByName(near), far


def held_twice(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Blocks that are in both tables or repeat in one: none, if moves lost nothing."""
    both = hot.select(*BLOCK_KEYS).unionAll(cold.select(*BLOCK_KEYS))
    return both.groupBy(*BLOCK_KEYS).count().filter("count > 1").drop("count")
