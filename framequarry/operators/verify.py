"""Projective joins between frames: dense correspondence and trajectory checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.functions.camera import Camera, invert_rigid, multiply, transform_point


def projective_join(pixels: DataFrame, pairs: DataFrame, camera: Camera, far: float = 0.15, cosine: float = 0.97) -> DataFrame:
    """(i, j, transform of i into j) -> i, j, u, v, u2, v2, distance, good for every pixel of i that lands on a pixel of j.

    ``pixels``: frame, u, v, x, y, z, nx, ny, nz.  An equi-join on the frame and
    the rounded projection.  Landing far in front of the other surface is an
    occluder, kept with ``good`` false; behind it, nothing is seen and the row goes.
    """
    a = pixels.join(pairs, pixels["frame"] == pairs["i"]).withColumn("p", transform_point(F.col("transform"), F.col("x"), F.col("y"), F.col("z")))
    u2, v2 = camera.pixel(F.col("p.x"), F.col("p.y"), F.col("p.z"))
    m = F.col("transform")
    turned = [m[4 * r] * F.col("nx") + m[4 * r + 1] * F.col("ny") + m[4 * r + 2] * F.col("nz") for r in range(3)]
    a = a.select("i", "j", F.col("u"), F.col("v"), u2.alias("u2"), v2.alias("v2"), F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("p.z").alias("pz"), *[t.alias(f"m{c}") for t, c in zip(turned, "xyz")])
    a = a.filter(camera.inside(F.col("u2"), F.col("v2")) & F.col("pz").between(camera.near, camera.far))
    b = pixels.select(F.col("frame").alias("j"), F.col("u").alias("u2"), F.col("v").alias("v2"), *[F.col(c).alias(f"q{c}") for c in ("x", "y", "z", "nx", "ny", "nz")]).filter("qz is not null")
    joined = a.join(b, ["j", "u2", "v2"])
    distance = F.sqrt(sum(((F.col(f"p{c}") - F.col(f"q{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    facing = sum((F.col(f"m{c}") * F.col(f"qn{c}") for c in "xyz"), F.lit(0.0))
    good = (distance < far) & (facing > cosine)
    in_front = F.col("pz") < F.col("qz")
    return joined.select("i", "j", "u", "v", "u2", "v2", distance.alias("distance"), F.coalesce(good, F.lit(False)).alias("good"), in_front.alias("occludes")).filter("good or occludes")


def pair_quality(dense: DataFrame) -> DataFrame:
    """i, j, matches, error (mean distance of the good ones), share (good of all)."""
    good = F.col("good")
    return dense.groupBy("i", "j").agg(F.count_if(good).alias("matches"), F.avg(F.when(good, F.col("distance"))).alias("error"), (F.count_if(good) / F.count("*")).alias("share"))


def verified_pairs(quality: DataFrame, least: float = 0.05, error: float = 0.075) -> DataFrame:
    """Pairs whose share of good pixels and error pass; an error that is not a number fails."""
    return quality.filter((F.col("share") >= least) & (F.col("error") <= error) & ~F.isnan("error"))


def overlapping_pairs(pairs: DataFrame, dense: DataFrame, least: int = 10) -> DataFrame:
    """Pairs with more than ``least`` good pixels."""
    return pairs.join(dense.filter("good").groupBy("i", "j").agg(F.count("*").alias("hits")).filter(F.col("hits") > least), ["i", "j"])


def reference_overlap(pixels: DataFrame, pairs: DataFrame, reference: DataFrame, camera: Camera, share: float = 0.3, far: float = 0.15, cosine: float = 0.97) -> DataFrame:
    """i, j, overlaps: whether frames overlap by their reference poses, as :func:`evaluation_counts` takes them.

    ``pairs``: i < j; ``reference``: frame, transform into the world.  They overlap if at
    least ``share`` of j's pixels that are present land on like ones of i, or the other
    way round.  A pair with a frame that has no reference pose overlaps in nothing.
    """
    known = pairs.select("i", "j").distinct()
    a, b = (reference.select(F.col("frame").alias(n), F.col("transform").alias(f"t{n}")) for n in "ij")
    met = known.join(a, "i").join(b, "j")
    ways = met.select("i", "j", multiply(invert_rigid(F.col("tj")), F.col("ti")).alias("transform")).unionAll(met.select("j", "i", multiply(invert_rigid(F.col("ti")), F.col("tj"))))
    hits = projective_join(pixels, ways, camera, far, cosine).filter("good").groupBy("i", "j").agg(F.count("*").alias("hits"))
    sizes = pixels.filter("z is not null").groupBy(F.col("frame").alias("i")).agg(F.count("*").alias("n"))
    enough = hits.join(sizes, "i").filter(F.col("hits") >= share * F.col("n")).select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.lit(True).alias("o")).distinct()
    return known.join(enough, ["i", "j"], "left").select("i", "j", F.coalesce("o", F.lit(False)).alias("overlaps"))


def trajectory_valid(quality: DataFrame, least: float = 0.05) -> DataFrame:
    """One row: whether every pair passes (a trajectory without pairs does)."""
    return quality.agg(F.coalesce(F.bool_and(F.col("share") >= least), F.lit(True)).alias("valid"))


def recalibrated_depth(pixels: DataFrame, camera: Camera, transform: list[float]) -> DataFrame:
    """Depth seen from another camera: each pixel moves, the nearest surface wins."""
    p = pixels.withColumn("p", transform_point(F.array(*[F.lit(float(x)) for x in transform]), F.col("x"), F.col("y"), F.col("z")))
    u, v = camera.pixel(F.col("p.x"), F.col("p.y"), F.col("p.z"))
    moved = p.select("frame", u.alias("u"), v.alias("v"), F.col("p.z").alias("depth")).filter(camera.inside(F.col("u"), F.col("v")))
    return moved.groupBy("frame", "u", "v").agg(F.min("depth").alias("depth"))


def precision_recall(pairs: DataFrame) -> DataFrame:
    """Counts of (detected, correct, possible) as precision and recall; null where the divisor is 0."""
    sums = pairs.agg(*[F.count_if(F.col(c)).alias(c) for c in ("detected", "correct", "possible")])
    return sums.select("*", F.try_divide("correct", "detected").alias("precision"), F.try_divide("detected", "possible").alias("recall"))


def evaluation_counts(pairs: DataFrame, matches: DataFrame, worst2: float) -> DataFrame:
    """(i, j, overlaps) and (i, j, error2) -> j, total, detected, correct: of the pairs that truly overlap, those matched, and those matched without an error of ``worst2`` or more."""
    worst = matches.groupBy("i", "j").agg(F.max("error2").alias("worst2"))
    met = pairs.filter("overlaps").join(worst, ["i", "j"], "left")
    return met.groupBy("j").agg(F.count("*").alias("total"), F.count("worst2").alias("detected"), F.count_if(F.col("worst2") < worst2).alias("correct"))


def pair_counts(links: DataFrame) -> DataFrame:
    """i, j, n, share: links of each pair, also as a share of the most that a pair has."""
    counts = links.groupBy("i", "j").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.max("n").alias("most")))).select("i", "j", "n", (F.col("n") / F.col("most")).alias("share"))


def neighbours(links: DataFrame) -> DataFrame:
    """node, others: the different nodes that a node has a link with, in order, in either direction."""
    both = links.select(F.col("i").alias("node"), F.col("j").alias("other")).union(links.select("j", "i")).filter("node <> other").distinct()
    return both.groupBy("node").agg(F.sort_array(F.collect_list("other")).alias("others"))


def agreeing_depth(keys: DataFrame, poses: DataFrame, pixels: DataFrame, camera: Camera, close: float = 0.05) -> DataFrame:
    """Keys (key, chunk, u, v, depth in the chunk's first frame) -> key, depth, frames: the mean with every other frame that sees the same surface.

    ``poses``: chunk, frame, transform into the first frame; ``pixels``: frame, u,
    v, depth.  A frame agrees if its depth where the key falls is within ``close``;
    its own point, carried back, counts.
    """
    at = camera.back_project(F.col("u"), F.col("v"), F.col("depth"))
    seen = keys.join(poses.select("chunk", "frame", "transform"), "chunk").withColumn("p", transform_point(invert_rigid(F.col("transform")), at["x"], at["y"], at["z"]))
    u, v = camera.project(F.col("p.x"), F.col("p.y"), F.col("p.z"))
    seen = seen.select("key", "frame", "transform", F.col("p.z").alias("z"), u.alias("fu"), v.alias("fv"), F.round(u).cast("int").alias("u"), F.round(v).cast("int").alias("v"))
    met = seen.join(pixels.select("frame", "u", "v", "depth"), ["frame", "u", "v"]).filter(F.abs(F.col("depth") - F.col("z")) < close)
    back = camera.back_project(F.col("fu"), F.col("fv"), F.col("depth"))
    depths = met.select("key", transform_point(F.col("transform"), back["x"], back["y"], back["z"])["z"].alias("depth"))
    return keys.select("key", "depth").unionByName(depths).groupBy("key").agg(F.avg("depth").alias("depth"), F.count("*").alias("frames"))
