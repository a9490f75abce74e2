"""Pose-graph refinement: moments per pair in Spark, Gauss-Newton on the moments.

The squared error of a pair under any two poses follows from sums over its
correspondences.  One aggregate reduces all correspondences to 33 numbers a pair
of frames; every iteration then costs the number of pairs, however many
correspondences there are.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.functions.camera import dense_weight, multiply, transform_point
from framequarry.functions.se3 import exp_se3, hat, pose_to_matrix

from .graph import checkpoint_folder, drop_pairs, worst

P, Q = ("px", "py", "pz"), ("qx", "qy", "qz")


def pair_moments(links: DataFrame, weight: str | None = None) -> DataFrame:
    """(i, j, p in frame i, q in frame j) -> i, j, moments: the 8 x 8 sum of (p, 1, q, 1) by itself, upper part."""
    w = F.col(weight) if weight else F.lit(1.0)
    terms = [*[F.col(c) for c in P], F.lit(1.0), *[F.col(c) for c in Q], F.lit(1.0)]
    cells = [F.sum(w * terms[a] * terms[b]) for a in range(8) for b in range(a, 8)]
    return links.dropna(subset=[*P, *Q]).groupBy("i", "j").agg(F.array(*cells).alias("moments"), F.count("*").alias("n"))


def _square(cells: list[float]) -> np.ndarray:
    out = np.zeros((8, 8))
    out[np.triu_indices(8)] = cells
    return out + np.triu(out, 1).T


def normal_equations(pairs: list[tuple[int, int, np.ndarray]], poses: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Matrix, right side and squared error of the residuals T_i p - T_j q, for updates on the left of each pose."""
    n = len(poses)
    a, g, energy = np.zeros((6 * n, 6 * n)), np.zeros(6 * n), 0.0

    def block(x: np.ndarray, count: float, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.empty((6, 6))
        out[:3, :3] = np.trace(x) * np.eye(3) - x.T
        out[:3, 3:], out[3:, :3] = hat(first[None])[0], -hat(second[None])[0]
        out[3:, 3:] = count * np.eye(3)
        return out

    for i, j, m in pairs:
        ti, tj = poses[i], poses[j]
        x, y, z = ti @ m[:4, :4] @ ti.T, tj @ m[4:, 4:] @ tj.T, ti @ m[:4, 4:] @ tj.T
        count, sx, sy = m[3, 3], x[:3, 3], y[:3, 3]
        energy += np.trace(x[:3, :3]) + np.trace(y[:3, :3]) - 2 * np.trace(z[:3, :3])
        turn = np.array([z[1, 2] - z[2, 1], z[2, 0] - z[0, 2], z[0, 1] - z[1, 0]])
        at, bt = slice(6 * i, 6 * i + 6), slice(6 * j, 6 * j + 6)
        a[at, at] += block(x[:3, :3], count, sx, sx)
        a[bt, bt] += block(y[:3, :3], count, sy, sy)
        cross = -block(z[:3, :3], count, sx, sy)
        a[at, bt] += cross
        a[bt, at] += cross.T
        g[at] += np.concatenate([-turn, sx - sy])
        g[bt] += np.concatenate([turn, sy - sx])
    return a, g, float(energy)


def solve_poses(moments: DataFrame, poses: dict[int, np.ndarray], iterations: int = 100, small: float = 1e-9, most_pairs: int = 1_000_000) -> tuple[dict[int, np.ndarray], list[float]]:
    """Refined poses and the squared error of each iteration; the first frame stays.

    The graph of frames (not the correspondences) is solved in memory, so its size
    is checked: at most ``most_pairs`` pairs.
    """
    rows = moments.limit(most_pairs + 1).collect()
    if len(rows) > most_pairs:
        raise ValueError(f"more than {most_pairs} pairs of frames: solve by chunks first")
    order = sorted(poses)
    index = {f: k for k, f in enumerate(order)}
    pairs = [(index[r.i], index[r.j], _square(r.moments)) for r in rows if r.i in index and r.j in index]
    now, energies = np.stack([poses[f] for f in order]), []
    for _ in range(iterations):
        a, g, energy = normal_equations(pairs, now)
        energies.append(energy)
        a[:6] = 0
        a[:, :6] = 0
        a[np.arange(6), np.arange(6)] = 1
        g[:6] = 0
        step = np.linalg.lstsq(a + 1e-9 * np.eye(len(a)), -g, rcond=None)[0]
        now = exp_se3(step.reshape(-1, 6)) @ now
        if np.abs(step).max() < small:
            break
    return dict(zip(order, now)), energies


def residuals(links: DataFrame, poses: DataFrame) -> DataFrame:
    """Links with the distance of their two points in the world, by poses (frame, transform)."""
    a = poses.select(F.col("frame").alias("i"), F.col("transform").alias("ti"))
    b = poses.select(F.col("frame").alias("j"), F.col("transform").alias("tj"))
    both = links.join(a, "i").join(b, "j").withColumn("x", transform_point(F.col("ti"), *[F.col(c) for c in P])).withColumn("y", transform_point(F.col("tj"), *[F.col(c) for c in Q]))
    square = sum(((F.col(f"x.{c}") - F.col(f"y.{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    return both.withColumn("residual", F.sqrt(square)).drop("ti", "tj", "x", "y")


def refine(links: DataFrame, poses: dict[int, np.ndarray], rounds: int = 10, worst_residual: float = 0.05) -> tuple[dict[int, np.ndarray], DataFrame]:
    """Solve, drop the pair with the worst residual while it exceeds the limit, solve again; (poses, links left)."""
    spark = links.sparkSession
    for _ in range(rounds):
        poses, _ = solve_poses(pair_moments(links), poses)
        table = spark.createDataFrame([(int(f), m.ravel().tolist()) for f, m in poses.items()], "frame long, transform array<double>")
        top = worst(residuals(links, table), [], "residual", ["i", "j"]).first()
        if top is None or top["residual"] is None or top["residual"] <= worst_residual:
            break
        links = drop_pairs(links, spark.createDataFrame([(top["i"], top["j"])], "i long, j long"), ["i", "j"])
    return poses, links


def pair_blocks(moments: DataFrame, poses: DataFrame) -> DataFrame:
    """Sparse term: moments of pairs and (frame, transform) -> i, j, h (18 x 6 numbers: the blocks ii, jj, ij), g (12 numbers), energy.

    What :func:`normal_equations` says of one pair, one row of numbers each.
    """

    @F.pandas_udf("h array<double>, g array<double>, energy double")
    def one(m: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for cells, ti, tj in zip(m, a, b):
            h, g, energy = normal_equations([(0, 1, _square(cells))], np.stack([np.reshape(ti, (4, 4)), np.reshape(tj, (4, 4))]))
            rows.append((np.concatenate([h[:6, :6], h[6:, 6:], h[:6, 6:]]).ravel().tolist(), g.tolist(), energy))
        return pd.DataFrame(rows, columns=["h", "g", "energy"])

    met = _with_poses(moments, poses)
    return met.select("i", "j", one("moments", "ti", "tj").alias("x")).select("i", "j", "x.h", "x.g", "x.energy")


def _with_poses(pairs: DataFrame, poses: DataFrame) -> DataFrame:
    a = poses.select(F.col("frame").alias("i"), F.col("transform").alias("ti"))
    b = poses.select(F.col("frame").alias("j"), F.col("transform").alias("tj"))
    return pairs.join(a, "i").join(b, "j")


def dense_blocks(found: DataFrame, poses: DataFrame, depth_weight: float = 1.0, intensity_weight: float = 0.0, far: float = 2.0, power: float = 2.5, colour: float = 0.1) -> DataFrame:
    """Dense term of pixel pairs, as blocks like those of :func:`pair_blocks`; everything is a sum per pair of frames.

    ``found``: i, j, point p of frame j (px, py, pz) with the point q and the normal
    n of the pixel of frame i that it lands on (qx ... nz).  The residual is the
    distance to i's tangent plane; it counts less with depth, nothing from ``far``
    on, times the pair's :func:`dense_weight`.  With columns ``gx, gy, gz`` (the
    derivative of i's intensity by the position in i) and ``residual`` (difference
    of the intensities) and an ``intensity_weight`` the intensity term is added; a
    difference of ``colour`` or more does not count.  Moving either pose moves the
    point against the plane, once forwards and once backwards, so the four blocks
    of a pair are one 6 x 6 sum with its signs.
    """
    met = _with_poses(found, poses)
    p = transform_point(F.col("tj"), *[F.col(f"p{c}") for c in "xyz"])
    q = transform_point(F.col("ti"), *[F.col(f"q{c}") for c in "xyz"])
    turned = lambda names: [reduce(lambda s, k: s + F.col("ti")[4 * r + k] * F.col(names[k]), range(1, 3), F.col("ti")[4 * r] * F.col(names[0])) for r in range(3)]

    def row(d: Column) -> Column:
        """Derivative of (d . point) by a turn and a shift of the world."""
        x = [F.col(f"w.{c}") for c in "xyz"]
        return F.array(x[1] * d[2] - x[2] * d[1], x[2] * d[0] - x[0] * d[2], x[0] * d[1] - x[1] * d[0], d[0], d[1], d[2])

    placed = met.select("i", "j", p.alias("w"), q.alias("y"), "qz", F.array(*turned(["nx", "ny", "nz"])).alias("n"), *([F.array(*turned(["gx", "gy", "gz"])).alias("slope"), "residual"] if intensity_weight else []))
    distance = sum(((F.col(f"w.{c}") - F.col(f"y.{c}")) * F.col("n")[k] for k, c in enumerate("xyz")), F.lit(0.0))
    terms = [F.struct(F.lit(1).alias("pixel"), row(F.col("n")).alias("a"), distance.alias("r"), (depth_weight * F.pow(F.greatest(F.lit(0.0), 1 - F.col("qz") / far), F.lit(power))).alias("k"))]
    if intensity_weight:
        share = F.greatest(F.lit(0.0), 1 - F.abs("residual") / (1.15 * colour))
        terms.append(F.struct(F.lit(0).alias("pixel"), row(F.col("slope")).alias("a"), F.col("residual").alias("r"), F.when(F.abs("residual") < colour, intensity_weight * share).otherwise(0.0).alias("k")))
    placed = placed.select("i", "j", F.explode(F.array(*terms)).alias("t")).select("i", "j", "t.pixel", *[F.col("t.a")[x].alias(f"a{x}") for x in range(6)], "t.r", "t.k")
    upper = [F.sum(F.col("k") * F.col(f"a{x}") * F.col(f"a{y}")) for x in range(6) for y in range(x, 6)]
    right = [F.sum(F.col("k") * F.col(f"a{x}") * F.col("r")) for x in range(6)]
    energy = F.sum(F.col("k") * F.col("r") * F.col("r"))
    place = {(x, y): n for n, (x, y) in enumerate((x, y) for x in range(6) for y in range(x, 6))}
    whole = placed.groupBy("i", "j").agg(F.sum("pixel").alias("n"), F.array(*upper).alias("u"), F.array(*right).alias("r"), energy.alias("e")).withColumn("c", dense_weight(F.col("n")))
    whole = whole.withColumn("s", F.array(*[F.col("u")[place[min(x, y), max(x, y)]] for x in range(6) for y in range(6)]))
    scaled = lambda x, f: F.transform(x, lambda v: v * F.col("c") * f)
    h = F.concat(scaled("s", 1.0), scaled("s", 1.0), scaled("s", -1.0))
    return whole.select("i", "j", h.alias("h"), F.concat(scaled("r", -1.0), scaled("r", 1.0)).alias("g"), (F.col("e") * F.col("c")).alias("energy"))


def _times(h: str, first: int, x: str, turned: bool = False) -> Column:
    """Six numbers: the 6 x 6 block of ``h`` that starts at ``first`` (turned: its transpose) times the six numbers ``x``."""
    cell = lambda r, c: F.col(h)[first + (6 * c + r if turned else 6 * r + c)]
    return F.array(*[reduce(lambda s, c: s + cell(r, c) * F.col(x)[c], range(1, 6), cell(r, 0) * F.col(x)[0]) for r in range(6)])


def apply_blocks(blocks: DataFrame, vector: DataFrame) -> DataFrame:
    """Blocks of pairs times (frame, p: six numbers) -> frame, ap: a join at both ends and one sum a frame."""
    a, b = (vector.select(F.col("frame").alias(n), F.col("p").alias(f"p{n}")) for n in "ij")
    met = blocks.select("i", "j", "h").join(a, "i").join(b, "j")
    plus = lambda x, y: F.zip_with(x, y, lambda s, t: s + t)
    mine = met.select(F.col("i").alias("frame"), plus(_times("h", 0, "pi"), _times("h", 72, "pj")).alias("y"))
    theirs = met.select(F.col("j").alias("frame"), plus(_times("h", 36, "pj"), _times("h", 72, "pi", True)).alias("y"))
    return _sum_rows(mine.unionAll(theirs), "y").withColumnRenamed("y", "ap")


def _sum_rows(rows: DataFrame, name: str, size: int = 6) -> DataFrame:
    return rows.groupBy("frame").agg(F.array(*[F.sum(F.col(name)[k]) for k in range(size)]).alias(name))


def _dot(x: str, y: str) -> Column:
    return F.sum(F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


def conjugate_gradients(blocks: DataFrame, frames: DataFrame, fixed: int, rounds: int = 200, small: float = 5e-7) -> DataFrame:
    """(i, j, h, g) and (frame) -> frame, x: the step that solves the normal equations, six numbers a frame, 0 for ``fixed``.

    Vectors are tables with one row a frame.  A round is a join of the blocks with
    the search direction and a sum per frame; only three scalars reach the driver.
    Each round is checkpointed, so a lost executor costs one round.  The
    preconditioner is the inverse of the diagonal.  Frames without any block stay.
    """
    checkpoint_folder(frames.sparkSession)
    known = frames.select("frame").distinct()
    for n in "ij":  # a block with an end outside the graph says nothing
        blocks = blocks.join(known.select(F.col("frame").alias(n)), n, "left_semi")
    blocks = blocks.checkpoint()
    ends = lambda c, i, j: blocks.select(F.col("i").alias("frame"), i.alias(c)).unionAll(blocks.select(F.col("j").alias("frame"), j.alias(c)))
    diagonal = lambda first: F.array(*[F.col("h")[first + 7 * k] for k in range(6)])
    right = _sum_rows(ends("r", F.slice("g", 1, 6), F.slice("g", 7, 6)), "r")
    scale = _sum_rows(ends("d", diagonal(0), diagonal(36)), "d")
    zero = F.array(*[F.lit(0.0)] * 6)
    free = frames.select("frame").distinct().filter(F.col("frame") != fixed).join(right, "frame").join(scale, "frame")
    state = free.select("frame", zero.alias("x"), F.transform("r", lambda v: -v).alias("r"), F.transform("d", lambda v: F.when(v > 1e-12, 1 / v).otherwise(1.0)).alias("m"))
    state = state.withColumn("p", F.zip_with("m", "r", lambda a, b: a * b)).checkpoint()
    rz = state.agg(_dot("r", "p")).first()[0]
    start = rz
    held = frames.sparkSession.createDataFrame([(fixed, [0.0] * 6)], "frame long, p array<double>")
    for _ in range(rounds):
        if not rz or rz <= small * start:
            break
        state = state.join(apply_blocks(blocks, state.select("frame", "p").unionByName(held)), "frame").checkpoint()
        curve = state.agg(_dot("p", "ap")).first()[0]
        if not curve or curve <= 0:
            break
        alpha = rz / curve
        moved = state.select("frame", F.zip_with("x", "p", lambda a, b: a + b * alpha).alias("x"), F.zip_with("r", "ap", lambda a, b: a - b * alpha).alias("r"), "m", "p")
        moved = moved.withColumn("z", F.zip_with("m", "r", lambda a, b: a * b)).checkpoint()
        before, rz = rz, moved.agg(_dot("r", "z")).first()[0]
        beta = rz / before
        state = moved.select("frame", "x", "r", "m", F.zip_with("z", "p", lambda a, b: a + b * beta).alias("p"))
    return frames.select("frame").distinct().join(state.select("frame", "x"), "frame", "left").select("frame", F.coalesce("x", zero).alias("x"))


def apply_step(poses: DataFrame, step: DataFrame) -> DataFrame:
    """(frame, transform) after a step (frame, x): exp(x) on the left."""
    return poses.join(step, "frame").select("frame", multiply(pose_to_matrix("x"), F.col("transform")).alias("transform"))
