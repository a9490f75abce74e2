"""Gauss-Newton steps by elimination of chunks, for graphs of any number of frames.

A *factor* is a dense piece of the normal equations: ``frames``, ``h`` (6k x 6k, row by
row) and ``g`` (6k).  The pairs' blocks are factors of two frames.  Frames fall into
cells of consecutive numbers.  A frame all of whose factors stay in its cell is
interior; a task for each cell eliminates its interior frames (Schur complement) and
leaves one factor over the cell's other frames.  Then the cells are made wider, until
the frames that are left fit a dense solve; from there the eliminated frames follow,
level by level.  Work is by cells in parallel and memory by the largest cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framequarry.functions.camera import Camera, invert_rigid, multiply

from .graph import checkpoint_folder
from .solver import apply_step, dense_blocks, pair_blocks
from .verify import projective_join

FACTOR = "frames array<long>, h array<double>, g array<double>"
#: Frames that the last, dense solve takes, at most; frames of a cell, at most; added to the diagonal.
DENSE, LARGEST, DAMPING = 400, 400, 1e-9


def factors_of(blocks: DataFrame) -> DataFrame:
    """(i, j, h: the blocks ii, jj, ij, g) -> factors of two frames."""

    @F.pandas_udf("array<double>")
    def whole(h: pd.Series) -> pd.Series:
        def one(cells):
            a, b, c = np.reshape(np.asarray(cells, float), (3, 6, 6))
            return np.block([[a, c], [c.T, b]]).ravel().tolist()

        return h.map(one)

    return blocks.select(F.array("i", "j").cast("array<long>").alias("frames"), whole("h").alias("h"), "g")


def assemble(order: list[int], factors: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of factors over the frames in ``order``; frames of a factor that aren't there are left out (they don't move)."""
    place = {f: k for k, f in enumerate(order)}
    h, g = np.zeros((6 * len(order), 6 * len(order))), np.zeros(6 * len(order))
    for frames, block, right in factors:
        k = len(frames)
        block, right = np.reshape(block, (6 * k, 6 * k)), np.asarray(right, float)
        mine = [i for i, f in enumerate(frames) if f in place]
        cells = np.concatenate([np.arange(6 * i, 6 * i + 6) for i in mine]) if mine else np.zeros(0, int)
        to = np.concatenate([np.arange(6 * place[frames[i]], 6 * place[frames[i]] + 6) for i in mine]) if mine else np.zeros(0, int)
        np.add.at(h, (to[:, None], to[None, :]), block[np.ix_(cells, cells)])
        np.add.at(g, to, right[cells])
    return h, g


def _eliminate(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One cell's factors and its outer frames -> the factor over these, and what gives the inner frames from them."""
    outer = sorted({int(f) for x in rows.outer for f in x})
    inner = sorted({int(f) for x in rows.frames for f in x} - set(outer))
    if len(inner) > LARGEST:
        raise ValueError(f"a cell has {len(inner)} frames: make the cells smaller")
    h, g = assemble([*inner, *outer], zip(rows.frames, rows.h, rows.g))
    n = 6 * len(inner)
    solved = np.linalg.solve(h[:n, :n] + DAMPING * np.eye(n), np.column_stack([h[:n, n:], g[:n]]))
    left, right = h[n:, n:] - h[n:, :n] @ solved[:, :-1], g[n:] - h[n:, :n] @ solved[:, -1]
    return pd.DataFrame([(key[0], inner, outer, left.ravel().tolist(), right.tolist(), solved[:, :-1].ravel().tolist(), solved[:, -1].tolist())], columns=["cell", "inner", "frames", "h", "g", "k", "c"])


_LEVEL = "cell long, inner array<long>, frames array<long>, h array<double>, g array<double>, k array<double>, c array<double>"


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _inner_step(k: pd.Series, c: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series([(-(np.asarray(b, float) + np.reshape(np.asarray(a, float), (len(b), -1)) @ (np.concatenate(v) if len(v) else np.zeros(0)))).tolist() for a, b, v in zip(k, c, x)], dtype=object)


def solve_step(blocks: DataFrame, fixed: int, cell: int = 32, grow: int = 8, dense: int = DENSE) -> DataFrame:
    """(i, j, h, g) -> frame, x: six numbers for every frame of a block, 0 for ``fixed``; what minimises x'Hx / 2 + g'x.

    Levels are checkpointed.  If widening the cells no longer makes frames interior
    (a graph where nearly all are linked with all), that is an error with the number
    of frames that are left: :func:`solver.conjugate_gradients` takes those.
    """
    checkpoint_folder(blocks.sparkSession)
    now, levels, width = factors_of(blocks).checkpoint(), [], cell
    while True:
        frames = now.select(F.explode("frames").alias("frame")).filter(F.col("frame") != fixed).distinct()
        left = frames.count()
        if left <= dense:
            break
        cells = F.array_distinct(F.transform("frames", lambda f: F.floor(f / width)))
        spread = now.withColumn("cells", cells).withColumn("one", F.size("cells") == 1)
        outer = spread.filter(~F.col("one")).select(F.explode("frames").alias("frame")).distinct()
        outer = outer.union(spread.sparkSession.createDataFrame([(fixed,)], "frame long")).distinct()
        outer = outer.groupBy(F.floor(F.col("frame") / width).alias("cell")).agg(F.collect_set("frame").alias("outer"))
        inside = spread.filter("one").select(F.col("cells")[0].alias("cell"), "frames", "h", "g").join(outer, "cell", "left")
        inside = inside.withColumn("outer", F.array_intersect(F.coalesce("outer", F.array().cast("array<long>")), "frames"))
        level = inside.groupBy("cell").applyInPandas(_eliminate, _LEVEL).checkpoint()
        levels.append(level.select("cell", "inner", "frames", "k", "c"))
        rest = spread.filter(~F.col("one")).select("frames", "h", "g").unionByName(level.filter(F.size("frames") > 0).select("frames", "h", "g")).checkpoint()
        after = rest.select(F.explode("frames").alias("frame")).filter(F.col("frame") != fixed).distinct().count()
        if after >= left and width > 1 << 40:
            raise ValueError(f"{after} frames are linked too densely to be eliminated by cells")
        now, width = rest, width * grow
    order = sorted(r.frame for r in frames.collect())
    h, g = assemble(order, ((r.frames, r.h, r.g) for r in now.toLocalIterator()))
    x = np.linalg.solve(h + DAMPING * np.eye(len(h)), -g).reshape(-1, 6) if order else np.zeros((0, 6))
    known = blocks.sparkSession.createDataFrame([(fixed, [0.0] * 6), *[(f, v.tolist()) for f, v in zip(order, x)]], "frame long, x array<double>")
    for level in reversed(levels):
        asked = level.select("cell", F.posexplode("frames").alias("at", "frame")).join(known, "frame").groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("s"))
        met = level.join(asked, "cell", "left").select("inner", _inner_step("k", "c", F.transform(F.coalesce("s", F.array().cast("array<struct<at:int,x:array<double>>>")), lambda s: s["x"])).alias("y"))
        found = met.select(F.posexplode("inner").alias("at", "frame"), "y").select("frame", F.slice("y", F.col("at") * 6 + 1, F.lit(6)).alias("x"))
        known = known.unionByName(found).checkpoint()
    return known


def gauss_newton(
    moments: DataFrame, poses: DataFrame, fixed: int, rounds: int = 10, small: float = 0.005, found: Callable[[DataFrame], DataFrame] | None = None, dense_weight: Callable[[int], float] = lambda i: i + 1.0, **cells
) -> tuple[DataFrame, list[float]]:
    """Poses (frame, transform) after up to ``rounds`` steps over the sparse and the dense term, and the largest update of each step.

    ``moments``: of :func:`solver.pair_moments`.  ``found`` gives, for the poses of a
    round, the pixel pairs that :func:`solver.dense_blocks` takes (none: no dense term);
    the dense term's weight of round i is ``dense_weight(i)``.  Ends early once no
    pose moves by ``small`` or more.  Both terms' blocks are joined as factors, poses
    stay a table, and each step is checkpointed.
    """
    checkpoint_folder(poses.sparkSession)
    poses, updates = poses.select("frame", "transform").checkpoint(), []
    moments = moments.checkpoint()
    ends = poses.select(F.col("frame").alias("i")), poses.select(F.col("frame").alias("j"))
    moments = moments.join(ends[0], "i", "left_semi").join(ends[1], "j", "left_semi").checkpoint()
    for i in range(rounds):
        blocks = pair_blocks(moments, poses).select("i", "j", "h", "g")
        if found is not None:
            blocks = blocks.unionByName(dense_blocks(found(poses), poses, depth_weight=dense_weight(i)).select("i", "j", "h", "g"))
        step = solve_step(blocks, fixed, **cells)
        still = poses.join(step, "frame", "left_anti").select("frame", "transform")
        moved = apply_step(poses, step).unionByName(still).checkpoint()
        updates.append(float(step.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0] or 0.0))
        poses = moved
        if updates[-1] < small:
            break
    return poses, updates


def projected(pixels: DataFrame, pairs: DataFrame, camera: Camera, far: float = 0.15, cosine: float = 0.97) -> Callable[[DataFrame], DataFrame]:
    """For :func:`gauss_newton`: the pixel pairs of frames (i, j) under given poses, by :func:`verify.projective_join`.

    A pixel of j that lands on one of i near enough and facing alike gives its point
    and the other's point and normal.
    """
    point, normal = ("x", "y", "z"), ("nx", "ny", "nz")
    mine = pixels.select(F.col("frame").alias("i"), F.col("u").alias("u2"), F.col("v").alias("v2"), *[F.col(c).alias(f"q{c}") for c in point], *normal)
    theirs = pixels.select(F.col("frame").alias("j"), "u", "v", *[F.col(c).alias(f"p{c}") for c in point])

    def found(poses: DataFrame) -> DataFrame:
        a = poses.select(F.col("frame").alias("i"), F.col("transform").alias("ti"))
        b = poses.select(F.col("frame").alias("j"), F.col("transform").alias("tj"))
        into = pairs.select("i", "j").join(a, "i").join(b, "j").select(F.col("j").alias("i"), F.col("i").alias("j"), multiply(invert_rigid(F.col("ti")), F.col("tj")).alias("transform"))
        hit = projective_join(pixels, into, camera, far, cosine).filter("good").select(F.col("j").alias("i"), F.col("i").alias("j"), "u", "v", "u2", "v2")
        return hit.join(mine, ["i", "u2", "v2"]).join(theirs, ["j", "u", "v"]).select("i", "j", "px", "py", "pz", "qx", "qy", "qz", *normal)

    return found
