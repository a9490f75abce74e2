"""Surfaces from voxel distances: cells, triangles, ray marching."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Corner c of a cell is at offset (c & 1, c >> 1 & 1, c >> 2).
CORNERS = [(c & 1, c >> 1 & 1, c >> 2) for c in range(8)]


def cells(voxels: DataFrame, value: str = "sdf", weight: str = "weight") -> DataFrame:
    """x, y, z, sdf (8 numbers): cells all of whose corners were seen."""
    seen = voxels.filter((F.col(weight) > 0) & F.col(value).isNotNull())
    corner = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dz).alias("dz")) for c, (dx, dy, dz) in enumerate(CORNERS)]))
    spread = seen.select("x", "y", "z", F.col(value).cast("double").alias("v"), corner.alias("o"))
    moved = spread.select((F.col("x") - F.col("o.dx")).alias("x"), (F.col("y") - F.col("o.dy")).alias("y"), (F.col("z") - F.col("o.dz")).alias("z"), F.col("o.c").alias("c"), "v")
    whole = moved.groupBy("x", "y", "z").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("c", "v"))).alias("s")).filter("n = 8")
    return whole.select("x", "y", "z", F.col("s.v").alias("sdf"))


def tetrahedra() -> list[tuple[int, int, int, int]]:
    """The six tetrahedra of a cell along its main diagonal: one for each order of the axes."""
    out = []
    for order in permutations(range(3)):
        at = [0]
        for axis in order:
            at.append(at[-1] | 1 << axis)
        out.append(tuple(at))
    return out


def triangles_of(base: np.ndarray, sdf: np.ndarray, size: float) -> np.ndarray:
    """(n, 3) cells with (n, 8) distances -> (m, 3, 3) triangles of the zero level."""
    corners = np.array(CORNERS, float)
    found = []
    for tet in tetrahedra():
        p = (base[:, None, :] + corners[list(tet)][None]) * size
        d = sdf[:, list(tet)]
        inside = d < 0
        order = np.argsort(~inside, axis=1, kind="stable")  # inner corners first
        p, d = np.take_along_axis(p, order[..., None], 1), np.take_along_axis(d, order, 1)
        count = inside.sum(1)

        def cross(rows: np.ndarray, a: int, b: int) -> np.ndarray:
            t = d[rows, a] / (d[rows, a] - d[rows, b])
            return p[rows, a] + t[:, None] * (p[rows, b] - p[rows, a])  # noqa: B023

        one, two, three = (np.flatnonzero(count == k) for k in (1, 2, 3))
        found.append(np.stack([cross(one, 0, 1), cross(one, 0, 2), cross(one, 0, 3)], 1))
        found.append(np.stack([cross(three, 0, 3), cross(three, 1, 3), cross(three, 2, 3)], 1))
        a, b, c, e = cross(two, 0, 2), cross(two, 0, 3), cross(two, 1, 2), cross(two, 1, 3)
        found += [np.stack([a, b, c], 1), np.stack([b, e, c], 1)]
    out = np.concatenate(found)
    area = np.linalg.norm(np.cross(out[:, 1] - out[:, 0], out[:, 2] - out[:, 0]), axis=1)
    return out[area > 0]


def extract_surface(voxels: DataFrame, size: float, far: float | None = None) -> DataFrame:
    """Triangles (v0, v1, v2: arrays of 3) of the zero level; cells with a corner farther than ``far`` are left out."""
    whole = cells(voxels)
    if far is not None:
        whole = whole.filter(F.forall("sdf", lambda d: F.abs(d) < far))
    crossing = whole.filter(F.exists("sdf", lambda d: d < 0) & F.exists("sdf", lambda d: d >= 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = np.stack([batch.column(i).to_numpy().astype(float) for i in range(3)], 1)
            found = triangles_of(base, batch.column(3).flatten().to_numpy().reshape(-1, 8), size)
            yield pa.RecordBatch.from_arrays([pa.array(list(found[:, k]), pa.list_(pa.float64())) for k in range(3)], names=["v0", "v1", "v2"])

    return crossing.mapInArrow(run, "v0 array<double>, v1 array<double>, v2 array<double>")


def weld(triangles: DataFrame, close: float = 1e-5) -> DataFrame:
    """Triangles with corners snapped to a grid of ``close``, without degenerate ones and repeats (in any corner order)."""
    snap = lambda v: F.transform(v, lambda x: F.round(x / close).cast("long"))
    snapped = triangles.select(*[snap(F.col(c)).alias(c) for c in ("v0", "v1", "v2")]).filter("v0 <> v1 and v1 <> v2 and v0 <> v2")
    once = snapped.withColumn("key", F.array_sort(F.array("v0", "v1", "v2"))).dropDuplicates(["key"])
    return once.select(*[F.transform(c, lambda x: x * F.lit(close)).alias(c) for c in ("v0", "v1", "v2")])


def surface_area(triangles: DataFrame) -> DataFrame:
    a = [F.col("v1")[i] - F.col("v0")[i] for i in range(3)]
    b = [F.col("v2")[i] - F.col("v0")[i] for i in range(3)]
    n = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    return triangles.agg(F.sum(F.sqrt(n[0] ** 2 + n[1] ** 2 + n[2] ** 2) / 2).alias("area"), F.count("*").alias("triangles"))


@udtf(returnType="bx int, by int, bz int")
class MarchBlocks:
    """Blocks that the segment from (x0, y0, z0) to (x1, y1, z1) passes, in units of blocks, in order: use with LATERAL."""

    def eval(self, x0: float, y0: float, z0: float, x1: float, y1: float, z1: float):
        start, end = np.array([x0, y0, z0], float), np.array([x1, y1, z1], float)
        if not (np.isfinite(start).all() and np.isfinite(end).all()):
            return
        at, last = np.floor(start).astype(int), np.floor(end).astype(int)
        step = np.sign(end - start).astype(int)
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = np.abs(1 / (end - start))
            border = np.where(step > 0, at + 1 - start, start - at)
            until = np.where(step == 0, np.inf, border * gap)
        yield int(at[0]), int(at[1]), int(at[2])
        for _ in range(int(np.abs(last - at).sum())):
            axis = int(np.argmin(until))
            at[axis] += step[axis]
            until[axis] += gap[axis]
            yield int(at[0]), int(at[1]), int(at[2])
