"""Small frames: everything the dense term needs of a frame, made once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.functions.camera import Camera

from . import images

CACHE = "frame long, width int, height int, depth array<double>, points array<double>, normals array<double>, intensity array<double>, dx array<double>, dy array<double>"


def small_frame(depth: np.ndarray, intensity: np.ndarray, camera: Camera, width: int, height: int, sigma: float, spread: float, blur: float) -> dict[str, np.ndarray]:
    """Depth smoothed where it differs by less than ``spread``, its points and normals, and the blurred intensity with its derivatives, all at width x height.

    ``camera`` is that of the full image.  Normals are found at full size, points at
    the small size; missing stays missing.
    """
    smooth = images.smooth(depth, sigma, spread)
    points = images.back_project(smooth, camera.fx, camera.fy, camera.cx, camera.cy)
    normals = images.normals(points)
    small = images.resize(images.smooth(intensity, blur), width, height)
    dx, dy = images.sobel(small)
    resized = lambda planes: np.stack([images.resize(planes[..., k], width, height) for k in range(planes.shape[-1])], -1)
    return {"depth": images.resize(smooth, width, height), "points": resized(points), "normals": resized(normals), "intensity": small, "dx": dx, "dy": dy}


def small_frames(frames: DataFrame, camera: Camera, width: int = 80, height: int = 60, sigma: float = 2.0, spread: float = 0.05, blur: float = 1.0) -> DataFrame:
    """(idx, depth, intensity: arrays row by row, null for missing) -> one row a frame with all planes.

    A frame is one row of work and its planes are arrays: write the result once by
    ``frame`` and join to it.  A null or wrongly sized image gives no row.
    """
    names = [x.split()[0] for x in CACHE.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.float64())] * 6]

    def plane(cell: pa.Scalar) -> np.ndarray | None:
        if not cell.is_valid or len(cell.values) != camera.width * camera.height:
            return None
        return cell.values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(camera.height, camera.width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                depth, intensity = plane(batch.column(1)[r]), plane(batch.column(2)[r])
                if depth is None or intensity is None:
                    continue
                made = small_frame(depth, intensity, camera, width, height, sigma, spread, blur)
                lists = [pa.ListArray.from_arrays(pa.array([0, made[n].size], pa.int32()), pa.array(made[n].ravel(), mask=~np.isfinite(made[n].ravel()))) for n in names[3:]]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[r].as_py()], pa.int64()), pa.array([width], pa.int32()), pa.array([height], pa.int32()), *lists], names=names)

    return frames.select(F.col("idx").cast("long").alias("idx"), F.col("depth").cast("array<double>").alias("depth"), F.col("intensity").cast("array<double>").alias("intensity")).mapInArrow(run, CACHE)


def cached_pixels(cache: DataFrame) -> DataFrame:
    """frame, u, v, x, y, z, nx, ny, nz, intensity: the rows that :func:`verify.projective_join` takes, where point and normal are present."""
    each = cache.select("frame", "width", "points", "normals", "intensity", F.explode(F.sequence(F.lit(0), F.size("intensity") - 1)).alias("p"))
    at = lambda c, k: F.get(c, F.col("p") * 3 + k)
    rows = each.select(
        "frame", (F.col("p") % F.col("width")).cast("int").alias("u"), F.floor(F.col("p") / F.col("width")).cast("int").alias("v"),
        *[at("points", k).alias(c) for k, c in enumerate("xyz")], *[at("normals", k).alias(f"n{c}") for k, c in enumerate("xyz")], F.get("intensity", F.col("p")).alias("intensity"),
    )
    return rows.dropna(subset=["x", "y", "z", "nx", "ny", "nz"])
