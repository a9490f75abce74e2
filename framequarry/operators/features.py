"""Keypoints: detection, orientations, descriptors, and filters on matched pairs."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import images
from .rigid import SOURCE, TARGET, box_area, fit_rigid


def detect(frames: DataFrame, column: str, width: int, height: int, least: float = 0.02, octaves: int = 4) -> DataFrame:
    """frame, u, v, scale: strict extrema of differences of Gaussians, in image coordinates.  One frame is one row of work."""

    def run(parts):
        for part in parts:
            rows = []
            for idx, image in zip(part.idx, part.image):
                if image is None or len(image) != width * height:
                    continue
                for octave, levels in enumerate(images.difference_of_gaussians(np.asarray(image, float).reshape(height, width), octaves=octaves)):
                    rows += [(idx, float(x << octave), float(y << octave), float(1.6 * 2 ** (octave + level / 3))) for level, y, x in images.extrema(levels, least)]
            yield pd.DataFrame(rows, columns=["frame", "u", "v", "scale"])

    return frames.select(F.col("idx"), F.col(column).alias("image")).mapInPandas(run, "frame long, u double, v double, scale double")


def orientations(votes: np.ndarray, most: int = 2, share: float = 0.8) -> list[float]:
    """Up to ``most`` peaks of a circular histogram of angles, in radians, after six box smoothings."""
    h = votes.astype(float)
    for _ in range(6):
        h = (np.roll(h, 1) + h + np.roll(h, -1)) / 3
    left, right = np.roll(h, 1), np.roll(h, -1)
    peaks = np.flatnonzero((h > left) & (h > right) & (h >= share * h.max()))
    peaks = peaks[np.argsort(-h[peaks], kind="stable")][:most]
    bend = left[peaks] - 2 * h[peaks] + right[peaks]
    offset = np.where(bend != 0, 0.5 * (left[peaks] - right[peaks]) / np.where(bend != 0, bend, 1), 0)
    return (((peaks + offset + 0.5) % len(h)) * 2 * np.pi / len(h)).tolist()


def window(gx: np.ndarray, gy: np.ndarray, u: float, v: float, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The part of two gradient planes within ``reach`` of a point, with its pixels' x and y."""
    top, left = max(0, int(np.floor(v - reach))), max(0, int(np.floor(u - reach)))
    part = slice(top, int(np.ceil(v + reach)) + 1), slice(left, int(np.ceil(u + reach)) + 1)
    y, x = np.mgrid[part[0].start : min(part[0].stop, gx.shape[0]), part[1].start : min(part[1].stop, gx.shape[1])]
    return gx[part], gy[part], x, y


def window_votes(image: np.ndarray, u: float, v: float, sigma: float, bins: int = 36, gradient: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Gradient angles around a point, weighted by magnitude and a Gaussian; ``gradient``: the image's, where it is known."""
    gx, gy, x, y = window(*(gradient or images.sobel(image)), u, v, 3 * sigma)
    weight = np.exp(-((x - u) ** 2 + (y - v) ** 2) / (2 * sigma * sigma)) * np.hypot(gx, gy)
    near = (np.hypot(x - u, y - v) <= 3 * sigma) & np.isfinite(weight)
    angle = np.mod(np.arctan2(gy[near], gx[near]), 2 * np.pi)
    return np.bincount((angle / (2 * np.pi) * bins).astype(int) % bins, weight[near], bins)


def descriptors(image: np.ndarray, u: float, v: float, angle: float, sigma: float, gradient: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """128 numbers: eight gradient angles in 4 x 4 cells of a window turned by ``angle``, unit length with components up to 0.2."""
    gx, gy, x, y = window(*(gradient or images.sobel(image)), u, v, 7.5 * np.sqrt(2) * sigma)  # a cell has three sigma, the window reaches 2.5 of them
    c, s = np.cos(angle), np.sin(angle)
    a, b = (c * (x - u) + s * (y - v)) / (3 * sigma) + 1.5, (c * (y - v) - s * (x - u)) / (3 * sigma) + 1.5
    turn = np.mod(np.arctan2(gy, gx) - angle, 2 * np.pi) / (2 * np.pi) * 8
    near = (a > -1) & (a < 4) & (b > -1) & (b < 4) & np.isfinite(turn)
    weight = np.hypot(gx, gy)[near] * np.exp(-((a[near] - 1.5) ** 2 + (b[near] - 1.5) ** 2) / 8)
    out = np.zeros((4, 4, 8))
    for da in (0, 1):
        for db in (0, 1):
            for dt in (0, 1):
                i, j, k = np.floor(a[near]).astype(int) + da, np.floor(b[near]).astype(int) + db, np.floor(turn[near]).astype(int) + dt
                part = weight * (1 - np.abs(a[near] - i)) * (1 - np.abs(b[near] - j)) * (1 - np.abs(turn[near] - k))
                ok = (i >= 0) & (i < 4) & (j >= 0) & (j < 4)
                np.add.at(out, (j[ok], i[ok], k[ok] % 8), part[ok])
    flat = out.ravel()
    for _ in range(2):
        flat = np.minimum(flat / max(np.linalg.norm(flat), 1e-12), 0.2)
    return flat / max(np.linalg.norm(flat), 1e-12)


def wide_pairs(matches: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Pairs whose matched points cover at least ``least`` area in one of the two images."""
    a = box_area(matches, keys, "u1", "v1").withColumnRenamed("area", "area1")
    b = box_area(matches, keys, "u2", "v2").withColumnRenamed("area", "area2")
    return a.join(b, keys).filter((F.col("area1") >= least) | (F.col("area2") >= least))


def seeded_inliers(src: np.ndarray, dst: np.ndarray, worst2: float, seeds: int = 8) -> tuple[list[int], np.ndarray | None]:
    """The largest consistent set grown from any three of the first ``seeds`` matches; ties go to the smaller error."""
    best: tuple[int, float, list[int]] = (0, 0.0, [])
    for three in combinations(range(min(seeds, len(src))), 3):
        rows = list(three)
        m = fit_rigid(src[rows], dst[rows])
        error = ((src @ m[:3, :3].T + m[:3, 3] - dst) ** 2).sum(1)
        inside = np.flatnonzero(error <= worst2).tolist()
        if set(rows) <= set(inside) and (len(inside), -error[inside].sum()) > (best[0], -best[1]):
            best = (len(inside), float(error[inside].sum()), inside)
    return best[2], fit_rigid(src[best[2]], dst[best[2]]) if best[0] >= 3 else None


def filter_pairs_seeded(matches: DataFrame, keys: list[str], worst2: float = 0.0004) -> DataFrame:
    """keys, kept (match ids) by :func:`seeded_inliers` of each pair of frames, a bounded group."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["dist", "match_id"])
        kept, _ = seeded_inliers(rows[list(SOURCE)].to_numpy(float), rows[list(TARGET)].to_numpy(float), worst2)
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in keys}, "kept": [rows.match_id.iloc[kept].tolist()]}, dtype=object)

    kinds = ", ".join(f"{k} {matches.schema[k].dataType.simpleString()}" for k in keys)
    return matches.groupBy(*keys).applyInPandas(one, f"{kinds}, kept array<long>")


def dense_frames(frames: DataFrame, count: int) -> DataFrame:
    """Every number from 0 to ``count`` - 1, with the frame where there is one."""
    spine = frames.sparkSession.range(count).withColumnRenamed("id", "idx")
    return spine.join(frames, "idx", "left")
