"""Stencils and resampling of whole images: one row a frame, the image an array.

A frame's image has a fixed, bounded size, so each row is worked on by itself and
no pixel is shuffled.  Missing values are NaN in the arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def per_image(frames: DataFrame, column: str | list[str], out: str, width: int, height: int, f: Callable[..., np.ndarray]) -> DataFrame:
    """``frames`` with ``f`` of the image in ``column``, or of the images in several columns; a null or ill-sized image gives null.

    An array of k numbers a pixel reaches ``f`` as (height, width, k).
    """
    columns = [column] if isinstance(column, str) else column
    pixels = width * height

    def shaped(x) -> np.ndarray | None:
        if x is None or not len(x) or len(x) % pixels:
            return None
        image = np.asarray(x, float)
        return image.reshape(height, width) if len(x) == pixels else image.reshape(height, width, -1)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            images = [[shaped(x) for x in row] for row in (zip(part) if isinstance(part, pd.Series) else zip(*part))]
            yield pd.Series([np.asarray(f(*row), float).ravel().tolist() if all(x is not None for x in row) else None for row in images], dtype=object)

    return frames.withColumn(out, run(*columns))


def shifted(image: np.ndarray, dx: int, dy: int, outside: float = np.nan) -> np.ndarray:
    """The neighbour at (x + dx, y + dy) of each pixel, ``outside`` (NaN) beyond the border."""
    out = np.full(image.shape, outside)
    h, w = image.shape
    ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    if ys.start < ys.stop and xs.start < xs.stop:
        out[ys, xs] = image[ys.start + dy : ys.stop + dy, xs.start + dx : xs.stop + dx]
    return out


def smooth(image: np.ndarray, sigma: float, spread: float | None = None, soft: bool = False, guide: np.ndarray | None = None) -> np.ndarray:
    """Gaussian mean over ceil(2 sigma) pixels of those present; ``spread`` limits (or, ``soft``, weighs) the difference of the guide."""
    guide = image if guide is None else guide
    r = int(np.ceil(2 * sigma))
    up, down = np.zeros(image.shape), np.zeros(image.shape)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            v, g = shifted(image, dx, dy), shifted(guide, dx, dy) - guide
            weight = np.full(image.shape, np.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)))
            if spread is not None:
                weight = weight * (np.exp(-(g * g) / (2 * spread * spread)) if soft else np.abs(g) < spread)
            ok = np.isfinite(v) & np.isfinite(weight)
            up += np.where(ok, v * np.where(ok, weight, 0), 0)
            down += np.where(ok, weight, 0)
    return np.where(np.isfinite(image) & (down > 0), up / np.where(down > 0, down, 1), np.nan)


def sobel(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives in x and y; NaN where any neighbour is missing."""
    s = {(dx, dy): shifted(image, dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)}
    whole = np.where(sum(np.isfinite(v) for v in s.values()) == 9, 0.0, np.nan)
    gx = sum(w * (s[1, dy] - s[-1, dy]) for dy, w in ((-1, 1), (0, 2), (1, 1))) / 8
    gy = sum(w * (s[dx, 1] - s[dx, -1]) for dx, w in ((-1, 1), (0, 2), (1, 1))) / 8
    return gx + whole, gy + whole


def gradient_magnitude(image: np.ndarray) -> np.ndarray:
    gx, gy = sobel(image)
    return np.hypot(gx, gy)


def back_project(depth: np.ndarray, fx: float, fy: float, cx: float, cy: float) -> np.ndarray:
    """(h, w, 3) camera-space points."""
    v, u = np.mgrid[0 : depth.shape[0], 0 : depth.shape[1]]
    return np.stack([(u - cx) / fx * depth, (v - cy) / fy * depth, depth], -1)


def normals(points: np.ndarray) -> np.ndarray:
    """Unit normals from central differences, towards the camera; NaN next to missing points."""
    dx = np.stack([(shifted(points[..., i], 1, 0) - shifted(points[..., i], -1, 0)) for i in range(3)], -1)
    dy = np.stack([(shifted(points[..., i], 0, 1) - shifted(points[..., i], 0, -1)) for i in range(3)], -1)
    n = -np.cross(dx, dy)
    length = np.linalg.norm(n, axis=-1, keepdims=True)
    return np.where(np.isfinite(points[..., :1]) & (length > 0), n / np.where(length > 0, length, 1), np.nan)


def erode(depth: np.ndarray, radius: int = 3, far: float = 0.05, share: float = 0.3) -> np.ndarray:
    """Drops pixels of which at least ``share`` of the window is missing, zero or farther than ``far`` from them."""
    bad = np.zeros(depth.shape)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            v = shifted(depth, dx, dy)
            bad += ~np.isfinite(v) | (v == 0) | (np.abs(v - depth) > far)
    return np.where(bad >= share * (2 * radius + 1) ** 2, np.nan, depth)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Nearest neighbour: the corners map to the corners."""
    index = lambda new, old: np.floor(np.arange(new) * ((old - 1) / max(1, new - 1)) + 0.5).astype(int)
    return image[np.ix_(index(height, image.shape[0]), index(width, image.shape[1]))]


def remove_outliers(depth: np.ndarray, radius: int, deviations: float, missing: float = 8.0) -> np.ndarray:
    """Drops pixels more than ``deviations`` standard deviations from their window's mean; missing counts as ``missing``."""
    window = np.stack([np.nan_to_num(shifted(depth, dx, dy), nan=missing) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)])
    return np.where(np.abs(depth - window.mean(0)) > deviations * window.std(0), np.nan, depth)


def difference_of_gaussians(image: np.ndarray, levels: int = 3, octaves: int = 4, sigma0: float = 1.6) -> list[list[np.ndarray]]:
    """The pyramid: per octave (each half the size of the one before) the differences of neighbouring levels."""
    out, k = [], 2 ** (1 / levels)
    for _ in range(octaves):
        blurred = [smooth(image, sigma0 * k**i) for i in range(levels + 1)]
        out.append([b - a for a, b in zip(blurred, blurred[1:])])
        image = blurred[-1][::2, ::2]
        if min(image.shape) < 8:
            break
    return out


def extrema(dog: list[np.ndarray], least: float) -> list[tuple[int, int, int]]:
    """(level, y, x) strictly above or below all 26 neighbours and beyond ``least``."""
    found = []
    for level in range(1, len(dog) - 1):
        centre = dog[level]
        others = np.stack([shifted(dog[level + dl], dx, dy) for dl in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dl, dy, dx) != (0, 0, 0)])
        hit = (np.abs(centre) > least) & ((centre > others).all(0) | (centre < others).all(0))
        found += [(level, int(y), int(x)) for y, x in zip(*np.nonzero(hit))]
    return found


def adaptive_smooth(image: np.ndarray, depth: np.ndarray, sigma: float, spread: float, factor: float = 1.0) -> np.ndarray:
    """Gaussian mean whose sigma at a pixel is ``sigma * factor / depth``, over neighbours with a depth within ``spread``; the depth itself may be the image."""
    wide = sigma * factor / np.where(depth > 0, depth, np.nan)
    r = np.where(np.isfinite(wide), np.ceil(2 * wide), -1)
    up, down = np.zeros(image.shape), np.zeros(image.shape)
    for dy in range(-int(r.max(initial=0)), int(r.max(initial=0)) + 1):
        for dx in range(-int(r.max(initial=0)), int(r.max(initial=0)) + 1):
            v, d = shifted(image, dx, dy), shifted(depth, dx, dy)
            ok = (np.maximum(abs(dx), abs(dy)) <= r) & np.isfinite(v) & (np.abs(d - depth) < spread)
            weight = np.where(ok, np.exp(-(dx * dx + dy * dy) / (2 * np.where(ok, wide, 1) ** 2)), 0)
            up += np.where(ok, v, 0) * weight
            down += weight
    return np.where(down > 0, up / np.where(down > 0, down, 1), np.nan)


def planes(image: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``f`` of each plane of an (h, w, k) image: smoothing and derivatives of positions and colours."""
    return np.stack([f(image[..., i]) for i in range(image.shape[-1])], -1)


def smooth_planes(image: np.ndarray, sigma: float, spread: float | None = None) -> np.ndarray:
    """Gaussian mean of all planes; the difference of the last plane (for positions, the depth) limits it softly."""
    return planes(image, lambda p: smooth(p, sigma, spread, True, image[..., -1]))


def derivatives(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel derivatives of every plane, in x and in y."""
    return planes(points, lambda p: sobel(p)[0]), planes(points, lambda p: sobel(p)[1])


def sobel_normals(points: np.ndarray) -> np.ndarray:
    """Unit normals from Sobel derivatives, x derivative times y derivative; the middle point itself may be missing."""
    ring = {(dx, dy): np.stack([shifted(points[..., i], dx, dy) for i in range(3)], -1) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy}
    du = sum(w * (ring[1, dy] - ring[-1, dy]) for dy, w in ((-1, 1), (0, 2), (1, 1)))
    dv = sum(w * (ring[dx, 1] - ring[dx, -1]) for dx, w in ((-1, 1), (0, 2), (1, 1)))
    n = np.cross(du, dv)
    length = np.linalg.norm(n, axis=-1, keepdims=True)
    return np.where(length > 0, n / np.where(length > 0, length, 1), np.nan)


def dilate(depth: np.ndarray, original: np.ndarray, radius: int = 3, far: float = 0.05) -> np.ndarray:
    """1 where more than a 36th (rounded down) of the window has a depth within ``far`` of the original pixel, else missing."""
    near = np.zeros(depth.shape)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            v = shifted(depth, dx, dy)
            near += (v != 0) & (np.abs(v - original) < far)
    return np.where(near > (2 * radius + 1) ** 2 // 36, 1.0, np.nan)


def edge_mask(depth: np.ndarray, far: float) -> np.ndarray:
    """0 where one of the eight neighbours' depths differs by more than ``far``, else 1."""
    jump = np.zeros(depth.shape, bool)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            jump |= np.abs(shifted(depth, dx, dy) - depth) > far
    return np.where(jump, 0.0, 1.0)


def least_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The smaller of two masks at each pixel."""
    return np.minimum(first, second)


def strong_gradients(gx: np.ndarray, gy: np.ndarray, least: float = 0.005) -> np.ndarray:
    """Length of the gradient where it exceeds ``least``, else missing."""
    m = np.hypot(gx, gy)
    return np.where(m > least, m, np.nan)


def upsample(image: np.ndarray, doublings: int = 1) -> np.ndarray:
    """The image enlarged by 2^doublings, linear between pixels, the last row and column held."""
    k = 1 << doublings

    def along(x: np.ndarray) -> np.ndarray:
        at = np.arange(len(x) * k) / k
        low = at.astype(int)
        part = (at - low).reshape(-1, *[1] * (x.ndim - 1))
        return x[low] * (1 - part) + x[np.minimum(low + 1, len(x) - 1)] * part

    return along(along(image).T).T
