"""Rigid transforms as numpy batches, and the Arrow functions around them.

Poses are six numbers, rotation first; matrices are 16 numbers, row-major.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hat(w: np.ndarray) -> np.ndarray:
    """(n, 3) -> (n, 3, 3) cross-product matrices."""
    out = np.zeros((len(w), 3, 3))
    out[:, 0, 1], out[:, 0, 2], out[:, 1, 2] = -w[:, 2], w[:, 1], -w[:, 0]
    return out - out.transpose(0, 2, 1)


def _series(angle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sin(a)/a, (1-cos a)/a^2, (a-sin a)/a^3, by their series near 0."""
    small = angle < 1e-4
    a = np.where(small, 1.0, angle)
    square = angle * angle
    return np.where(small, 1 - square / 6, np.sin(a) / a), np.where(small, 0.5 - square / 24, (1 - np.cos(a)) / a**2), np.where(small, 1 / 6 - square / 120, (a - np.sin(a)) / a**3)


def exp_so3(w: np.ndarray) -> np.ndarray:
    a, b, _ = _series(np.linalg.norm(w, axis=1))
    k = hat(w)
    return np.eye(3) + a[:, None, None] * k + b[:, None, None] * (k @ k)


def log_so3(r: np.ndarray) -> np.ndarray:
    """Rotation vectors; near half a turn the axis comes from the symmetric part."""
    cosine = np.clip((np.trace(r, axis1=1, axis2=2) - 1) / 2, -1, 1)
    skew = np.stack([r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1]], 1) / 2
    sine = np.linalg.norm(skew, axis=1)
    angle = np.arctan2(sine, cosine)
    out = skew * np.where(sine > 1e-7, angle / np.maximum(sine, 1e-300), 1.0)[:, None]
    for i in np.flatnonzero((sine <= 1e-3) & (cosine < 0)):
        values, vectors = np.linalg.eigh((r[i] + r[i].T) / 2)
        axis = vectors[:, -1]
        out[i] = axis * angle[i] * (-1 if axis @ skew[i] < 0 else 1)
    return out


def exp_se3(pose: np.ndarray) -> np.ndarray:
    """(n, 6) -> (n, 4, 4)."""
    w, t = pose[:, :3], pose[:, 3:]
    _, b, c = _series(np.linalg.norm(w, axis=1))
    k = hat(w)
    out = np.tile(np.eye(4), (len(pose), 1, 1))
    out[:, :3, :3] = exp_so3(w)
    v = np.eye(3) + b[:, None, None] * k + c[:, None, None] * (k @ k)
    out[:, :3, 3] = np.einsum("nij,nj->ni", v, t)
    return out


def log_se3(m: np.ndarray) -> np.ndarray:
    w = log_so3(m[:, :3, :3])
    _, b, c = _series(np.linalg.norm(w, axis=1))
    k = hat(w)
    v = np.eye(3) + b[:, None, None] * k + c[:, None, None] * (k @ k)
    return np.concatenate([w, np.linalg.solve(v, m[:, :3, 3:])[..., 0]], 1) if len(m) else np.zeros((0, 6))


def update(pose: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """exp(delta) applied on the left of exp(pose)."""
    return log_se3(exp_se3(delta) @ exp_se3(pose))


def _each(values: pd.Series, shape: tuple[int, ...], f) -> pd.Series:
    """``f`` over the rows that are not null."""
    some = values.notna().to_numpy()
    found = iter(f(np.stack([np.asarray(v, float) for v in values[some]]).reshape(-1, *shape)) if some.any() else ())
    return pd.Series([next(found).ravel().tolist() if ok else None for ok in some], index=values.index, dtype=object)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def matrix_to_pose(m: pd.Series) -> pd.Series:
    return _each(m, (4, 4), log_se3)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def pose_to_matrix(p: pd.Series) -> pd.Series:
    return _each(p, (6,), exp_se3)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def symmetric_eigenvalues(m: pd.Series) -> pd.Series:
    """Ascending eigenvalues of symmetric 3 x 3 matrices."""
    return _each(m, (3, 3), np.linalg.eigvalsh)
