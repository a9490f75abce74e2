"""Least-squares rigid fits, and the greedy geometric filter of matches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOURCE, TARGET = ("sx", "sy", "sz"), ("tx", "ty", "tz")


def fit_rigid(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The 4 x 4 rigid transform that takes src nearest dst."""
    a, b = src.mean(0), dst.mean(0)
    return _rigid((dst - b).T @ (src - a), a, b)


def _rigid(covariance: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    u, _, v = np.linalg.svd(covariance)
    r = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ v)) or 1]) @ v
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, b - r @ a
    return out


def kabsch(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, transform (16 numbers), n: the rigid fit of each group of (sx, sy, sz) -> (tx, ty, tz).

    The group is reduced to 16 sums by ordinary aggregates; Python sees one row a
    group, whatever its size.
    """
    sums = [F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in (*SOURCE, *TARGET)], *[F.covar_pop(t, s).alias(f"c_{t}_{s}") for t in TARGET for s in SOURCE]]

    @F.pandas_udf("array<double>")
    def solve(means: pd.Series, cross: pd.Series) -> pd.Series:
        return pd.Series([_rigid(np.array(c, float).reshape(3, 3), np.array(m[:3], float), np.array(m[3:], float)).ravel().tolist() for m, c in zip(means, cross)])

    whole = points.dropna(subset=[*SOURCE, *TARGET]).groupBy(*keys).agg(*sums)
    return whole.select(*keys, solve(F.array(*[f"m_{c}" for c in (*SOURCE, *TARGET)]), F.array(*[f"c_{t}_{s}" for t in TARGET for s in SOURCE])).alias("transform"), "n")


def spread(points: DataFrame, keys: list[str], columns: tuple[str, str, str]) -> DataFrame:
    """keys, covariance (9 numbers) and condition: the ratio of its largest to its middle eigenvalue."""
    from framequarry.functions.se3 import symmetric_eigenvalues

    cells = [F.covar_pop(a, b) for a in columns for b in columns]
    out = points.groupBy(*keys).agg(F.array(*cells).alias("covariance")).withColumn("eigenvalues", symmetric_eigenvalues("covariance"))
    return out.withColumn("condition", F.when(F.col("eigenvalues")[1] > 1e-12, F.col("eigenvalues")[2] / F.col("eigenvalues")[1]))


def box_area(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, area of the box along the principal axes of the points; 0 if a side is below 1e-5."""
    w = points.groupBy(*keys).agg(F.var_pop(x).alias("xx"), F.covar_pop(x, y).alias("xy"), F.var_pop(y).alias("yy"))
    turn = w.withColumn("angle", 0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")))
    both = points.join(turn.select(*keys, "angle"), keys)
    a = F.cos("angle") * F.col(x) + F.sin("angle") * F.col(y)
    b = F.cos("angle") * F.col(y) - F.sin("angle") * F.col(x)
    sides = both.groupBy(*keys).agg((F.max(a) - F.min(a)).alias("long"), (F.max(b) - F.min(b)).alias("short"))
    return sides.select(*keys, F.when((F.col("long") < 1e-5) | (F.col("short") < 1e-5), 0.0).otherwise(F.col("long") * F.col("short")).alias("area"))


def greedy_inliers(dist: np.ndarray, src: np.ndarray, dst: np.ndarray, pix: np.ndarray, worst2: float, least: int, apart: float = 5.0, most: float = 100.0, kept_most: int = 25) -> tuple[list[int], np.ndarray | None]:
    """Matches in order of distance are added while the rigid fit of all stays within the error; (indices, transform).

    A match within ``apart`` pixels of a kept one in either image is skipped.
    From three matches on the fit is renewed; while the worst squared error
    exceeds ``worst2`` the worst match goes.  Fewer than ``least`` matches or a
    badly conditioned set (ratio of covariances' eigenvalues above ``most``) give none.
    """
    kept: list[int] = []
    for i in np.argsort(dist, kind="stable"):
        near = any(np.hypot(*(pix[i, :2] - pix[j, :2])) < apart or np.hypot(*(pix[i, 2:] - pix[j, 2:])) < apart for j in kept)
        if near or len(kept) >= kept_most:
            continue
        kept.append(int(i))
        while len(kept) >= 3:
            m = fit_rigid(src[kept], dst[kept])
            error = ((src[kept] @ m[:3, :3].T + m[:3, 3] - dst[kept]) ** 2).sum(1)
            if error.max() <= worst2:
                break
            kept.pop(int(error.argmax()))
    if len(kept) < max(3, least):
        return [], None
    for points in (src[kept], dst[kept]):
        values = np.linalg.eigvalsh(np.cov(points.T))
        if values[1] <= 1e-12 or values[2] / values[1] > most:
            return [], None
    return kept, fit_rigid(src[kept], dst[kept])


def filter_matches(matches: DataFrame, keys: list[str], worst2: float = 0.0004, least: int = 5) -> DataFrame:
    """keys, matches kept (ids in order) and transform of each pair of frames that passes.

    Needs match_id, dist, source and target points, and pixels u1, v1, u2, v2.  A
    pair holds at most the raw matches of two frames, a bounded group.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["dist", "match_id"])
        kept, m = greedy_inliers(rows.dist.to_numpy(), rows[list(SOURCE)].to_numpy(float), rows[list(TARGET)].to_numpy(float), rows[["u1", "v1", "u2", "v2"]].to_numpy(float), worst2, least)
        if m is None:
            return pd.DataFrame({c: [] for c in [*keys, "kept", "transform"]}, dtype=object)
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in keys}, "kept": [rows.match_id.iloc[kept].tolist()], "transform": [m.ravel().tolist()]})

    kinds = ", ".join(f"{k} {matches.schema[k].dataType.simpleString()}" for k in keys)
    return matches.groupBy(*keys).applyInPandas(one, f"{kinds}, kept array<long>, transform array<double>")
