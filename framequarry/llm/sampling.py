"""Bounded samples of rows to fit models on, and numpy helpers for small linear models."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .workspace import fresh


def lowest_hash(ids: DataFrame, limit: int, seed: int = 0) -> DataFrame:
    """The ``limit`` rows whose first column hashes lowest: a uniform sample that does not depend on the partitions."""
    key = F.xxhash64(F.col(ids.columns[0]), F.lit(seed))
    return ids.orderBy(key, *[F.col(c) for c in ids.columns]).limit(limit)


def fold(id_: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last coefficient is the intercept (not shrunk)."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        gradient = x.T @ (weight * (y - p)) - shrink * beta
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(curve, gradient)
        beta += step * min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def first_rows(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows in ``order``, in two rounds.

    Every partition keeps its own first rows before anything moves (Spark pushes
    the rank below the exchange); groups of about root(partitions) of them do the
    same, so the last task sees ``limit`` rows of each group and not of each partition.
    """
    also = fresh(df, "near")
    groups = max(1, math.isqrt(df.rdd.getNumPartitions()))
    rank = F.row_number().over(W.partitionBy(also).orderBy(*order))
    kept = df.withColumn(also, F.spark_partition_id() % groups).withColumn(also + "rank", rank).filter(F.col(also + "rank") <= limit)
    return kept.drop(also, also + "rank").orderBy(*order).limit(limit)
