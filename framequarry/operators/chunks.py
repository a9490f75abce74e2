"""Windows over ordered frames: overlapping count windows, as-of lookups, one-dimensional stencils."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def numbered(rows: DataFrame, key: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """Rows of each key numbered from 0 in a total order."""
    return rows.withColumn(name, (F.row_number().over(W.partitionBy(*key).orderBy(*order)) - 1).cast("long"))


def overlapping_chunks(rows: DataFrame, n: int, idx: str = "idx", chunk: str = "chunk", slot: str = "slot") -> DataFrame:
    """Count windows of n + 1 rows that slide by n: the first row of a window is also the last of the one before."""
    own = rows.withColumn(chunk, F.floor(F.col(idx) / n).cast("long")).withColumn(slot, (F.col(idx) % n).cast("int"))
    shared = own.filter((F.col(slot) == 0) & (F.col(idx) > 0)).withColumn(chunk, F.col(chunk) - 1).withColumn(slot, F.lit(n))
    return own.unionByName(shared)


def closes(idx: Column, n: int) -> Column:
    """Whether a row closes a window."""
    return (idx >= n) & (idx % n == 0)


def last_before(rows: DataFrame, key: list[str], order: list[str], accept: Column, value: Column, name: str = "previous") -> DataFrame:
    """As-of join within one table: the value of the newest earlier row of the key for which ``accept`` holds."""
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(accept, value), ignorenulls=True).over(w))


def prefix_sum(rows: DataFrame, key: list[str], order: list[str], value: Column, name: str = "total") -> DataFrame:
    return rows.withColumn(name, F.sum(value).over(W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def smooth(rows: DataFrame, key: list[str], order: list[str], value: str, sigma: float, spread: float | None = None, name: str = "smooth") -> DataFrame:
    """Gaussian mean over ceil(2 sigma) neighbours; with ``spread``, of those whose value is within it of the centre.

    Null neighbours have no weight; a null centre stays null.  Built from lag and
    lead over one sort.
    """
    w = W.partitionBy(*key).orderBy(*order)
    centre, radius = F.col(value), math.ceil(2 * sigma)
    up, down = F.lit(0.0), F.lit(0.0)
    for d in range(-radius, radius + 1):
        v = F.lag(value, d).over(w) if d > 0 else F.lead(value, -d).over(w) if d < 0 else centre
        g = F.lit(math.exp(-d * d / (2 * sigma * sigma)))
        use = v.isNotNull() if spread is None else F.coalesce(F.abs(v - centre) < spread, F.lit(False))
        up, down = up + F.when(use, g * v).otherwise(0.0), down + F.when(use, g).otherwise(0.0)
    return rows.withColumn(name, F.when(centre.isNotNull() & (down > 0), up / down))


def derivative(rows: DataFrame, key: list[str], order: list[str], value: str, name: str = "slope") -> DataFrame:
    """Half the difference of both neighbours; null at the ends and next to nulls."""
    w = W.partitionBy(*key).orderBy(*order)
    return rows.withColumn(name, (F.lead(value).over(w) - F.lag(value).over(w)) / 2)


def thin_levels(levels: DataFrame, level: str, count: str, wanted: int) -> DataFrame:
    """Drop finest levels while those above still hold more than ``wanted``; the table is one row a level."""
    coarser = F.sum(count).over(W.orderBy(F.desc(level)).rowsBetween(W.unboundedPreceding, -1))
    return levels.withColumn("_coarser", F.coalesce(coarser, F.lit(0))).filter(F.col("_coarser") <= wanted).drop("_coarser")
