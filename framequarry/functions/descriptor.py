"""Column functions of descriptors and quantised maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(values: Column, most: float = 0.2) -> Column:
    """Unit length, components cut at ``most``, unit length again; a zero vector stays zero."""
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    unit = lambda x: F.transform(x, lambda v: v / F.when(norm(x) > 0, norm(x)).otherwise(1.0))
    return unit(F.transform(unit(values), lambda v: F.least(v, F.lit(most))))


def to_bytes(values: Column) -> Column:
    """Components as bytes: 512 v + 0.5 cut to 8 bits."""
    return F.transform(values, lambda v: (512 * v + 0.5).cast("int").bitwiseAND(F.lit(255)))


def quantise(n: Column) -> Column:
    """A component of [-1, 1] as 0..255."""
    return F.round((n + 1) / 2 * 255).cast("int")
