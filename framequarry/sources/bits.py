"""The bit-level depth codec and the table from sensor shifts to millimetres.

Fixed values of the bit layout (each value follows from the one before it):
  00             same
  11             one more
  10             one less
  01100          two less
  01101          two more
  010 + 5 bits   same, 5 to 36 times
  0111 + 11 bits this value
The value before the first is 0; bits after the last value are padding.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LARGEST, RUN = 2047, 36
_TOKEN = re.compile(r"00|11|10|0110([01])|010([01]{5})|0111([01]{11})")
_STEPS = {0: "00", 1: "11", -1: "10", 2: "01101", -2: "01100"}


def decode_shifts(data: bytes, n: int) -> np.ndarray:
    """``n`` values; ValueError where the bits don't give so many."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    text = (bits + 48).tobytes().decode("ascii")
    steps, times, absolute = [], [], []
    left, at = n, 0
    while left > 0:
        token = _TOKEN.match(text, at)
        if token is None:
            raise ValueError(f"{left} of {n} values are missing")
        two, run, value = token.groups()
        at = token.end()
        steps.append(0 if run or value else (4 * int(two) - 2 if two else int(token[0] == "11") - int(token[0] == "10")))
        times.append(5 + int(run, 2) if run else 1)
        absolute.append(int(value, 2) if value else -1)
        left -= times[-1]
    if not steps:
        return np.zeros(0, np.uint16)
    steps, absolute = np.array(steps), np.array(absolute)
    total = np.cumsum(steps)
    reset = np.maximum.accumulate(np.where(absolute >= 0, np.arange(len(steps)), -1))
    base = np.where(reset >= 0, absolute[reset] - total[reset], 0)
    return np.repeat((total + base) & 0xFFFF, times)[:n].astype(np.uint16)


def encode_shifts(values: np.ndarray) -> bytes:
    """The inverse of :func:`decode_shifts` for values up to LARGEST (jumps of more than two to greater ones are an error)."""
    values = np.asarray(values, np.int64).ravel()
    steps = np.diff(values, prepend=0)
    if len(values) and ((values < 0).any() or (values[np.abs(steps) > 2] > LARGEST).any()):
        raise ValueError(f"values from 0 to {LARGEST} can be written")
    parts = []
    first = np.flatnonzero(np.concatenate([[True], steps[1:] != steps[:-1]])) if len(steps) else np.zeros(0, int)
    for start, end in zip(first.tolist(), [*first[1:].tolist(), len(steps)]):
        step, count = int(steps[start]), end - start
        if step == 0:
            while count >= 5:
                some = min(RUN, count)
                parts.append("010" + format(some - 5, "05b"))
                count -= some
            parts.append("00" * count)
        elif abs(step) <= 2:
            parts.append(_STEPS[step] * count)
        else:
            parts.extend("0111" + format(int(v), "011b") for v in values[start:end])
    text = "".join(parts)
    return np.packbits(np.frombuffer(text.encode("ascii"), np.uint8) - 48).tobytes()


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def unpack_shifts(data: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if d is None or pd.isna(k) else decode_shifts(d, int(k)).tolist() for d, k in zip(data, n)], dtype=object)


@F.pandas_udf(T.BinaryType())
def pack_shifts(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else encode_shifts(np.asarray(x)))


def shift_table(numerator: float, offset: float, size: int = LARGEST + 1) -> np.ndarray:
    """Millimetres by shift for a structured-light camera: numerator / (offset - shift), rounded; 0 for shift 0 and from ``offset`` on."""
    shift = np.arange(size)
    with np.errstate(divide="ignore"):
        depth = np.rint(numerator / (offset - shift))
    return np.where((shift > 0) & (shift < offset) & (depth < 65536), depth, 0).astype(np.int32)


def shifts_to_metres(shifts: Column, table: np.ndarray) -> Column:
    """array<int> of shifts -> array<double> of metres: one lookup a value; null where the table has no depth."""
    metres = np.where(table > 0, table / 1000.0, np.nan)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def looked_up(values: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            found = metres[np.clip(np.asarray(x, np.int64), 0, len(metres) - 1)]
            return [None if np.isnan(v) else v for v in found.tolist()]

        return values.map(one)

    return looked_up(shifts)
