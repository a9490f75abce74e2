"""A container of depth frames as a Python data source, and its depth codec.

Layout: magic, header length (u32), JSON header (width, height, camera, shift),
then for each frame its number (i64), 16 pose values (f64), the compressed
length (u32) and the depth: 16-bit steps between neighbours, deflated.  Last an
index: number and position (i64) of each frame, their count, the index's position,
magic; a container without it is read by one task.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAGIC, INDEX = b"FRAMES01", b"FRAMEIDX"
_HEAD = struct.calcsize("<q16dI")
#: Bytes that one task reads, about.
SPLIT = 64 << 20
SCHEMA = "file string, idx long, width int, height int, pose array<double>, depth array<double>"


def encode_depth(values: np.ndarray) -> bytes:
    """16-bit values as deflated steps."""
    values = values.astype(np.uint16)
    return zlib.compress(np.diff(values, prepend=np.uint16(0)).tobytes(), 6)


def decode_depth(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint16), dtype=np.uint16)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def unpack_depth(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else decode_depth(x).tolist())


@F.pandas_udf(T.BinaryType())
def pack_depth(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else encode_depth(np.asarray(x)))


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def container_files(path: str, suffix: str) -> list[str]:
    """A file, or the files of a folder that end in ``suffix``, in order of name."""
    where, name = open_path(path)
    info = where.get_file_info(name)
    if info.type != fs.FileType.Directory:
        return [path]
    prefix = path[: len(path) - len(name)]
    found = where.get_file_info(fs.FileSelector(name, recursive=True))
    return [prefix + x.path for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and x.path.endswith(suffix)]


class Bounds:
    """The range that pushed filters leave to one whole-number column."""

    def __init__(self):
        self.low, self.high = None, None

    def take(self, filters, column: str):
        """Keeps comparisons of ``column`` with a number; yields the others back to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == (column,) and isinstance(f, (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual)):
                if not isinstance(f, (ds.LessThan, ds.LessThanOrEqual)):
                    low = f.value + isinstance(f, ds.GreaterThan)
                    self.low = low if self.low is None else max(low, self.low)
                if not isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual)):
                    high = f.value - isinstance(f, ds.LessThan)
                    self.high = high if self.high is None else min(high, self.high)
            else:
                yield f

    def of(self, low: int, high: int) -> tuple[int, int]:
        return (low if self.low is None else max(low, self.low)), (high if self.high is None else min(high, self.high))


def write_container(path: str, width: int, height: int, frames: Iterable[tuple[int, np.ndarray, np.ndarray | None]], shift: float = 1000.0, camera: dict | None = None) -> None:
    """Frames are (number, depth in metres with NaN for missing, 4 x 4 pose or None); the index of frames follows them."""
    where, name = open_path(path)
    header = json.dumps({"width": width, "height": height, "shift": shift, "camera": camera or {}}).encode()
    with where.open_output_stream(name) as out:
        out.write(MAGIC + struct.pack("<I", len(header)) + header)
        at, index = 12 + len(header), []
        for idx, depth, pose in frames:
            raw = np.nan_to_num(np.round(np.asarray(depth, float) * shift), nan=0.0).clip(0, 65535)
            body = encode_depth(raw.ravel())
            cells = np.full(16, -np.inf) if pose is None else np.asarray(pose, float).ravel()
            out.write(struct.pack("<q16dI", idx, *cells, len(body)) + body)
            index.append((idx, at))
            at += _HEAD + len(body)
        out.write(np.array(index, "<i8").tobytes() + struct.pack("<qq", len(index), at) + INDEX)


def read_index(file, size: int) -> np.ndarray | None:
    """(frame number, position) of every frame, and the end of the last, from a container's last bytes; None where it has no index."""
    tail = 16 + len(INDEX)
    if size < tail:
        return None
    file.seek(size - tail)
    found = file.read(tail)
    if found[16:] != INDEX:
        return None
    n, at = struct.unpack("<qq", found[:16])
    file.seek(at)
    return np.concatenate([np.frombuffer(file.read(16 * n), "<i8").reshape(n, 2), [[-1, at]]])


class _Range(ds.InputPartition):
    """Bytes start .. end - 1 of a container: whole frames (end None: to the end of the file)."""

    def __init__(self, path: str, header: dict, start: int, end: int | None):
        super().__init__(path)
        self.path, self.header, self.start, self.end = path, header, start, end


class FrameReader(ds.DataSourceReader):
    """Byte ranges of about ``split`` bytes by the container's index; filters on ``idx`` skip the depth of other frames, and whole ranges."""

    def __init__(self, path: str, split: int = SPLIT):
        self.path, self.split, self.bounds = path, split, Bounds()

    def pushFilters(self, filters):
        return self.bounds.take(filters, "idx")

    def partitions(self):
        return [r for path in container_files(self.path, ".frames") for r in self._ranges(path)] or [_Range("", {}, 0, 0)]

    def _ranges(self, path: str) -> Iterator[_Range]:
        where, name = open_path(path)
        with where.open_input_file(name) as file:
            if file.read(8) != MAGIC:
                raise ValueError(f"{path} is no frame container")
            size = struct.unpack("<I", file.read(4))[0]
            header = json.loads(file.read(size))
            index = read_index(file, file.size())
        if index is None:
            yield _Range(path, header, 12 + size, None)
            return
        low, high = self.bounds.of(np.iinfo(np.int64).min, np.iinfo(np.int64).max)
        numbers, places = index[:-1, 0], index[:, 1]
        part = (places[:-1] - places[0]) // max(1, self.split)
        for i in np.unique(part):
            mine = np.flatnonzero(part == i)
            if ((numbers[mine] >= low) & (numbers[mine] <= high)).any():
                yield _Range(path, header, int(places[mine[0]]), int(places[mine[-1] + 1]))

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition.end is not None and partition.start >= partition.end:
            return
        low, high = self.bounds.of(np.iinfo(np.int64).min, np.iinfo(np.int64).max)
        where, name = open_path(partition.path)
        h = partition.header
        with where.open_input_file(name) as file:
            file.seek(partition.start)
            while (partition.end is None or file.tell() < partition.end) and len(head := file.read(_HEAD)) == _HEAD:
                idx, *pose, length = struct.unpack("<q16dI", head)
                if idx < low or idx > high:
                    file.seek(file.tell() + length)
                    continue
                raw = decode_depth(file.read(length))
                depth = pa.array(raw / h["shift"], mask=raw == 0)
                yield pa.RecordBatch.from_arrays([
                    pa.array([partition.path]), pa.array([idx]), pa.array([h["width"]], pa.int32()), pa.array([h["height"]], pa.int32()),
                    pa.array([pose if np.isfinite(pose).all() else None], pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array([0, len(depth)], pa.int32()), depth),
                ], names=["file", "idx", "width", "height", "pose", "depth"])


class FrameSource(ds.DataSource):
    """``spark.read.format("frames").option("path", ...)``: a container or a folder of them."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options["path"], int(self.options.get("split", SPLIT)))


def read_frames(spark: SparkSession, path: str, split: int = SPLIT):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)
    return spark.read.format("frames").option("path", path).option("split", split).load()


def pixels(frames):
    """frame, u, v, depth: one row for each pixel that is present."""
    each = frames.select(F.col("idx").alias("frame"), "width", F.posexplode("depth").alias("p", "depth")).filter("depth is not null")
    return each.select("frame", (F.col("p") % F.col("width")).cast("int").alias("u"), F.floor(F.col("p") / F.col("width")).cast("int").alias("v"), "depth")
