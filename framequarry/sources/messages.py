"""A stream of recorded sensor messages: frames, motion events and others.

A recorder writes files of messages into a folder, under names in order of time, and
renames each to ``*.msgs`` once it is whole.  A file is a magic and then messages:
kind (u8), number (i64), length (u32), payload.  A camera frame's payload is a JSON
header with its length (u32), deflated 16-bit shifts, and RGB bytes.

The offset is the name of the last file taken; a trigger takes up to ``maxFiles``.
Where a query starts again, its checkpoint says which files are done, and files are
never taken in parts, so every message comes once.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from .frames import container_files, open_path

MAGIC = b"MSGS0001"
#: What a message is.
KINDS = {1: "camera", 2: "motion", 3: "control"}
SCHEMA = "file string, seq long, kind string, width int, height int, shifts array<int>, color binary, calibration string, payload binary"
_HEAD = struct.Struct("<BqI")
_FIELDS = pa.schema([
    ("file", pa.string()), ("seq", pa.int64()), ("kind", pa.string()), ("width", pa.int32()), ("height", pa.int32()),
    ("shifts", pa.list_(pa.int32())), ("color", pa.binary()), ("calibration", pa.string()), ("payload", pa.binary()),
])


def camera_payload(shifts: np.ndarray | None, color: np.ndarray | None, calibration: dict) -> bytes:
    """Shifts (height, width) and RGB (height, width, 3); either may be missing."""
    depth = b"" if shifts is None else zlib.compress(np.asarray(shifts, "<u2").tobytes())
    rgb = b"" if color is None else np.asarray(color, np.uint8).tobytes()
    height, width = (0, 0) if shifts is None else shifts.shape
    head = json.dumps({"width": width, "height": height, "depth": len(depth), "color": len(rgb), "calibration": calibration}, sort_keys=True).encode()
    return struct.pack("<I", len(head)) + head + depth + rgb


def write_messages(path: str, messages: Iterable[tuple[int, int, bytes]]) -> None:
    """Messages are (kind, number, payload); the file appears under its name once it is whole."""
    where, name = open_path(path)
    with where.open_output_stream(name + ".part") as out:
        out.write(MAGIC)
        for kind, seq, payload in messages:
            out.write(_HEAD.pack(kind, seq, len(payload)) + payload)
    where.move(name + ".part", name)


class _Camera:
    def __init__(self, payload: bytes):
        size = struct.unpack("<I", payload[:4])[0]
        head = json.loads(payload[4 : 4 + size])
        self.width, self.height, self.calibration = head["width"], head["height"], json.dumps(head["calibration"], sort_keys=True)
        at = 4 + size
        depth, color = payload[at : at + head["depth"]], payload[at + head["depth"] : at + head["depth"] + head["color"]]
        self.shifts = np.frombuffer(zlib.decompress(depth), "<u2").astype(np.int32) if depth else None
        self.color = color or None


class _Whole(ds.InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _messages(path: str) -> Iterator[pa.RecordBatch]:
    where, name = open_path(path)
    with where.open_input_file(name) as file:
        if file.read(8) != MAGIC:
            raise ValueError(f"{path} holds no messages")
        while head := file.read(_HEAD.size):
            kind, seq, length = _HEAD.unpack(head)
            payload = file.read(length)
            if len(payload) != length:
                raise ValueError(f"{path} ends inside message {seq}")
            row = {"file": path, "seq": seq, "kind": KINDS.get(kind, "other"), "width": None, "height": None, "shifts": None, "color": None, "calibration": None, "payload": None}
            if kind == 1:
                c = _Camera(payload)
                row |= {"width": c.width, "height": c.height, "shifts": c.shifts, "color": c.color, "calibration": c.calibration}
            else:
                row["payload"] = payload
            yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _FIELDS], schema=_FIELDS)


class MessageReader(ds.DataSourceReader):
    """The folder's files as a bounded table, a partition each."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_Whole(p) for p in container_files(self.path, ".msgs")] or [_Whole("")]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        return _messages(partition.path) if partition.path else iter(())


class MessageStreamReader(ds.DataSourceStreamReader):
    """Files in order of name, ``most`` a trigger."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most
        self.taken: str | None = None  # the end of the last batch that Spark planned or committed
        self.offered: str | None = None

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        """Up to ``most`` files past what is taken.

        Spark doesn't tell a source where a query stands when it starts again, so the
        first batch after a start takes all there is; later ones keep to ``most``.
        """
        names = container_files(self.path, ".msgs")
        if self.offered is None or self.most <= 0:
            self.offered = max([self.offered or "", *names])
        elif self.taken == self.offered:  # what was offered is planned
            later = [n for n in names if n > self.offered]
            self.offered = later[min(len(later), self.most) - 1] if later else self.offered
        return {"last": self.offered}

    def partitions(self, start: dict, end: dict):
        self.taken = max(self.taken or "", end["last"])
        return [_Whole(p) for p in container_files(self.path, ".msgs") if start["last"] < p <= end["last"]]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        return _messages(partition.path)

    def commit(self, end: dict) -> None:
        self.taken = max(self.taken or "", end["last"])


class MessageSource(ds.DataSource):
    """``format("sensor_messages")`` with ``path`` and, for streams, ``maxFiles``."""

    @classmethod
    def name(cls) -> str:
        return "sensor_messages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MessageReader:
        return MessageReader(self.options["path"])

    def streamReader(self, schema) -> MessageStreamReader:
        return MessageStreamReader(self.options["path"], int(self.options.get("maxFiles", "16")))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(MessageSource)
    return spark.read.format("sensor_messages").option("path", path).load()


def stream_messages(spark: SparkSession, path: str, most: int = 16) -> DataFrame:
    spark.dataSource.register(MessageSource)
    return spark.readStream.format("sensor_messages").option("path", path).option("maxFiles", most).load()


def camera_frames(messages: DataFrame, table: np.ndarray) -> DataFrame:
    """file, seq, width, height, depth (metres, null for none), color (RGBX): camera messages that have both images."""
    from .bits import shifts_to_metres

    @F.pandas_udf("binary")
    def padded(color):
        def one(c):
            rgb = np.frombuffer(c, np.uint8).reshape(-1, 3)
            return np.column_stack([rgb, np.full(len(rgb), 255, np.uint8)]).tobytes()

        return color.map(lambda c: None if c is None else one(c))

    both = messages.filter((F.col("kind") == "camera") & F.col("shifts").isNotNull() & F.col("color").isNotNull())
    return both.select("file", "seq", "width", "height", shifts_to_metres(F.col("shifts"), table).alias("depth"), padded("color").alias("color"))


def calibration(messages: DataFrame) -> DataFrame:
    """The calibration of the first camera message that has both images: one row (null if there is none)."""
    both = (F.col("kind") == "camera") & F.col("shifts").isNotNull() & F.col("color").isNotNull()
    return messages.agg(F.min_by(F.when(both, F.col("calibration")), F.when(both, F.struct("file", "seq"))).alias("calibration"))


def recorded(messages: DataFrame, key: str | None = None) -> DataFrame:
    """Camera messages between a ``start`` and the next ``stop`` control message, in order of (file, seq), for each ``key`` (none: all)."""
    control = F.when(F.col("kind") == "control", F.col("payload").cast("string"))
    order = W.partitionBy(*([key] if key else [])).orderBy("file", "seq")
    known = messages.withColumn("recording", F.last(F.when(control.isin("start", "stop"), control), ignorenulls=True).over(order))
    return known.filter((F.col("recording") == "start") & (F.col("kind") == "camera")).drop("recording")
