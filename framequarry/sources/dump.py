"""A dump of uncompressed frames, read in byte ranges.

Layout: magic, header length (u32), JSON header (frames, width, height,
color_width, color_height, has_color, camera), then all depth images (32-bit floats,
minus infinity for missing) and, if there are colours, all colour images (RGBX).
A frame's place follows from its number, so one file is as many tasks as its size
asks for; frames that a filter on ``idx`` excludes and columns that the given
schema leaves out are never read.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from .frames import Bounds, container_files, open_path

MAGIC = b"DUMP0001"
SCHEMA = "file string, idx long, width int, height int, depth array<float>, color binary, camera string"
#: Bytes that one task reads, about.
SPLIT = 64 << 20


def write_dump(path: str, depths: Iterable[np.ndarray], colors: Iterable[np.ndarray] | None = None, camera: dict | None = None) -> None:
    """Depth images (height, width) in metres with NaN for missing; colour images (height, width, 4), one for each or none at all."""
    depths, colors = list(depths), list(() if colors is None else colors)
    if colors and len(colors) != len(depths):
        raise ValueError(f"{len(depths)} depth and {len(colors)} colour images")
    height, width = depths[0].shape if depths else (0, 0)
    color_height, color_width = colors[0].shape[:2] if colors else (0, 0)
    header = {"frames": len(depths), "width": width, "height": height, "color_width": color_width, "color_height": color_height, "has_color": bool(colors), "camera": camera or {}}
    body = json.dumps(header).encode()
    where, name = open_path(path)
    with where.open_output_stream(name) as out:
        out.write(MAGIC + struct.pack("<I", len(body)) + body)
        for d in depths:
            out.write(np.where(np.isfinite(d), d, -np.inf).astype("<f4").tobytes())
        for c in colors:
            out.write(np.asarray(c, np.uint8).tobytes())


def read_header(path: str) -> tuple[dict, int]:
    """The header and where the first image starts; ValueError if the file is no dump or is shorter than its header says."""
    where, name = open_path(path)
    with where.open_input_file(name) as file:
        if file.read(8) != MAGIC:
            raise ValueError(f"{path} is no dump of frames")
        size = struct.unpack("<I", file.read(4))[0]
        header = json.loads(file.read(size))
        color = 4 * header["color_width"] * header["color_height"] if header["has_color"] else 0
        if file.size() < 12 + size + header["frames"] * (4 * header["width"] * header["height"] + color):
            raise ValueError(f"{path} ends before its {header['frames']} frames do")
        return header, 12 + size


class Range(ds.InputPartition):
    """Frames first .. last - 1 of a file."""

    def __init__(self, path: str, header: dict, start: int, first: int, last: int):
        super().__init__(path)
        self.path, self.header, self.start, self.first, self.last = path, header, start, first, last


class DumpReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.columns = options["path"], [f.name for f in schema.fields]
        self.kinds = {"file": pa.string(), "idx": pa.int64(), "width": pa.int32(), "height": pa.int32(), "depth": pa.list_(pa.float32()), "color": pa.binary(), "camera": pa.string()}
        if unknown := set(self.columns) - set(self.kinds):
            raise ValueError(f"a dump has no columns {sorted(unknown)}")
        self.split = int(options.get("split", SPLIT))
        self.bounds = Bounds()

    def pushFilters(self, filters):
        return self.bounds.take(filters, "idx")

    def partitions(self):
        found = []
        for path in container_files(self.path, ".dump"):
            header, start = read_header(path)
            size = 4 * header["width"] * header["height"] * ("depth" in self.columns) + 4 * header["color_width"] * header["color_height"] * ("color" in self.columns)
            step = max(1, self.split // max(1, size))
            low, high = self.bounds.of(0, header["frames"] - 1)
            found += [Range(path, header, start, i, min(i + step, high + 1)) for i in range(low, high + 1, step)]
        return found or [Range("", {}, 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.first >= part.last:
            return
        h = part.header
        pixels, color = h["width"] * h["height"], 4 * h["color_width"] * h["color_height"]
        where, name = open_path(part.path)
        schema = pa.schema([(c, self.kinds[c]) for c in self.columns])
        with where.open_input_file(name) as file:
            for idx in range(part.first, part.last):
                row = {"file": [part.path], "idx": [idx], "width": [h["width"]], "height": [h["height"]], "camera": [json.dumps(h["camera"])]}
                if "depth" in self.columns:
                    file.seek(part.start + 4 * pixels * idx)
                    depth = np.frombuffer(file.read(4 * pixels), "<f4")
                    row["depth"] = pa.ListArray.from_arrays(pa.array([0, pixels], pa.int32()), pa.array(depth, mask=~np.isfinite(depth)))
                if "color" in self.columns:
                    file.seek(part.start + 4 * pixels * h["frames"] + color * idx)
                    row["color"] = [file.read(color) if h["has_color"] else None]
                yield pa.RecordBatch.from_pydict({c: row[c] for c in self.columns}, schema=schema)


class DumpSource(ds.DataSource):
    """``spark.read.format("frame_dump").option("path", ...)``: a dump or a folder of them; a schema of fewer columns reads only those."""

    @classmethod
    def name(cls) -> str:
        return "frame_dump"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DumpReader:
        return DumpReader(self.options, schema)


def read_dump(spark: SparkSession, path: str, columns: list[str] | None = None, split: int = SPLIT) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DumpSource)
    kinds = {f.name: f for f in T._parse_datatype_string(SCHEMA).fields}
    reader = spark.read.format("frame_dump").option("path", path).option("split", split)
    return (reader.schema(T.StructType([kinds[c] for c in columns])) if columns else reader).load()
