"""WARC archives: a Python data source that reads them, and a writer.

The source plans partitions of whole files, takes filters on the record type and
other header columns, parses each record's headers first, and neither inflates
nor copies the payload of a record that a filter excludes.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds

from .workspace import split_join

#: Column -> header.
HEADERS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "profile": "warc-profile", "content_type": "content-type",
}
SCHEMA = "file string, offset long, " + ", ".join(f"{c} string" for c in HEADERS) + ", content_length long, http_headers map<string,string>, payload binary"
#: Bytes of archive in a partition of the reader, unless one file is larger; bytes of a file of the writer, about; bytes of a batch.
PARTITION, FILE, BATCH = 64 << 20, 128 << 20, 8 << 20


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a local path, as any executor can resolve it."""
    if re.match(r"^\w[\w+.-]*:/", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


class _Window:
    """Reads a file through one buffered range."""

    def __init__(self, file: pa.NativeFile, size: int = 1 << 20):
        self.file, self.end, self.size = file, file.size(), size
        self.at, self.data = 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.at, self.data = at, self.file.read_at(min(max(n, self.size), max(0, self.end - at)), at)
        return self.data[at - self.at : at - self.at + n]


class _Plain:
    """The bytes of an uncompressed record."""

    def __init__(self, window: _Window, at: int):
        self.window, self.at, self.pos = window, at, at

    def read(self, n: int) -> bytes:
        out = self.window.get(self.pos, n)
        self.pos += len(out)
        return out

    def skip(self, n: int) -> None:
        self.pos += n

    def close(self) -> int:
        """Where the next record starts."""
        while (c := self.window.get(self.pos, 1)) in (b"\r", b"\n") and c:
            self.pos += 1
        return self.pos


class _Member:
    """The bytes of a record that is one gzip member; its extra field ``sl`` may tell the member's length."""

    def __init__(self, window: _Window, at: int):
        self.window, self.at = window, at
        head = window.get(at, 12)
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {at}")
        flags, pos, self.length = head[3], at + 10, 0
        if flags & 4:
            size = struct.unpack("<H", head[10:12])[0]
            extra = window.get(at + 12, size)
            pos = at + 12 + size
            while len(extra) >= 4:
                n = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and n == 8:
                    self.length = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + n :]
        for flag in (8, 16):
            if flags & flag:
                while window.get(pos, 1) not in (b"\0", b""):
                    pos += 1
                pos += 1
        self.pos = pos + 2 * bool(flags & 2)
        self.inflate, self.ready = zlib.decompressobj(-15), b""

    def read(self, n: int) -> bytes:
        parts = []
        while n > 0:
            if not self.ready:
                if self.inflate.eof:
                    break
                source = self.inflate.unconsumed_tail or self.window.get(self.pos, 1 << 14)
                if not self.inflate.unconsumed_tail:
                    self.pos += len(source)
                if not source:
                    break
                self.ready = self.inflate.decompress(source, max(n, 1 << 12))
                if self.inflate.eof:
                    self.pos -= len(self.inflate.unused_data)
            parts.append(self.ready[:n])
            n -= len(parts[-1])
            self.ready = self.ready[len(parts[-1]) :]
        return b"".join(parts)

    def skip(self, n: int) -> None:
        """Nothing is inflated: where the next member starts follows from ``sl``, else close() finds out."""

    def close(self) -> int:
        if self.length:
            return self.at + self.length
        while not self.inflate.eof:
            self.ready = b""
            if not self.read(1 << 16) and not self.inflate.eof:
                return self.window.end
        return self.pos + 8


def _lines(record, pending: bytes = b"") -> tuple[str, dict[str, str], bytes, int] | None:
    """First line, headers by lower-cased name, bytes read beyond them, and bytes of the header block; None at the end."""
    data = pending
    while (end := data.find(b"\r\n\r\n")) < 0:
        more = record.read(1024)
        if not more:
            return None
        data += more
    first, *rest = data[:end].decode("utf-8", "replace").split("\r\n")
    headers = {}
    for line in rest:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return first, headers, data[end + 4 :], end + 4


def read_records(path: str, wanted=None, payload: bool = True) -> Iterator[dict]:
    """The records of one file for which ``wanted(headers)`` holds; a record cut off at the end is left out."""
    where, at_path = open_path(path)
    with where.open_input_file(at_path) as file:
        window, at = _Window(file), 0
        while at < window.end:
            if not window.get(at, 1).strip(b"\r\n"):
                at += 1
                continue
            record = _Member(window, at) if window.get(at, 2) == b"\x1f\x8b" else _Plain(window, at)
            parsed = _lines(record)
            if parsed is None:
                return
            first, headers, body, _ = parsed
            if not first.startswith("WARC/"):
                raise ValueError(f"{path}: no WARC record at byte {at}")
            length = int(headers.get("content-length") or 0)
            row = {c: headers.get(h) for c, h in HEADERS.items()} | {"file": path, "offset": at, "content_length": length, "http_headers": None, "payload": None}
            if wanted is None or wanted(row):
                left = body[:length]
                if headers.get("content-type", "").replace(" ", "").startswith("application/http"):
                    while b"\r\n\r\n" not in left and len(left) < length:
                        more = record.read(min(1024, length - len(left)))
                        if not more:
                            return
                        left += more
                    head, _, left_body = left.partition(b"\r\n\r\n")
                    row["http_headers"] = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
                    used = min(length, len(head) + 4)
                else:
                    left_body, used = left, 0
                if payload:
                    missing = length - used - len(left_body)
                    rest = record.read(missing) if missing > 0 else b""
                    if len(rest) < missing:
                        return
                    row["payload"] = left_body + rest
                yield row
            if isinstance(record, _Plain):
                record.pos = at + parsed[3] + length
                if record.pos > window.end:
                    return
            at = record.close()


class _Files(ds.InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


class WarcReader(ds.DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters):
        """Takes =, in, starts with and (is not) null on header columns; Spark keeps the others."""
        for f in filters:
            inner = f.child if isinstance(f, ds.Not) else f
            if isinstance(inner, (ds.EqualTo, ds.In, ds.StringStartsWith, ds.IsNotNull, ds.IsNull)) and len(inner.attribute) == 1 and inner.attribute[0] in HEADERS:
                self.tests.append((inner.attribute[0], type(inner).__name__, getattr(inner, "value", None), f is not inner))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for column, kind, value, negated in self.tests:
            x = row[column]
            if kind == "IsNull" or kind == "IsNotNull":
                ok = (x is None) == (kind == "IsNull")
            elif x is None:
                return False
            else:
                ok = x == value if kind == "EqualTo" else x in value if kind == "In" else x.startswith(value)
            if ok == negated:
                return False
        return True

    def partitions(self):
        where, path = open_path(self.path)
        info = where.get_file_info(path)
        found = where.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else [info]
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else "file://" * (isinstance(where, fs.LocalFileSystem))
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path))
        groups, size = [[]], 0
        for name, n in files:
            if groups[-1] and size + n > PARTITION:
                groups.append([])
                size = 0
            groups[-1].append(prefix + name)
            size += n
        return [_Files(g) for g in groups]

    def read(self, partition):
        rows, size = [], 0
        for path in partition.files:
            for row in read_records(path, self.wanted, self.payload):
                rows.append(row)
                size += len(row["payload"] or b"") + 500
                if size > BATCH:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"offset": pa.int64(), "content_length": pa.int64(), "http_headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
    names = ["file", "offset", *HEADERS, "content_length", "http_headers", "payload"]
    column = lambda c: [list(r[c].items()) if c == "http_headers" and r[c] is not None else r[c] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(column(c), kinds.get(c, pa.string())) for c in names], names=names)


class WarcSource(ds.DataSource):
    """``spark.read.format("warc")``; options: path (a file or folder), payload (false: leave payloads null)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records below ``path``.  Filters on header columns reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def _member(data: bytes, level: int) -> bytes:
    """One gzip member with its own length in the extra field ``sl``."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    extra = b"sl" + struct.pack("<HII", 8, 12 + 12 + len(body) + 8, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{n}: {v}\r\n" for n, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _safe(uri: str) -> str:
    """A header value: control characters and spaces are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def _write(path: str, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = open_path(path)
        where.create_dir(folder, recursive=True)
        part, number, out, size, count, temp = TaskContext.get().partitionId(), 0, None, 0, 0, ""
        made: list[tuple[str, int, int]] = []

        def finish() -> None:
            out.close()
            name = f"{folder}/part-{part:06d}-{number:04d}.warc.gz"
            where.move(temp, name)
            made.append((name, count, size))

        for batch in batches:
            for id_, uri, payload, digest, refers, length in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    temp = f"{folder}/.{part}-{uuid.uuid4().hex}"
                    out, size, count = where.open_output_stream(temp), 0, 0
                    out.write(_member(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{part}/{number}')}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), level))
                payload = payload or b""
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
                headers = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", f"<{id_}>"), ("WARC-Date", date), ("WARC-Target-URI", _safe(uri)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                if refers is not None:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers}>")]
                data = _member(_record(headers, http + (payload if refers is None else b"")), level)
                out.write(data)
                size += len(data)
                count += 1
                if size > FILE:
                    finish()
                    out, number = None, number + 1
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], names=["file", "records", "bytes"])

    return run


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", shortest: int = 1000, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> list:
    """Archive every row as a record below ``path``; returns (file, records, bytes) of each file.

    Of rows with equal payloads of at least ``shortest`` bytes the one with the
    largest id is a response, the others are revisits that refer to it; all other
    rows are responses.  A file appears under its name only when it is complete,
    so a task that runs twice leaves no half or double file.

    Defined cases: a null payload is empty; a null uri becomes ``urn:page:<id>``;
    a null id is written as ``urn:page:none`` and is never the largest; rows that
    repeat the largest id are responses too; an empty table writes no file; other
    columns are ignored.
    """
    where, folder = open_path(path)
    where.create_dir(folder, recursive=True)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    long = F.octet_length("payload") >= shortest
    twice = rows.filter(long).groupBy("digest").agg(F.max("id").alias("winner"), F.count("*").alias("n")).filter("n > 1").select("digest", "winner")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    joined = split_join(rows, twice, "digest", "left")
    refers = F.when(F.col("winner").isNotNull() & long & ~F.col("id").eqNullSafe(F.col("winner")), urn(F.col("winner")))
    records = joined.select(urn(F.col("id")).alias("id"), F.coalesce("uri", urn(F.col("id"))).alias("uri"), F.when(refers.isNull(), F.col("payload")).otherwise(F.lit("").cast("binary")).alias("payload"), "digest", refers.alias("refers"), F.octet_length("payload").alias("size"))
    return records.mapInArrow(_write(path, date, level), "file string, records long, bytes long").collect()
