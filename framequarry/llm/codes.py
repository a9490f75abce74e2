"""Vector compression: a code of one byte for each of several parts of a vector.

Vectors of integers are cut into equal consecutive parts; every part position has
a codebook of up to 256 entries, and a vector's code names the nearest entry of
each.  The entries of a position stand in a ball tree.  A query part descends into
the ball it is nearest to and then into every ball that may hold an entry at most
as far as the best one known; radii are rounded up and bounds down, balls at
exactly the best distance are visited too, and whole-number distances decide, so
the result is that of comparing every entry, ties to the lower index included.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import first_rows
from .workspace import cut, fresh

#: Entries that one leaf of a tree holds.
LEAF = 16
#: Relative room for the rounding of square roots and products in double precision.
ROOM = 2.0**-48
#: Integers beyond this count as not finite: squared distances of 4096 components stay below 2 ** 63.
LARGEST = 2**24
_LAST = np.iinfo(np.int64).max


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all rows of ``y``, exact whole numbers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 4 * x.shape[1] * most * most < 2**53:  # every product and sum is exact in double precision
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in y], axis=1)


@dataclass(frozen=True)
class Ball:
    centre: np.ndarray
    radius: float
    members: np.ndarray
    inner: tuple[Ball, Ball] | None


class BallTree:
    """Nearest entry of a codebook by branch and bound."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._ball(np.arange(len(entries))) if len(entries) else None

    def _ball(self, members: np.ndarray) -> Ball:
        points = self.entries[members]
        centre = np.floor(points.mean(0)).astype(np.int64)
        radius = float(np.sqrt(float(squares(points, centre[None]).max()))) * (1 + ROOM)
        inner = None
        if len(members) > LEAF and radius > 0:
            order = np.argsort(points[:, np.argmax(points.max(0) - points.min(0))], kind="stable")
            half = len(order) // 2
            inner = (self._ball(np.sort(members[order[:half]])), self._ball(np.sort(members[order[half:]])))
        return Ball(centre, radius, members, inner)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each row's nearest entry."""
        best, who = np.full(len(x), _LAST), np.full(len(x), len(self.entries))
        if len(x):
            self._visit(self.root, np.arange(len(x)), np.zeros(len(x)), x, best, who)
        return who, best

    def _visit(self, ball: Ball, rows: np.ndarray, least: np.ndarray, x: np.ndarray, best: np.ndarray, who: np.ndarray) -> None:
        """``least``: a lower bound of each row's distance to the ball."""
        rows = rows[least * least * (1 - ROOM) <= best[rows].astype(np.float64) * (1 + ROOM)]
        if not len(rows):
            return
        if ball.inner is None:
            far = squares(x[rows], self.entries[ball.members])
            at = far.argmin(1)  # the first of equals, and members ascend
            d, entry = far[np.arange(len(rows)), at], ball.members[at]
            better = (d < best[rows]) | ((d == best[rows]) & (entry < who[rows]))
            best[rows[better]], who[rows[better]] = d[better], entry[better]
            return
        far = np.sqrt(squares(x[rows], np.stack([b.centre for b in ball.inner])).astype(np.float64)) * (1 - ROOM)
        bounds = np.maximum(far - np.array([b.radius for b in ball.inner]), 0)
        first = far[:, 0] <= far[:, 1]
        for side, near in ((0, first), (1, ~first), (1, first), (0, ~first)):
            self._visit(ball.inner[side], rows[near], bounds[near, side], x, best, who)


@dataclass(frozen=True)
class Codebooks:
    """Entries by part position, each an array of (entry, component)."""

    books: tuple[np.ndarray, ...]

    def sha256(self) -> str:
        """Of the entries' decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()

    def searchers(self) -> list[BallTree]:
        return [BallTree(b) for b in self.books]

    def decode(self, codes: list[str]) -> np.ndarray:
        """The vectors that the codes stand for."""
        at = np.array([list(bytes.fromhex(c)) for c in codes]).reshape(len(codes), len(self.books))
        return np.concatenate([b[at[:, i]] for i, b in enumerate(self.books)], axis=1)


def _numbers(batch: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat doubles (null: NaN), where each list starts and ends."""
    lists = batch.cast(pa.large_list(pa.float64()))
    bounds = lists.offsets.to_numpy()
    starts, ends = bounds[:-1], bounds[1:]
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    missing = lists.is_null().to_numpy(zero_copy_only=False)
    return flat, starts, np.where(missing, starts, ends)


def integers(vectors: DataFrame, id_col: str, vector_col: str, extra: list[Column], parts: int, scale: int) -> DataFrame:
    """``id``, ``extra``, ``n``, ``packed``: floor(scale * x) of every usable vector as 32-bit integers."""
    slim = vectors.select(F.col(id_col).alias("id"), *extra, F.col(vector_col).alias("packed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts, ends = _numbers(batch.column(batch.num_columns - 1))
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(flat * scale)
                good = np.abs(whole) <= LARGEST
            bad = np.concatenate([[0], np.cumsum(~good)])
            keep = np.flatnonzero((ends > starts) & ((ends - starts) % parts == 0) & (bad[ends] == bad[starts]))
            whole = np.where(good, whole, 0).astype(np.int32)
            packed = pa.array([whole[s:e].tobytes() for s, e in zip(starts[keep], ends[keep])], pa.binary())
            rows = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(ends[keep] - starts[keep], pa.int64()), packed], names=[*rows.schema.names[:-1], "n", "packed"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{kinds}, n long, packed binary")


def _unpack(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, dims).astype(np.int64)


def _sums(books: Codebooks, dims: int):
    """Batches of packed -> for each entry that is used: part, entry, how many, sums of the components."""
    width = dims // len(books.books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.searchers()
        counts = [np.zeros(len(b), np.int64) for b in books.books]
        totals = [np.zeros(b.shape, np.int64) for b in books.books]
        for batch in batches:
            x = _unpack(batch.column(0), dims)
            for i, tree in enumerate(trees):
                part = x[:, i * width : (i + 1) * width]
                at, _ = tree.nearest(part)
                order = np.argsort(at, kind="stable")
                used, first = np.unique(at[order], return_index=True)
                if len(used):
                    totals[i][used] += np.add.reduceat(part[order], first, axis=0)
                    counts[i] += np.bincount(at, minlength=len(counts[i]))
        for i, (n, total) in enumerate(zip(counts, totals)):
            used = np.flatnonzero(n)
            columns = [pa.array(np.full(len(used), i, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used]), *[pa.array(total[used, j]) for j in range(width)]]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *[f"s{j}" for j in range(width)]])

    return run, "part int, entry int, n long" + "".join(f", s{j} long" for j in range(width))


def train_codebooks(packed: DataFrame, dims: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks:
    """Codebooks from the ``entries`` rows of least id (nulls last, equal ids by content), after ``rounds`` of assigning and averaging over all rows.

    Each task returns one row of sums for each entry at most; they are added by
    entry in Spark, so the driver sees parts x entries rows, whatever the input.
    """
    width = dims // parts
    firsts = first_rows(packed.select("id", "packed"), [F.col("id").asc_nulls_last(), F.col("packed")], entries)
    x = np.array([np.frombuffer(r.packed, np.int32) for r in firsts.collect()], np.int64).reshape(-1, dims)
    books = Codebooks(tuple(x[:, i * width : (i + 1) * width] for i in range(parts)))
    for _ in range(rounds if len(x) else 0):
        run, kinds = _sums(books, dims)
        added = packed.select("packed").mapInArrow(run, kinds).groupBy("part", "entry").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), *[F.sum(F.col(f"s{j}").cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)])
        new = [b.copy() for b in books.books]
        for r in added.collect():
            new[r.part][r.entry] = [int(r[f"s{j}"]) // int(r.n) for j in range(width)]
        books = Codebooks(tuple(new))
    return books


def _codes(books: Codebooks, dims: int):
    width = dims // max(1, len(books.books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.searchers()
        for batch in batches:
            x = _unpack(batch.column(batch.num_columns - 1), dims)
            found = [tree.nearest(x[:, i * width : (i + 1) * width]) for i, tree in enumerate(trees)]
            text = np.stack([at for at, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            step = 2 * len(trees)
            codes = pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string())
            error = pa.array(np.sum([d for _, d in found], axis=0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], codes, error], names=[*batch.schema.names[:-1], "code", "error"])

    return run


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """One row per usable vector: id, code, error, label_error, codebooks_sha256.

    A component x becomes floor(scale * x).  ``code`` names each part's nearest
    entry in two hex digits; ``error`` is the vector's squared distance to what the
    code stands for, ``label_error`` its sum over the rows of equal label (null is
    a label too); sums beyond 64 bits are null.

    Defined cases: a vector takes no part if it is null, empty, holds null, a
    non-finite component or one beyond 2 ** 24 after scaling, or if its length is no
    multiple of ``parts`` or is not the most frequent such length (ties: the longer).
    A null id sorts last; rows that repeat an id are rows of their own; fewer
    vectors than ``entries`` give so many entries; an empty table gives no rows;
    other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    text = F.col(label_col).cast("string")
    all_rows = cut(integers(vectors, id_col, vector_col, [F.coalesce(text, F.lit("")).alias("label"), text.isNull().alias("unlabelled")], parts, scale), "vectors")
    lengths = Counter({r.n: r["count"] for r in all_rows.groupBy("n").count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()})
    dims = next(iter(lengths), parts)
    packed = all_rows.filter(F.col("n") == dims).drop("n")
    books = train_codebooks(packed, dims, parts, entries, rounds)
    kind = packed.schema["id"].dataType.simpleString()
    coded = cut(packed.mapInArrow(_codes(books, dims), f"id {kind}, label string, unlabelled boolean, code string, error long"), "codes")
    sums = coded.groupBy("label", "unlabelled").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    also = fresh(coded, "split_key")
    key = F.xxhash64("label", "unlabelled")  # a key of the join alone, so that Spark may split the rows of a frequent label
    joined = coded.withColumn(also, key).join(sums.withColumn(also, key), ["label", "unlabelled", also])
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
