"""Descriptors of frames in tiles that meet in cells: a matrix product in single precision finds candidates, sums in double precision decide.

A tile holds a part of one large frame or several small ones.  Its size grows with the
rows up to a bound in bytes, so a row travels to about as many cells at any size and a
task holds two tiles.  Within a tile equal descriptors of a frame are one class.  The
product's rounding error is bounded by the norms; whatever could still be among the
nearest (or beyond a threshold) within that bound is summed again in order of the
components, as SQL does, so copies tie exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tiles that all rows fill, if they are neither small nor large; fewest rows and most numbers of one.
TILES, FEWEST, NUMBERS = 16, 1024, 8 << 20
#: Rows and columns of one product, and candidates that are held or summed at once.
ROWS, COLUMNS, HELD = 512, 2048, 1 << 18
#: A null key.
NULL = np.iinfo(np.int64).min


def tiled(rows: DataFrame, tile: int | None = None, blanks: bool = False) -> tuple[DataFrame, int, int]:
    """(frame, key, d) -> (frame, key, d, tile), the number of tiles and the width of the descriptors.

    The width is that of the longest; those of other lengths take no part.  With
    ``blanks``, descriptors that are null or hold a null stay as null ones.
    """
    d = F.col("d") if dict(rows.dtypes)["d"] == "array<float>" else F.col("d").cast("array<double>")
    rows = rows.filter("frame is not null").select(F.col("frame").cast("long").alias("frame"), F.col("key").cast("long").alias("key"), d.alias("d"))
    sizes = rows.groupBy("frame").agg(F.count("*").alias("m"), F.max(F.size("d")).alias("width"))
    n, width = sizes.agg(F.sum("m"), F.max("width")).first()
    n, width = n or 0, max(width or 0, 0)
    most = tile or max(FEWEST, min(n // TILES, NUMBERS // max(width, 1)))
    small, large = sizes.agg(F.sum(F.when(F.col("m") <= most, F.col("m"))), F.sum(F.when(F.col("m") > most, F.ceil(F.col("m") / most)))).first()
    shared = -(-(small or 0) // most) or 1
    rows = rows.filter(F.col("d").isNull() | (F.size("d") == width))
    rows = rows.withColumn("d", F.when(F.forall("d", lambda x: x.isNotNull()), F.col("d")))
    if not blanks:
        rows = rows.filter("d is not null")
    part = F.pmod(F.xxhash64("key"), F.ceil(F.col("m") / most).cast("long"))
    place = F.when(F.col("m") <= most, F.pmod(F.xxhash64("frame"), F.lit(shared))).otherwise(F.xxhash64("frame", part))
    return rows.join(sizes, "frame").select("frame", "key", "d", place.alias("tile")), shared + int(large or 0), width


def met(rows: DataFrame, pairs: DataFrame, tiles: int, half: bool = False) -> DataFrame:
    """(frame, key, d, tile) and (i, j) -> a, b, side, frame, key, d: for each cell of two tiles with an asked pair its pairs (side 0: frame i, key j), then the rows of a and, if it is another tile, of b.

    With ``half``, two tiles meet once only (for pairs of a frame with itself).
    """
    places = rows.select("frame", "tile").distinct()
    at = lambda n, t: places.select(F.col("frame").alias(n), F.col("tile").alias(t))
    asked = pairs.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).distinct().join(at("i", "a"), "i").join(at("j", "b"), "j")
    asked = asked.filter("a <= b") if half else asked
    cells = asked.select("a", "b").distinct()
    kind = rows.schema["d"].dataType
    out = asked.select("a", "b", F.lit(0).alias("side"), F.col("i").alias("frame"), F.col("j").alias("key"), F.lit(None).cast(kind).alias("d"))
    for side, t, these in ((1, "a", cells), (2, "b", cells.filter("a <> b"))):
        out = out.union(these.join(rows.withColumnRenamed("tile", t), t).select("a", "b", F.lit(side), "frame", "key", "d"))
    return out.repartition(max(1, min(tiles * (tiles + 1) // 2, 1024)), "a", "b").sortWithinPartitions("a", "b", "side", "frame", "key")


class Tile:
    """Classes of equal descriptors, by frame and smallest key: frames, x (double), y (single), norms; members and where each class's begin."""

    def __init__(self, frames: np.ndarray, keys: np.ndarray, x: np.ndarray, blank: np.ndarray):
        raw = np.concatenate([frames.reshape(-1, 1).view(np.uint8), blank.reshape(-1, 1).view(np.uint8), np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)], axis=1)
        _, first, of = np.unique(np.ascontiguousarray(raw).view(f"V{raw.shape[1]}").ravel(), return_index=True, return_inverse=True)
        rank = np.argsort(np.argsort(first))[of.ravel()]
        order = np.argsort(rank, kind="stable")
        first = np.sort(first)
        self.keys, self.starts = keys[order], np.searchsorted(rank[order], np.arange(len(first) + 1))
        self.frames, self.blank, self.x = frames[first], blank[first], x[first].astype(np.float64)
        with np.errstate(all="ignore"):
            self.norms = np.sqrt((self.x**2).sum(1))
            self.odd = self.blank | ~(self.norms < 1e15)
            self.norms[self.odd] = 0
            self.y = np.where(self.odd[:, None], 0, self.x).astype(np.float32)
        self.columns = np.ascontiguousarray(self.x.T)

    def of(self, frame: int) -> slice:
        return slice(*np.searchsorted(self.frames, [frame, frame + 1]))


def cells(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, Tile, Tile]]:
    """Rows of :func:`met` -> asked i and j, tiles a and b of each cell."""
    parts, now = [], None

    def done():
        side, frame, key, x, blank = (np.concatenate(c) for c in zip(*parts))
        at = lambda s: Tile(frame[side == s], key[side == s], x[side == s], blank[side == s])
        a = at(1)
        return frame[side == 0], key[side == 0], a, a if now[0] == now[1] else at(2)

    for batch in batches:
        a, b, side, frame = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "side", "frame"))
        key = batch.column("key").fill_null(int(NULL)).to_numpy(zero_copy_only=False)
        d = batch.column("d")
        blank = d.is_null().to_numpy(zero_copy_only=False)
        values = d.flatten().to_numpy(zero_copy_only=False)
        x = np.zeros((len(a), width), values.dtype)
        x[~blank] = values.reshape(-1, width) if width else x[~blank]
        cut = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(a)]
        for s, e in zip(cut, cut[1:]):
            if s == e:
                continue
            if now is not None and now != (a[s], b[s]):
                yield done()
                parts = []
            now = (a[s], b[s])
            parts.append((side[s:e], frame[s:e], key[s:e], x[s:e], blank[s:e]))
    if parts:
        yield done()


def dots(a: Tile, b: Tile, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of classes, summed in order; those with a blank are not numbers."""
    out = np.zeros(len(r))
    with np.errstate(all="ignore"):
        for s in range(0, len(r), HELD):
            p, q, part = r[s : s + HELD], c[s : s + HELD], out[s : s + HELD]
            for u, v in zip(a.columns, b.columns):
                part += u[p] * v[q]
            part[a.blank[p] | b.blank[q]] = np.nan
    return out


def _product(a: Tile, b: Tile, rows: slice, columns: slice, wild: float, blank: float) -> np.ndarray:
    """Inner products in single precision; ``wild`` where components are too large or not finite, ``blank`` with a blank."""
    x = a.y[rows] @ b.y[columns].T
    for value, p, q in ((wild, a.odd[rows], b.odd[columns]), (blank, a.blank[rows], b.blank[columns])):
        x[p] = value
        x[:, q] = value
    return x


def _slack(width: int) -> float:
    """A bound of the error of an inner product in single precision, to the product of the norms."""
    return (width + 4) * 2.0**-22


def _parts(whole: slice, size: int) -> list[slice]:
    return [slice(s, min(s + size, whole.stop)) for s in range(whole.start, whole.stop, size)]


def _raise(top: np.ndarray, x: np.ndarray, groups: int = 32) -> np.ndarray:
    """``top``: len(top) largest values found so far for each column; with them those of ``x``, by maxima of groups of its rows: never above the true ones."""
    n = len(x) // groups
    if n > 1:
        x = x[: n * groups].reshape(n, groups, -1).max(0)
    k, both = len(top), np.concatenate([top, x])
    return np.partition(both, len(both) - k, axis=0)[-k:]


def _candidates(a: Tile, b: Tile, rows: slice, columns: slice, k: int, both: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of classes that hold the ``k`` nearest of each row (and of each column, if ``both``), in parts."""
    high, wide = rows.stop - rows.start, columns.stop - columns.start
    if high * wide <= 256:
        r, c = np.divmod(np.arange(high * wide), wide)
        yield r + rows.start, c + columns.start
        return
    slack = _slack(a.x.shape[1])
    far_r, far_c = (2 * slack * t.norms[s] * o.norms[p].max() + 1e-6 * slack for t, s, o, p in ((a, rows, b, columns), (b, columns, a, rows)))
    top_r, top_c = np.full((k, high), -np.inf, np.float32), np.full((k, wide), -np.inf, np.float32)

    def least(top: np.ndarray, margin: np.ndarray) -> np.ndarray:
        """All inner products of 1 and more are as near as each other, and so are those of -1 and less."""
        kth = np.minimum(top.min(0).astype(np.float64), 1)
        return np.nextafter(np.where(kth - margin <= -1, -np.inf, kth - margin).astype(np.float32), np.float32(-np.inf))

    for p in _parts(rows, ROWS):
        pr = slice(p.start - rows.start, p.stop - rows.start)
        for q in _parts(columns, COLUMNS):
            qc = slice(q.start - columns.start, q.stop - columns.start)
            x = _product(a, b, p, q, -np.inf, np.inf)
            n = x.shape[1] // 64
            g = x[:, : n * 64].reshape(len(x), n, 64).max(1) if n > 1 else x
            top_r[:, pr] = np.partition(np.concatenate([top_r[:, pr].T, g], axis=1), g.shape[1], axis=1)[:, -k:].T
            found = x >= least(top_r[:, pr], far_r[pr])[:, None]
            if both:
                top_c[:, qc] = _raise(top_c[:, qc], x)
                found |= x >= least(top_c[:, qc], far_c[qc])[None, :]
            found[a.odd[p]] = True
            found[:, b.odd[q]] = True
            r, c = np.divmod(np.flatnonzero(found), x.shape[1])
            yield r + p.start, c + q.start


def _first(groups: tuple[np.ndarray, ...], dist: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Where the ``k`` least rows by distance and key of each group are, in order."""
    order = np.lexsort((key, dist, *groups[::-1]))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.any([g[order][1:] != g[order][:-1] for g in groups], axis=0)
    place = np.arange(len(order))
    return order[place - np.maximum.accumulate(np.where(new, place, 0)) < k]


def nearest(k: int, both: bool, width: int, farthest: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over :func:`met`: the ``k`` nearest of b, nearer than ``farthest``, for each key of a by asked pair (side 0), and the other way round (side 1): i, j, side, key, other, dist."""

    def ranked(a: Tile, b: Tile, n: np.ndarray, r: np.ndarray, c: np.ndarray, dist: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """For each side the candidates that are among the k nearest classes."""
        out = []
        for mine, other, t in ((r, c, b), (c, r, a))[: 1 + both]:
            out.append(_first((n, mine), dist, t.keys[t.starts[other]], k))
        return out

    def rows(a: Tile, b: Tile, i_s, j_s, n, r, c, dist) -> Iterator[pa.RecordBatch]:
        for side, at in enumerate(ranked(a, b, n, r, c, dist)):
            t, o = (a, b) if side == 0 else (b, a)
            pair, mine, other, far = n[at], (r, c)[side][at], (c, r)[side][at], dist[at]
            held = np.minimum(np.diff(o.starts)[other], k)  # the first k members of each class
            rep = np.repeat(np.arange(len(at)), held)
            key = o.keys[o.starts[other][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(held) - held, held)]
            pair, mine, far = pair[rep], mine[rep], far[rep]
            best = _first((pair, mine), far, key, k)
            best = best[far[best] < farthest]
            pair, mine, far, key = pair[best], mine[best], far[best], key[best]
            size = np.diff(t.starts)[mine]
            ends = np.cumsum(size)
            cut = [0, *(np.flatnonzero(np.diff(ends // HELD)) + 1).tolist(), len(size)] if len(size) else []
            for s, e in zip(cut, cut[1:]):  # a class may have many members: in parts of bounded size
                m = size[s:e]
                rep = np.repeat(np.arange(s, e), m)
                own = t.keys[t.starts[mine][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(m) - m, m)]
                keys = [pa.array(v, mask=v == NULL) for v in (own, key[rep])]
                yield pa.RecordBatch.from_arrays([pa.array(i_s[pair[rep]]), pa.array(j_s[pair[rep]]), pa.array(np.full(len(rep), side, np.int32)), *keys, pa.array(far[rep])], names=["i", "j", "side", "key", "other", "dist"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i_s, j_s, a, b in cells(batches, width):
            held: list[tuple[np.ndarray, ...]] = []  # candidates with their distance: pair, row, column, distance
            fresh: list[tuple[np.ndarray, ...]] = []  # and without
            count = 0

            def settle() -> tuple[np.ndarray, ...]:
                n, r, c = (np.concatenate(v) for v in zip(*fresh))
                x = dots(a, b, r, c)
                fresh.clear()
                return tuple(np.concatenate(v) for v in zip(*held, (n, r, c, np.arccos(np.clip(np.where(np.isnan(x), 1, x), -1, 1)))))

            for n, (i, j) in enumerate(zip(i_s.tolist(), j_s.tolist())):
                ra, rb = a.of(i), b.of(j)
                if ra.start == ra.stop or rb.start == rb.stop:
                    continue
                for r, c in _candidates(a, b, ra, rb, k, both):
                    fresh.append((np.full(len(r), n), r, c))
                    count += len(r)
                    if count > HELD:
                        whole = settle()
                        kept = np.unique(np.concatenate(ranked(a, b, *whole)))
                        held, count = [tuple(v[kept] for v in whole)], 0
                if count + sum(len(h[1]) for h in held) > HELD:
                    yield from rows(a, b, i_s, j_s, *(settle() if fresh else held[0]))
                    held, count = [], 0
                    fresh.clear()
            if fresh or held:
                yield from rows(a, b, i_s, j_s, *(settle() if fresh else held[0]))

    return run


def linked(least: float, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over :func:`met` with pairs (i, i): u, v: for each cell, edges from the smallest key of every component of the keys whose inner product exceeds ``least``; at most one a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i_s, j_s, a, b in cells(batches, width):
            shift = 0 if a is b else len(a.x)
            root = np.arange(shift + len(b.x))
            true = np.zeros(len(root), bool)  # has a link
            slack = _slack(width)

            def join(r: np.ndarray, c: np.ndarray) -> None:
                nonlocal root
                true[r] = true[c] = True
                p, q = root[r], root[c]
                while (apart := p != q).any():
                    p, q = p[apart], q[apart]
                    np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
                    while (root[root] != root).any():
                        root = root[root]
                    p, q = root[p], root[q]

            for i, j in zip(i_s.tolist(), j_s.tolist()):
                ra, rb = a.of(i), b.of(j)
                for p in _parts(ra, ROWS):
                    for q in _parts(rb, COLUMNS):
                        if a is b and q.stop <= p.start:
                            continue
                        x = _product(a, b, p, q, np.inf, -np.inf)
                        margin = slack * a.norms[p].max() * b.norms[q].max() + 1e-6 * slack
                        r, c = np.divmod(np.flatnonzero(x > np.float32(least - 2 * margin)), x.shape[1])
                        open_ = ~(x[r, c] > least + margin) | np.isinf(x[r, c])
                        r, c = r + p.start, c + q.start
                        if open_.any():
                            at = np.flatnonzero(open_)
                            exact = dots(a, b, r[at], c[at])
                            fine = ((exact > least) | np.isnan(exact)) & ~(a.blank[r[at]] | b.blank[c[at]])
                            gone = at[~fine]
                            r, c = np.delete(r, gone), np.delete(c, gone)
                        if a is b:  # a class meets itself if it has several members
                            other = (r != c) | (np.diff(a.starts)[r] > 1)
                            r, c = r[other], c[other]
                        join(r, c + shift)
            member = np.concatenate([np.repeat(np.arange(len(t.x)) + s, np.diff(t.starts)) for t, s in ((a, 0), (b, shift))[: 1 + (a is not b)]])
            keys = np.concatenate([t.keys for t in (a, b)[: 1 + (a is not b)]])
            member, keys = root[member[true[member]]], keys[true[member]]
            smallest = np.full(len(root), np.iinfo(np.int64).max)
            np.minimum.at(smallest, member, keys)
            u = smallest[member]
            fine = u != keys
            yield pa.RecordBatch.from_arrays([pa.array(u[fine]), pa.array(keys[fine])], names=["u", "v"])

    return run
