import numpy as np
import pyarrow as pa
import pytest

from framequarry.operators import graph, matching, tiles


def vectors(rng, n, width=6):
    """Unit vectors with copies, near copies, a zero, and one beyond single precision."""
    x = rng.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[rng.integers(n, size=n // 2)] = x[rng.integers(n, size=n // 2)]
    x[: n // 8] = x[n // 8 : n // 8 * 2] * (1 + 1e-12)
    x[-1], x[-2, 0] = 0, 1e30
    return x


def summed(x, y):
    out = np.zeros((len(x), len(y)))
    for u, v in zip(x.T, y.T):
        out += np.outer(u, v)
    return out


def cell(a, b, pairs):
    """Rows of a cell of two tiles; a and b: frame, key, vector or None."""
    rows = [(1, 2, 0, i, j, None) for i, j in pairs] + [(1, 2, 1, *r) for r in a] + [(1, 2, 2, *r) for r in b]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["a", "b", "side", "frame", "key", "d"])
    return iter([whole.slice(0, 7), whole.slice(7)])


@pytest.mark.parametrize("held", [50, 1 << 18])
def test_a_cell_gives_the_nearest_in_double_precision(monkeypatch, held):
    monkeypatch.setattr(tiles, "ROWS", 17), monkeypatch.setattr(tiles, "COLUMNS", 130), monkeypatch.setattr(tiles, "HELD", held)
    rng = np.random.default_rng(1)
    x, y = vectors(rng, 60), vectors(rng, 300)
    y[::7] = x[rng.integers(60, size=len(y[::7]))]
    frames = [(0, 0, 60), (1, 60, 100)]
    a = [(0, k, x[k].tolist()) for k in range(59)] + [(0, 59, None)]
    b = [(5, 1000 + k, y[k].tolist()) for k in range(200)] + [(6, 1000 + k, y[k].tolist()) for k in range(200, 298)] + [(6, 1298, None), (6, 1299, None)]
    got = {}
    for batch in tiles.nearest(3, True, 6, np.inf)(cell(a, b, [(0, 5), (0, 6)])):
        for r in batch.to_pylist():
            got.setdefault((r["j"], r["side"], r["key"]), []).append((r["dist"], r["other"]))
    far = np.arccos(np.clip(summed(x, y), -1, 1))
    far[59], far[:, 298:] = 0, 0  # nulls
    want = {}
    for j, s, e in ((5, 0, 200), (6, 200, 300)):
        for r in range(60):
            want[j, 0, r] = sorted((far[r, c], 1000 + c) for c in range(s, e))[:3]
        for c in range(s, e):
            want[j, 1, 1000 + c] = sorted((far[r, c], r) for r in range(60))[:3]
    assert {k: sorted(v) for k, v in got.items()} == want and frames


def test_nearest_and_mutual_matches_of_large_frames_meet_in_tiles(spark):
    """Rows that leave a cell are bounded by its keys; the grid of expressions made every pair a row."""
    rng = np.random.default_rng(2)
    x, y = vectors(rng, 90), vectors(rng, 120)
    x[:, 0], y[:, 0] = np.minimum(x[:, 0], 1), np.minimum(y[:, 0], 1)
    a = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(400, None)], "i long, vi array<double>")
    b = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(y)], "j long, vj array<double>")
    want = matching.best_matches(matching.distances(a, b), ["i"], ["dist", "j"], 5).collect()
    got = matching.nearest_matches(a, b, 5, tile=32)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    assert sorted((r.i, r["rank"], r.j, round(r.dist, 9)) for r in got.collect()) == sorted((r.i, r["rank"], r.j, round(r.dist, 9)) for r in want)
    mutual = matching.mutual_ratio_matches(a, b, 1.2, 0.9)
    assert "MapInArrow" in mutual._jdf.queryExecution().toString()
    far = np.arccos(np.clip(np.r_[summed(x, y), np.ones((1, 120))], -1, 1))
    keys = [*range(90), 400]

    def best(m):
        order = np.argsort(m, axis=1, kind="stable")
        return [(o[0], m[r, o[0]] < 1.2 and m[r, o[0]] < 0.9 * m[r, o[1]]) for r, o in enumerate(order)]

    rows, columns = best(far), best(far.T)
    assert sorted((r.i, r.j) for r in mutual.collect()) == sorted((keys[r], c) for r, (c, ok) in enumerate(rows) if ok and columns[c] == (r, True))


def test_a_large_frame_travels_to_few_cells(spark):
    """Tiles grow with the rows: with three times the rows, each still travels to about as many cells."""
    for n in (20_000, 60_000):
        rows = spark.range(n).selectExpr("id % 10 as frame", "id as key", "array(float(id % 97), float(1)) as d")
        placed, count, width = tiles.tiled(rows)
        assert width == 2 and 16 <= count <= 31
        frames = matching.earlier_pairs(placed.select("frame"))
        assert tiles.met(placed, frames, count).count() < 32 * n


@pytest.mark.parametrize("tile", [None, 40])
def test_links_of_copies_are_no_pairs(spark, tile):
    """900 copies had 404550 edges."""
    rng = np.random.default_rng(4)
    x = vectors(rng, 150)
    x[-2] = x[0]
    data = [(k % 3, k, v.tolist()) for k, v in enumerate(x)] + [(0, 1000 + k, x[0].tolist()) for k in range(900)]
    data += [(1, 5000, [0.5] + [0.0] * 5), (1, 5001, [0.5] + [0.0] * 5), (2, 6000, None), (None, 6001, x[0].tolist()), (2, None, x[2].tolist())]
    links = matching.similar_links(spark.createDataFrame(data, "frame long, key long, d array<double>"), 0.8, tile).cache()
    assert links.count() < len(data) * (1 if tile is None else 30)
    root = {}
    real = [(f, k, np.array(v)) for f, k, v in data if v is not None and k is not None and f is not None]
    close = {}
    for f in range(3):
        ids, v = [k for g, k, _ in real if g == f], np.array([v for g, _, v in real if g == f])
        for r, c in zip(*np.nonzero(summed(v, v) > 0.8)):
            if r != c:
                close.setdefault(ids[r], set()).add(ids[c])
    for k in sorted(close):
        if k not in root:
            todo = [k]
            while todo:
                n = todo.pop()
                if n not in root:
                    root[n] = k
                    todo += close[n]
    assert {r.node: r.root for r in graph.components(links).collect()} == root
