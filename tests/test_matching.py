import numpy as np
import pytest

from framequarry.functions.se3 import exp_se3
from framequarry.operators import matching


def brute(points, pairs, longest, ratio):
    out = []
    for i, j in pairs:
        a, b = ([(k, np.array(d)) for f, k, d in points if f == n and d is not None and k is not None] for n in (i, j))
        a, b = sorted(a, key=lambda x: x[0]), sorted(b, key=lambda x: x[0])
        if not a or not b:
            continue
        far = np.arccos(np.clip(np.array([[x @ y for _, y in b] for _, x in a]), -1, 1))

        def best(m):
            order = np.argsort(m, axis=1, kind="stable")
            return [(o[0], m[r, o[0]] < longest and (len(o) == 1 or m[r, o[0]] < ratio * m[r, o[1]])) for r, o in enumerate(order)]

        rows, columns = best(far), best(far.T)
        out += [(i, j, a[r][0], b[c][0]) for r, (c, ok) in enumerate(rows) if ok and columns[c] == (r, True)]
    return sorted(out)


@pytest.mark.parametrize("tile", [1024, 7, 1])
def test_tiles_give_the_matches_of_whole_frames(spark, tile):
    rng = np.random.default_rng(3)
    points = []
    base = rng.normal(size=(20, 8))
    for f in range(6):
        for k in range(int(rng.integers(1, 20))):
            d = base[k] + rng.normal(size=8) * 0.2
            points.append((f, k + 100 * f, (d / np.linalg.norm(d)).tolist()))
    points += [(1, 999, None), (None, 5, points[0][2]), (2, None, points[0][2])]
    pairs = [(i, j) for i in range(6) for j in range(i + 1, 6)] + [(0, 77)]
    df = spark.createDataFrame(points, "frame long, key long, descriptor array<double>")
    got = matching.match_frames(df, spark.createDataFrame(pairs + pairs[:2], "i long, j long"), 1.2, 0.9, tile)
    assert sorted((r.i, r.j, r.key_i, r.key_j) for r in got.collect()) == brute(points, pairs, 1.2, 0.9)


def test_pairs_of_a_grid(spark):
    df = spark.createDataFrame([(f, f != 3) for f in range(9)] + [(None, True), (4, True)], "frame long, valid boolean")
    want = [(i, j) for j in range(9) for i in range(j) if 3 not in (i, j)]
    assert sorted((r.i, r.j) for r in matching.earlier_pairs(df, blocks=3).collect()) == sorted(want)
    assert sorted((r.i, r.j) for r in matching.earlier_pairs(df, 2).collect()) == sorted((i, j) for i, j in want if j - i <= 2)


def test_chain_says_which_stage_refused_a_pair(spark):
    rng = np.random.default_rng(7)
    n = 12
    desc = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    world = rng.normal(size=(n, 3)) + [0, 0, 4]
    pixel = rng.uniform(20, 600, (n, 2))
    move = exp_se3(rng.normal(size=(1, 6)) * 0.2)[0]
    moved = world @ move[:3, :3].T + move[:3, 3]

    def rows(f, d, xyz, uv):
        return [(f, k, d[k].tolist(), *map(float, uv[k]), *map(float, xyz[k])) for k in range(n)]

    line = np.column_stack([np.linspace(20, 600, n), np.full(n, 7.0)])
    data = rows(0, desc, world, pixel) + rows(1, desc, moved, pixel + 3) + rows(2, desc[n:], world, pixel) + rows(3, desc, rng.normal(size=(n, 3)) * 3, pixel) + rows(5, desc, moved, pixel)
    data += rows(4, desc[30:], world, line) + rows(6, desc[30:], moved, line)
    df = spark.createDataFrame(data, "frame long, key long, descriptor array<double>, u double, v double, x double, y double, z double")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (0, 5), (4, 6)], "i long, j long")
    kept, history = matching.match_chain(df, pairs, verify=spark.createDataFrame([(0, 1), (4, 6)], "i long, j long"))
    assert {(r.i, r.j): (r.state, r.matches) for r in history.collect()} == {
        (0, 1): ("valid", n), (0, 2): ("few matches", 0), (0, 3): ("no rigid motion", 0), (0, 5): ("dense check", 0), (4, 6): ("small area", 0),
    }
    assert {(r.i, r.j) for r in kept.select("i", "j").collect()} == {(0, 1)} and kept.count() == n
