import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from framequarry.llm.codes import BallTree, Codebooks, compress, squares


def brute(rows, entries=256, rounds=4):
    """(id, code, error, label_error), sha256 by comparing every entry, in Python's whole numbers."""
    kept = []
    for i, v, label in rows:
        if v and all(x is not None and math.isfinite(x) and abs(math.floor(1024 * x)) <= 2**24 for x in v) and len(v) % 4 == 0:
            kept.append((i, [math.floor(1024 * x) for x in v], label))
    if not kept:
        return [], None
    dims = max((n, k) for k, n in Counter(len(v) for _, v, _ in kept).items())[1]
    kept = [r for r in kept if len(r[1]) == dims]
    w = dims // 4
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], np.int32).tobytes()))[:entries]
    books = [[r[1][p * w : p * w + w] for r in first] for p in range(4)]

    def nearest(v, p):
        part = v[p * w : p * w + w]
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, _ in kept:
            for p in range(4):
                members[p, nearest(v, p)[1]].append(v[p * w : p * w + w])
        for (p, k), parts in members.items():
            books[p][k] = [sum(c) // len(parts) for c in zip(*parts)]
    coded = []
    for i, v, label in kept:
        found = [nearest(v, p) for p in range(4)]
        coded.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    total = Counter()
    for _, _, e, label in coded:
        total[label] += e
    return sorted([(i, c, e, total[label]) for i, c, e, label in coded], key=repr), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def same(spark, rows, schema="vec_id long, embedding array<double>, label int, code string, n int", **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(3)
    got = compress(df, **options).collect()
    want, sha = brute(rows, **options)
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in got], key=repr) == want
    assert {r.codebooks_sha256 for r in got} == ({sha} if want else set())


def test_equals_brute_force_with_bad_vectors_ties_and_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=8).round(3).tolist(), None if i % 7 == 0 else int(i % 3)) for i in rng.permutation(90)]
    rows += [(i, rows[4][1], 1) for i in range(200, 230)] + [(5, rows[8][1], 2), (None, rows[9][1], None), (7, rows[9][1], 0)]
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [None, *[1.0] * 7], 1), (303, [float("nan"), *[1.0] * 7], 1), (304, [float("-inf"), *[1.0] * 7], 1)]
    rows += [(305, [], 1), (306, [1.0] * 6, 1), (307, [1.0] * 12, 1), (308, [1e30, *[1.0] * 7], 1), (309, [-16384.0, 16384.0, *[-0.0005] * 6], 1)]
    same(spark, rows, entries=20)
    same(spark, rows)


def test_few_and_no_vectors(spark):
    same(spark, [(3, [1.0, 2.0, 3.0, 4.0], 1), (1, [1.0, 2.5, 3.0, 4.0], None)])
    same(spark, [])
    same(spark, [(1, None, 1)])
    with pytest.raises(ValueError):
        compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), entries=257)


@pytest.mark.parametrize("scale", [3, 200, 2**24 - 1])
def test_tree_finds_what_comparing_all_finds(scale):
    rng = np.random.default_rng(scale)
    entries = rng.integers(-scale, scale + 1, (256, 4))
    entries[50] = entries[10]  # equal entries: the lower index
    asked = np.concatenate([rng.integers(-scale, scale + 1, (700, 4)), entries])
    far = ((asked[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
    who, best = BallTree(entries).nearest(asked)
    assert who.tolist() == [int(np.argmin(f.astype(float))) if scale < 1000 else min(range(256), key=lambda k: (f[k], k)) for f in far]
    assert best.tolist() == [int(f.min()) for f in far]
    assert (squares(asked, entries) == far).all()


def test_tree_opens_few_balls_of_clustered_entries(monkeypatch):
    rng = np.random.default_rng(9)
    entries = np.concatenate([c + rng.integers(-3, 4, (16, 4)) for c in rng.integers(-5000, 5001, (16, 4))])
    tree, opened = BallTree(entries), []
    plain = tree._visit
    monkeypatch.setattr(tree, "_visit", lambda ball, rows, *a: (opened.append(len(rows)) if ball.inner is None else None, plain(ball, rows, *a))[1])
    asked = entries[rng.integers(0, 256, 500)] + rng.integers(-2, 3, (500, 4))
    tree.nearest(asked)
    assert sum(opened) >= 500  # rows that reach a leaf, before its own bound is tested


def test_decode():
    books = Codebooks((np.array([[1, 2], [3, 4]]), np.array([[5, 6]])))
    assert books.decode(["0100", "0000"]).tolist() == [[3, 4, 5, 6], [1, 2, 5, 6]]
