import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.functions.se3 import exp_se3
from framequarry.operators import solver

LINK = "i long, j long, px double, py double, pz double, qx double, qy double, qz double"


def poses_of(spark, poses):
    return spark.createDataFrame([(f, m.ravel().tolist()) for f, m in enumerate(poses)], "frame long, transform array<double>")


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(2)
    true = exp_se3(rng.normal(size=(4, 6)) * 0.2)
    true[0] = np.eye(4)
    rows = []
    for i, j in ((0, 1), (1, 2), (2, 3), (0, 3)):
        for w in rng.normal(size=(12, 3)):
            p, q = (np.linalg.inv(true[f]) @ [*w, 1] for f in (i, j))
            rows.append((i, j, *map(float, p[:3]), *map(float, q[:3])))
    start = exp_se3(rng.normal(size=(4, 6)) * 0.03) @ true
    start[0] = true[0]
    return true, start, spark.createDataFrame(rows, LINK), rng


def whole(blocks, n):
    a, g = np.zeros((6 * n, 6 * n)), np.zeros(6 * n)
    for r in blocks.collect():
        i, j, h = slice(6 * r.i, 6 * r.i + 6), slice(6 * r.j, 6 * r.j + 6), np.reshape(r.h, (3, 6, 6))
        a[i, i] += h[0]
        a[j, j] += h[1]
        a[i, j] += h[2]
        a[j, i] += h[2].T
        g[i] += r.g[:6]
        g[j] += r.g[6:]
    return a, g


def test_blocks_and_their_product(spark, scene):
    _, start, links, rng = scene
    moments = solver.pair_moments(links)
    blocks = solver.pair_blocks(moments, poses_of(spark, start))
    a, g, energy = solver.normal_equations([(r.i, r.j, solver._square(r.moments)) for r in moments.collect()], start)
    got = whole(blocks, 4)
    assert np.allclose(got[0], a) and np.allclose(got[1], g) and np.isclose(blocks.agg(F.sum("energy")).first()[0], energy)
    p = rng.normal(size=(4, 6))
    vector = spark.createDataFrame([(f, p[f].tolist()) for f in range(4)], "frame long, p array<double>")
    out = {r.frame: r.ap for r in solver.apply_blocks(blocks, vector).collect()}
    assert np.allclose(np.stack([out[f] for f in range(4)]).ravel(), a @ p.ravel())


def test_conjugate_gradients_solve_and_find_the_poses(spark, scene):
    true, start, links, _ = scene
    moments, poses = solver.pair_moments(links.filter("j = 1")).checkpoint(), poses_of(spark, start[:2])
    blocks = solver.pair_blocks(moments, poses)
    a, g = whole(blocks, 2)
    x = {r.frame: r.x for r in solver.conjugate_gradients(blocks, poses.select("frame"), 0, rounds=8, small=1e-12).collect()}
    assert x[0] == [0.0] * 6 and np.allclose(x[1], -np.linalg.solve(a[6:, 6:], g[6:]), atol=1e-5)
    moved = solver.apply_step(poses, spark.createDataFrame([(f, list(v)) for f, v in x.items()], "frame long, x array<double>"))
    got = {r.frame: np.reshape(r.transform, (4, 4)) for r in moved.collect()}
    assert all(np.abs(got[f] - true[f]).max() <= 0.2 * np.abs(start[f] - true[f]).max() + 1e-9 for f in range(2))


def test_dense_term_is_the_derivative_of_its_energy(spark, scene):
    _, start, _, rng = scene
    rows = []
    for i, j in ((0, 1), (1, 2)):
        for _ in range(850 if i == 0 else 10):
            n = rng.normal(size=3)
            q = rng.normal(size=3) * 0.3 + [0, 0, 1]
            p = (np.linalg.inv(start[j]) @ start[i] @ [*q, 1])[:3] + rng.normal(size=3) * 0.01
            rows.append((i, j, *map(float, p), *map(float, q), *map(float, n / np.linalg.norm(n)), *map(float, rng.normal(size=3)), float(rng.normal() * 0.02)))
    found = spark.createDataFrame(rows, LINK + ", nx double, ny double, nz double, gx double, gy double, gz double, residual double")
    a, g = whole(solver.dense_blocks(found, poses_of(spark, start)), 4)
    assert not a[12:, 12:].any() and a[6:12, 6:12].any()  # fewer than 800 pixels count for nothing

    def energy(poses):
        total = 0.0
        for r in rows:
            if (r[0], r[1]) == (0, 1):
                p, q, n = (np.array(r[k : k + 3]) for k in (2, 5, 8))
                w, y = poses[1] @ [*p, 1], poses[0] @ [*q, 1]
                total += max(0, 1 - q[2] / 2) ** 2.5 * (poses[0][:3, :3] @ n @ (w - y)[:3]) ** 2
        return total / min(np.log(850), 9)

    for k in range(12):
        step = np.zeros((2, 6))
        step.ravel()[k] = 1e-6
        up, down = (energy(exp_se3(s * step) @ start[:2]) for s in (1, -1))
        assert np.isclose((up - down) / 2e-6, 2 * g[k], rtol=1e-4, atol=1e-6)
    both = whole(solver.dense_blocks(found, poses_of(spark, start), intensity_weight=0.5), 4)[0]
    assert np.linalg.eigvalsh(both - a)[0] > -1e-9 and np.trace(both) > np.trace(a)
