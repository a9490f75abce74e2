import time

import numpy as np
import pytest

from framequarry.functions.camera import Camera
from framequarry.functions.se3 import exp_se3
from framequarry.operators import elimination, solver

LINK = "i long, j long, px double, py double, pz double, qx double, qy double, qz double"


def poses_of(spark, poses):
    return spark.createDataFrame([(f, m.ravel().tolist()) for f, m in enumerate(poses)], "frame long, transform array<double>")


@pytest.fixture(scope="module")
def scene(spark):
    """A loop of 40 frames, each linked with the next two, and one link across."""
    rng = np.random.default_rng(5)
    n = 40
    true = exp_se3(rng.normal(size=(n, 6)) * 0.3)
    true[0] = np.eye(4)
    rows = []
    for i, j in [(i, i + d) for d in (1, 2) for i in range(n - d)] + [(0, n - 1), (7, 31)]:
        for w in rng.normal(size=(8, 3)):
            p, q = (np.linalg.inv(true[f]) @ [*w, 1] for f in (i, j))
            rows.append((i, j, *map(float, p[:3]), *map(float, q[:3])))
    start = exp_se3(rng.normal(size=(n, 6)) * 0.05) @ true
    start[0] = true[0]
    return true, start, spark.createDataFrame(rows, LINK)


@pytest.mark.parametrize("cell,grow,dense", [(8, 2, 10), (5, 3, 4), (100, 2, 0), (8, 2, 400)])
def test_step_is_that_of_the_whole_system(spark, scene, cell, grow, dense):
    _, start, links = scene
    moments = solver.pair_moments(links)
    a, g, _ = solver.normal_equations([(r.i, r.j, solver._square(r.moments)) for r in moments.collect()], start)
    want = np.linalg.solve(a[6:, 6:], -g[6:]).reshape(-1, 6)
    blocks = solver.pair_blocks(moments, poses_of(spark, start))
    got = {r.frame: r.x for r in elimination.solve_step(blocks, 0, cell, grow, dense).collect()}
    assert sorted(got) == list(range(40)) and got[0] == [0.0] * 6
    assert np.allclose(np.stack([got[f] for f in range(1, 40)]), want, atol=1e-6)


def test_forty_frames_are_recovered(spark, scene):
    true, start, links = scene
    began = time.time()
    poses, updates = elimination.gauss_newton(solver.pair_moments(links), poses_of(spark, start), 0, rounds=8, small=1e-6, cell=8, grow=4, dense=12)
    got = {r.frame: np.reshape(r.transform, (4, 4)) for r in poses.collect()}
    assert max(np.abs(got[f] - true[f]).max() for f in range(40)) < 1e-5
    assert updates[-1] < 1e-6 < updates[0] and (time.time() - began) / len(updates) < 20


def test_no_pairs_and_frames_without_any(spark):
    poses = poses_of(spark, exp_se3(np.zeros((3, 6))))
    empty = solver.pair_moments(spark.createDataFrame([], LINK))
    out, updates = elimination.gauss_newton(empty, poses, 0)
    assert out.count() == 3 and updates == [0.0]


def test_dense_term_fed_by_projection_moves_the_pose_back(spark):
    camera = Camera(40.0, 40.0, 19.5, 14.5, 40, 30, 0.1, 10.0)
    true = exp_se3(np.array([[0.0] * 6, [0.02, -0.03, 0.01, 0.03, 0.02, -0.02]]))
    height = lambda x, y: 1 + 0.3 * np.sin(2 * x) * np.cos(1.5 * y)
    rows = []
    for f in range(2):
        for u in range(40):
            for v in range(30):
                ray = np.array([(u - 19.5) / 40, (v - 14.5) / 40, 1.0])
                low, high = 0.5, 4.0
                for _ in range(50):  # where the ray meets the surface
                    mid = (low + high) / 2
                    w = (true[f] @ [*(ray * mid), 1])[:3]
                    low, high = (mid, high) if w[2] < height(w[0], w[1]) else (low, mid)
                w = (true[f] @ [*(ray * low), 1])[:3]
                slope = np.array([-0.6 * np.cos(2 * w[0]) * np.cos(1.5 * w[1]), 0.45 * np.sin(2 * w[0]) * np.sin(1.5 * w[1]), 1.0])
                n = true[f][:3, :3].T @ (slope / np.linalg.norm(slope))
                rows.append((f, u, v, *map(float, ray * low), *map(float, n)))
    pixels = spark.createDataFrame(rows, "frame long, u int, v int, x double, y double, z double, nx double, ny double, nz double").checkpoint()
    start = true.copy()
    start[1] = exp_se3(np.array([[0.01, 0.01, -0.005, 0.01, -0.01, 0.01]]))[0] @ true[1]
    empty = solver.pair_moments(spark.createDataFrame([], LINK))
    found = elimination.projected(pixels, spark.createDataFrame([(0, 1)], "i long, j long"), camera)
    poses, updates = elimination.gauss_newton(empty, poses_of(spark, start), 0, rounds=5, small=1e-4, found=found)
    got = {r.frame: np.reshape(r.transform, (4, 4)) for r in poses.collect()}
    assert np.abs(got[1] - true[1]).max() < 0.2 * np.abs(start[1] - true[1]).max() and updates[-1] < updates[0]
