"""Column functions against numpy: derivatives by differences, colours, interpolation, quaternions."""

import colorsys

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.functions import camera, derivatives, voxel
from framequarry.functions.se3 import exp_se3, exp_so3


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    return [(exp_se3(rng.normal(size=(1, 6)))[0], exp_se3(rng.normal(size=(1, 6)))[0], rng.normal(size=3)) for _ in range(5)]


def flat(m):
    return [float(x) for x in np.ravel(m)]


def test_derivatives_by_differences(spark, rows):
    df = spark.createDataFrame([(flat(a), flat(d), *flat(p)) for a, d, p in rows], "a array<double>, d array<double>, x double, y double, z double")
    point = F.struct("x", "y", "z")
    xyz = (F.col("x"), F.col("y"), F.col("z"))
    got = df.select(derivatives.turn_derivative(point), derivatives.first_derivative(F.col("a"), F.col("d"), *xyz), derivatives.second_derivative(F.col("a"), F.col("d"), *xyz)).collect()
    step = 1e-6
    for (a, d, p), r in zip(rows, got):
        turn, first, second = np.zeros((3, 3)), np.zeros((3, 6)), np.zeros((3, 6))
        for k in range(6):
            e = np.zeros((2, 6))
            e[0, k], e[1, k] = step, -step
            up, down = exp_se3(e)
            if k < 3:
                turn[:, k] = (up[:3, :3] @ p - down[:3, :3] @ p) / (2 * step)
            first[:, k] = ((np.linalg.inv(a @ up @ d) - np.linalg.inv(a @ down @ d)) @ [*p, 1])[:3] / (2 * step)
            second[:, k] = ((a @ up @ d - a @ down @ d) @ [*p, 1])[:3] / (2 * step)
        assert np.allclose(np.reshape(r[0], (3, 3)), turn, atol=1e-7) and np.allclose(np.reshape(r[1], (3, 6)), first, atol=1e-7) and np.allclose(np.reshape(r[2], (3, 6)), second, atol=1e-7)


def test_eigenvectors(spark):
    rng = np.random.default_rng(5)
    made = []
    for _ in range(6):
        m = rng.normal(size=(3, 3))
        m = m @ m.T
        made += [(flat(m), float(v)) for v in np.linalg.eigvalsh(m)]
    got = spark.createDataFrame([*made, (flat(np.eye(3)), 1.0)], "m array<double>, v double").select(derivatives.eigenvector(F.col("m"), F.col("v")).alias("e")).collect()
    for (m, v), r in zip(made, got):
        assert np.allclose(np.reshape(m, (3, 3)) @ r.e, v * np.array(r.e), atol=1e-9) and np.isclose(np.linalg.norm(r.e), 1)
    assert got[-1].e is None


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_colours_and_weights(spark):
    assert np.isclose(one(spark, camera.luma(F.lit(255), F.lit(255), F.lit(255)))[0], 1) and np.isclose(one(spark, camera.luma(F.lit(10), F.lit(0), F.lit(0)))[0], 0.299 * 10 / 255)
    for h in (0.0, 45.0, 130.0, 200.0, 299.0, 359.0, 400.0):
        r = one(spark, camera.hue_to_rgb(F.lit(h), F.lit(0.7), F.lit(0.9)))[0]
        assert np.allclose([r.r, r.g, r.b], colorsys.hsv_to_rgb(h % 360 / 360, 0.7, 0.9))
    r = one(spark, camera.depth_to_rgb(F.lit(2.0), 1.0, 3.0), camera.depth_to_rgb(F.lit(0.5), 1.0, 3.0))
    assert np.allclose([r[0].r, r[0].g, r[0].b], colorsys.hsv_to_rgb(120 / 360, 1, 1)) and r[1] is None
    assert np.isclose(one(spark, camera.gauss(2.0, F.lit(3.0), F.lit(-1.0)))[0], np.exp(-10 / 8))
    none = F.lit(None).cast("double")
    whole, part, empty = one(spark, camera.bilinear([F.lit(x) for x in (1.0, 2.0, 3.0, 4.0)], F.lit(0.25), F.lit(0.5)), camera.bilinear([F.lit(1.0), none, F.lit(3.0), none], F.lit(0.25), F.lit(0.5)), camera.bilinear([none] * 4, F.lit(0.1), F.lit(0.1)))
    assert np.isclose(whole, 2.25) and np.isclose(part, 2.0) and empty is None


def test_crossings_light_and_jacobian(spark):
    assert one(spark, camera.zero_crossing(F.lit(1.0), F.lit(3.0), F.lit(0.5), F.lit(-0.5)))[0] == 2.0
    close = one(spark, camera.edge_vertex(F.lit(1.0), F.lit(2.0), F.lit(1e-6), F.lit(1.0)), camera.edge_vertex(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(-1e-6)), camera.edge_vertex(F.lit(1.0), F.lit(2.0), F.lit(-1.0), F.lit(3.0)))
    assert close[0] == 1.0 and close[1] == 2.0 and close[2] == 1.25
    x, y, z = 0.3, -0.2, 2.0
    j = np.reshape(one(spark, camera.screen_jacobian(500.0, 400.0, F.lit(x), F.lit(y), F.lit(z)))[0], (2, 3))
    project = lambda p: np.array([500 * p[0] / p[2], 400 * p[1] / p[2]])
    for k in range(3):
        e = np.eye(3)[k] * 1e-6
        assert np.allclose(j[:, k], (project(np.array([x, y, z]) + e) - project(np.array([x, y, z]) - e)) / 2e-6, atol=1e-4)
    coefficients = F.array(*[F.lit(float(k)) for k in range(1, 10)])
    nx, ny, nz = 0.6, 0.0, 0.8
    want = 1 + 2 * ny + 3 * nz + 4 * nx + 5 * nx * ny + 6 * ny * nz + 7 * (3 * nz * nz - 1) + 8 * nx * nz + 9 * (nx * nx - ny * ny)
    n = [F.lit(v) for v in (nx, ny, nz)]
    lit, shade, bright = one(spark, camera.light(coefficients, *n), derivatives.shading(F.lit(0.01), coefficients, *n), derivatives.shading(F.lit(9.0), coefficients, *n))
    assert np.isclose(lit, want) and np.isclose(shade, 0.01 * want) and bright == 1.0


def test_rotation_angle_and_chunks(spark):
    axis = np.array([0.4, -0.2, 0.1])
    m = np.eye(4)
    m[:3, :3] = exp_so3(axis[None])[0]
    got = one(spark, camera.rotation_angle(F.array(*[F.lit(v) for v in flat(m)])))[0]
    d = np.ones(3) / np.sqrt(3)
    assert np.isclose(got, np.arccos(d @ m[:3, :3] @ d))
    assert [one(spark, voxel.world_to_chunk(F.lit(x), 2.0))[0] for x in (-3.1, -0.9, 0.9, 1.1)] == [-2, 0, 0, 1]


def test_solver_leaves_out_blocks_of_unknown_frames(spark):
    from framequarry.operators import solver

    h = np.concatenate([np.eye(6) * 2, np.eye(6) * 2, -np.eye(6) * 2]).ravel().tolist()
    blocks = spark.createDataFrame([(0, 1, h, [1.0] * 12), (1, 9, h, [5.0] * 12)], "i long, j long, h array<double>, g array<double>")
    frames = spark.createDataFrame([(0,), (1,)], "frame long")
    x = {r.frame: r.x for r in solver.conjugate_gradients(blocks, frames, 0, rounds=3).collect()}
    assert np.allclose(x[1], -0.5) and x[0] == [0.0] * 6
