import numpy as np
from pyspark.sql import functions as F

from framequarry.functions.camera import Camera
from framequarry.operators import integration

CAMERA = Camera(20.0, 20.0, 7.5, 5.5, 16, 12)
KIND = "frame long, u int, v int, depth double"


def plane(spark, depths):
    rows = [(f, u, v, d) for f, d in depths.items() for u in range(16) for v in range(12)]
    poses = [(f, np.eye(4).ravel().tolist()) for f in depths]
    return spark.createDataFrame(rows + [(0, 99, 0, None)], KIND), spark.createDataFrame(poses, "frame long, transform array<double>")


def world(df):
    at = [F.col(b) * 8 + F.floor(F.col("li") / d).cast("int") % 8 for b, d in (("bx", 1), ("by", 8), ("bz", 64))]
    return df.select(*[a.alias(f"v{c}") for a, c in zip(at, "xyz")], "sdf", "weight")


def test_plane_has_the_distance_to_it(spark):
    pixels, poses = plane(spark, {0: 1.0, 1: 1.0})
    got = world(integration.integrate(integration.depth_samples(pixels, poses, CAMERA, 0.05))).collect()
    # 2 frames of one plane: every voxel within 0.08 of it in sight, with distance 1 - z
    want = set()
    for x in range(-40, 40):
        for y in range(-40, 40):
            for z in range(1, 30):
                u, v = int(x * 0.05 * 20 / (z * 0.05) + 7.5 + 0.5), int(y * 0.05 * 20 / (z * 0.05) + 5.5 + 0.5)
                if 0 <= u < 16 and 0 <= v < 12 and x * 20 / z + 8 > -1 and abs(1 - z * 0.05) < 0.08:
                    want.add((x, y, z))
    assert {(r.vx, r.vy, r.vz) for r in got} == want and len(want) > 100
    assert all(abs(r.sdf - (1 - r.vz * 0.05)) < 1e-12 and r.weight == 2 for r in got)


def test_a_frame_taken_out_leaves_the_other(spark):
    pixels, poses = plane(spark, {0: 1.0, 1: 1.05, 2: 1.1})
    samples = integration.depth_samples(pixels, poses, CAMERA, 0.05).cache()
    signs = samples.withColumn("sign", F.lit(1)).union(samples.filter("frame = 0").withColumn("sign", F.lit(-1)))
    key = lambda df: {(r.bx, r.by, r.bz, r.li): (round(r.sdf, 12), r.weight) for r in df.collect()}
    assert key(integration.integrate(signs, F.col("sign"))) == key(integration.integrate(samples.filter("frame > 0")))


def test_blocks_on_rays(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5, 2.5, 0.5, 0.5), (0.2, 0.1, 0.0, 0.3, 0.1, 0.0), (1.5, -0.5, 0.0, -0.5, -0.5, 0.0)], "a double, b double, c double, d double, e double, f double")
    rows = df.select(integration.segment_blocks([F.col(x) for x in "abc"], [F.col(x) for x in "def"]).alias("s")).collect()
    assert [[tuple(b) for b in r.s] for r in rows] == [[(0, 0, 0), (1, 0, 0), (2, 0, 0)], [(0, 0, 0)], [(1, -1, 0), (0, -1, 0), (-1, -1, 0)]]
    pixels, poses = plane(spark, {0: 1.0})
    touched = {tuple(r) for r in integration.allocated_blocks(pixels, poses, CAMERA, 0.05).collect()}
    held = {(r.bx, r.by, r.bz) for r in integration.depth_samples(pixels, poses, CAMERA, 0.05).collect()}
    assert touched & held and all(1 - 0.08 <= (b[2] * 8 + 7.5) * 0.05 and (b[2] * 8 - 0.5) * 0.05 <= 1.08 for b in touched)


def linear(spark):
    rows = [(x, y, z, 2.0 * x - y + 0.5 * z - 4, 0.0 if (x, y, z) == (5, 5, 5) else 1.0) for x in range(6) for y in range(6) for z in range(6)]
    return spark.createDataFrame(rows, "vx long, vy long, vz long, sdf double, weight double")


def test_samples_between_voxels(spark):
    points = spark.createDataFrame([(1, 0.25, 0.1, 0.3), (2, 0.45, 0.45, 0.45), (3, 9.0, 0.0, 0.0), (4, -0.01, 0.1, 0.1)], "id long, x double, y double, z double")
    got = {r.id: r.sdf for r in integration.trilinear(points, linear(spark), 0.1).collect()}
    assert set(got) == {1} and abs(got[1] - (5 - 1 + 1.5 - 4)) < 1e-9
    n = integration.gradients(points, linear(spark), 0.1).collect()
    assert [r.id for r in n] == [1] and np.allclose([n[0].nx, n[0].ny, n[0].nz], np.array([2, -1, 0.5]) / np.sqrt(5.25))


def test_crossing_of_a_ray(spark):
    rays = spark.createDataFrame([(1, 0.05, 0.1, 0.1, 1.0, 0.0, 0.0, 0.0, -3.5, 0.4, 4.5), (2, 0.05, 0.1, 0.1, 0.0, 0.0, 9.0, 0.0, -3.0, 0.9, 4.0)], "id long, ox double, oy double, oz double, dx double, dy double, dz double, t0 double, s0 double, t1 double, s1 double")
    got = integration.ray_crossings(rays, linear(spark), 0.1).collect()
    assert [r.id for r in got] == [1] and abs(got[0].t - 0.175) < 1e-6


def test_blocks_move_out_and_in(spark):
    hot = spark.createDataFrame([(x, 0, 0, x * 1.0) for x in range(10)], "bx int, by int, bz int, sdf double")
    near, far = integration.move_out(hot, (0.0, 0.5, 0.5), 3.0, 1.0)
    assert sorted(r.bx for r in near.collect()) == [0, 1, 2] and far.count() == 7
    back, cold = integration.move_in(near, far, (9.0, 0.5, 0.5), 2.0, 1.0)
    assert back.count() + cold.count() == 10 and back.count() == 6
    assert integration.held_twice(back, cold).count() == 0 and integration.held_twice(hot, cold).count() == cold.count()
