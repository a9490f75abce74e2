import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framequarry.functions import camera, se3, voxel
from framequarry.functions.camera import Camera
from framequarry.operators import images, rigid, solver, surface, verify


def rigid_of(rng, scale=1.0):
    return se3.exp_se3(rng.normal(scale=scale, size=(1, 6)))[0]


def test_exponential_and_logarithm():
    rng = np.random.default_rng(0)
    poses = np.concatenate([rng.normal(size=(50, 6)), np.zeros((1, 6)), 1e-7 * rng.normal(size=(5, 6)), [[np.pi - 1e-6, 0, 0, 1, 2, 3]]])
    m = se3.exp_se3(poses)
    assert np.allclose(m[:, :3, :3] @ m[:, :3, :3].transpose(0, 2, 1), np.eye(3), atol=1e-9)
    assert np.allclose(se3.exp_se3(se3.log_se3(m)), m, atol=1e-6)


def test_pose_functions_keep_nulls(spark):
    pose = [0.1, -0.2, 0.3, 1.0, 2.0, 3.0]
    r = spark.createDataFrame([(pose,), (None,)], "p array<double>").select(se3.matrix_to_pose(se3.pose_to_matrix("p")).alias("q")).collect()
    assert np.allclose(r[0].q, pose) and r[1].q is None


def test_matrix_columns(spark):
    rng = np.random.default_rng(1)
    a, b = rigid_of(rng), rigid_of(rng)
    df = spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist())], "a array<double>, b array<double>")
    r = df.select(camera.multiply(F.col("a"), F.col("b")).alias("ab"), camera.invert_rigid(F.col("a")).alias("inv"), camera.quaternion(F.col("a")).alias("q"), camera.transform_point(F.col("a"), F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("p")).first()
    assert np.allclose(np.reshape(r.ab, (4, 4)), a @ b) and np.allclose(np.reshape(r.inv, (4, 4)), np.linalg.inv(a))
    x, y, z, w = r.q
    turned = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    assert np.allclose(turned, a[:3, :3]) and np.allclose(list(r.p), (a @ [1, 2, 3, 1])[:3])


def test_voxel_functions(spark):
    values = [-9, -8, -1, 0, 7, 8]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    r = df.select(voxel.voxel_to_block(F.col("v")).alias("b"), F.pmod("v", F.lit(8)).alias("l"), voxel.local_index(F.col("v"), F.lit(1), F.lit(2)).alias("i")).collect()
    assert [x.b for x in r] == [-2, -1, -1, 0, 0, 1] and [x.i for x in r] == [(v % 8) + 8 + 128 for v in values]

    def c_hash(x, y, z, n):
        m = (1 << 32) - 1
        return ((x * 73856093 & m) ^ (y * 19349669 & m) ^ (z * 83492791 & m)) % n

    triples = [(1, 2, 3), (-4, 5, -6), (-100000, 99999, 7)]
    got = spark.createDataFrame(triples, "x long, y long, z long").select(voxel.spatial_hash(F.col("x"), F.col("y"), F.col("z"), 800000).alias("h")).collect()
    assert [g.h for g in got] == [c_hash(*t, 800000) for t in triples]
    assert spark.range(1).select(voxel.world_to_voxel(F.lit(-0.025), 0.01).alias("v")).first().v == -3


def test_camera_round_trip(spark):
    cam = Camera(500.0, 510.0, 320.0, 240.0, 640, 480)
    df = spark.createDataFrame([(100, 50, 2.0), (0, 0, None)], "u int, v int, d double").withColumn("p", cam.back_project(F.col("u"), F.col("v"), F.col("d")))
    u, v = cam.pixel(F.col("p.x"), F.col("p.y"), F.col("p.z"))
    r = df.select(u.alias("u2"), v.alias("v2"), cam.in_frustum(F.col("p.x"), F.col("p.y"), F.col("p.z")).alias("f")).collect()
    assert (r[0].u2, r[0].v2, r[0].f) == (100, 50, True) and (r[1].u2, r[1].f) == (None, False)


def test_kabsch_and_greedy_filter(spark):
    rng = np.random.default_rng(2)
    m = rigid_of(rng)
    src = rng.normal(size=(30, 3))
    dst = src @ m[:3, :3].T + m[:3, 3]
    rows = [(0, *map(float, a), *map(float, b)) for a, b in zip(src, dst)] + [(0, None, 0.0, 0.0, 0.0, 0.0, 0.0)]
    r = rigid.kabsch(spark.createDataFrame(rows, "g int, sx double, sy double, sz double, tx double, ty double, tz double"), ["g"]).first()
    assert r.n == 30 and np.allclose(np.reshape(r.transform, (4, 4)), m, atol=1e-8)
    bad = dst.copy()
    bad[25:] += 1.0
    pixels = rng.uniform(0, 640, (30, 4))
    frame = [(1, i, float(i), *map(float, src[i]), *map(float, bad[i]), *map(float, pixels[i])) for i in range(30)]
    frame += [(2, i, float(i), float(i), 0.0, 0.0, float(i), 0.0, 0.0, 50.0 * i, 0.0, 50.0 * i, 0.0) for i in range(10)]  # collinear
    df = spark.createDataFrame(frame, "pair int, match_id long, dist double, sx double, sy double, sz double, tx double, ty double, tz double, u1 double, v1 double, u2 double, v2 double")
    got = rigid.filter_matches(df, ["pair"]).collect()
    assert [g.pair for g in got] == [1] and set(got[0].kept) <= set(range(25)) and np.allclose(np.reshape(got[0].transform, (4, 4)), m, atol=1e-6)


def test_box_area_and_spread(spark):
    a = 0.4
    points = [(0, float(x * np.cos(a) - y * np.sin(a)), float(x * np.sin(a) + y * np.cos(a)), 0.0) for x in range(-4, 5) for y in range(-1, 2)]
    df = spark.createDataFrame(points + [(1, float(i), 0.0, 0.0) for i in range(5)], "g int, x double, y double, z double")
    got = {r.g: r.area for r in rigid.box_area(df, ["g"], "x", "y").collect()}
    assert got[0] == pytest.approx(16.0) and got[1] == 0.0
    s = {r.g: r.condition for r in rigid.spread(df, ["g"], ("x", "y", "z")).collect()}
    assert s[0] == pytest.approx((60 / 9) / (2 / 3), rel=1e-6) and s[1] is None


def test_image_stencils(spark):
    y, x = np.mgrid[0:12, 0:16]
    plane = 2.0 + 0.1 * x
    gx, gy = images.sobel(plane)
    assert np.allclose(gx[1:-1, 1:-1], 0.1) and np.allclose(gy[1:-1, 1:-1], 0) and np.isnan(gx[0]).all()
    holes = plane.copy()
    holes[5, 5] = np.nan
    assert np.isnan(images.smooth(holes, 1.0)[5, 5]) and np.isfinite(images.smooth(holes, 1.0)[5, 6])
    n = images.normals(images.back_project(np.full((12, 16), 2.0), 100, 100, 8, 6))
    assert np.allclose(np.abs(n[1:-1, 1:-1, 2]), 1) and np.isnan(n[0]).all()
    assert images.resize(plane, 4, 3).shape == (3, 4) and images.resize(plane, 16, 12).tolist() == plane.tolist()
    assert np.isnan(images.erode(holes, 1, 0.5, 0.1)[4, 5])
    spike = plane.copy()
    spike[6, 6] = 50
    assert np.isnan(images.remove_outliers(spike, 2, 3.0)[6, 6])
    blob = np.exp(-((x - 8) ** 2 + (y - 6) ** 2) / 8.0)
    assert all(d.shape == blob.shape for d in images.difference_of_gaussians(blob, octaves=1)[0])
    df = spark.createDataFrame(pd.DataFrame({"idx": [0, 1, 2], "image": [plane.ravel().tolist(), None, [1.0]]}))
    out = images.per_image(df, "image", "g", 16, 12, images.gradient_magnitude).collect()
    assert np.allclose(np.reshape(out[0].g, (12, 16))[1:-1, 1:-1], 0.1) and out[1].g is None and out[2].g is None


def test_extrema_are_strict():
    dog = [np.zeros((9, 9)) for _ in range(3)]
    dog[1][4, 4] = 1.0
    dog[1][6, 6] = dog[1][6, 7] = 1.0
    assert images.extrema(dog, 0.5) == [(1, 4, 4)]


def test_projective_join(spark):
    cam = Camera(20.0, 20.0, 8.0, 6.0, 16, 12)
    y, x = np.mgrid[0:12, 0:16]
    rows = []
    for frame, z in ((0, 2.0), (1, 2.0), (2, 1.0)):
        rows += [(frame, int(u), int(v), float((u - 8) / 20 * z), float((v - 6) / 20 * z), z, 0.0, 0.0, -1.0) for u, v in zip(x.ravel(), y.ravel())]
    pixels = spark.createDataFrame(rows, "frame long, u int, v int, x double, y double, z double, nx double, ny double, nz double")
    eye = np.eye(4).ravel().tolist()
    pairs = spark.createDataFrame([(0, 1, eye), (2, 0, eye), (0, 2, eye)], "i long, j long, transform array<double>")
    dense = verify.projective_join(pixels, pairs, cam)
    got = {(r.i, r.j): r for r in verify.pair_quality(dense).collect()}
    assert got[0, 1].matches == 192 and got[0, 1].error == pytest.approx(0) and got[0, 1].share == 1
    assert got[2, 0].matches == 0 and (0, 2) not in got  # in front: an occluder; behind: unseen
    assert [(r.i, r.j) for r in verify.verified_pairs(verify.pair_quality(dense)).collect()] == [(0, 1)]
    assert verify.overlapping_pairs(pairs, dense).count() == 1
    assert not verify.trajectory_valid(verify.pair_quality(dense)).first().valid


def test_solver_recovers_poses_and_drops_the_bad_pair(spark):
    rng = np.random.default_rng(5)
    true = {f: (np.eye(4) if f == 0 else se3.exp_se3(0.3 * rng.normal(size=(1, 6)))[0]) for f in range(4)}
    rows = []
    for i, j in ((0, 1), (1, 2), (2, 3), (0, 3), (0, 2)):
        for w in rng.normal(size=(12, 3)):
            p, q = (np.linalg.inv(true[f]) @ [*w, 1] for f in (i, j))
            rows.append((i, j, *map(float, p[:3]), *map(float, q[:3])))
    links = spark.createDataFrame(rows, "i long, j long, px double, py double, pz double, qx double, qy double, qz double")
    start = {f: se3.exp_se3(0.05 * rng.normal(size=(1, 6)))[0] @ m if f else m for f, m in true.items()}
    got, energies = solver.solve_poses(solver.pair_moments(links), start)
    assert energies[-1] < 1e-12 and all(np.allclose(got[f], true[f], atol=1e-6) for f in true)
    wrong = spark.createDataFrame([(1, 3, *map(float, rng.normal(size=6) * 3)) for _ in range(3)], links.schema)
    fixed, left = solver.refine(links.union(wrong), start, worst_residual=0.01)
    assert all(np.allclose(fixed[f], true[f], atol=1e-5) for f in true) and left.filter("i = 1 and j = 3").count() == 0


def test_sphere_surface(spark):
    n, size, radius = 20, 0.1, 0.7
    rows = [(x, y, z, float(np.sqrt(((np.array([x, y, z]) * size - 1.0) ** 2).sum()) - radius), 1.0) for x in range(n) for y in range(n) for z in range(n)]
    voxels = spark.createDataFrame(rows, "x int, y int, z int, sdf double, weight double")
    mesh = surface.weld(surface.extract_surface(voxels, size), 1e-6).cache()
    area = surface.surface_area(mesh).first().area
    assert area == pytest.approx(4 * np.pi * radius**2, rel=0.03)
    edges = {}
    for r in mesh.collect():
        corners = [tuple(np.round(np.array(v) * 1e6).astype(int)) for v in r]
        for a, b in zip(corners, [*corners[1:], corners[0]]):
            edges[frozenset((a, b))] = edges.get(frozenset((a, b)), 0) + 1
    assert set(edges.values()) == {2}  # closed
    assert surface.cells(voxels.filter("x = 0")).count() == 0


def test_march_blocks(spark):
    spark.udtf.register("march", surface.MarchBlocks)
    got = [(r.bx, r.by, r.bz) for r in spark.sql("select * from march(0.5D, 0.5D, 0.5D, 2.5D, 0.6D, -0.7D)").collect()]
    assert got[0] == (0, 0, 0) and got[-1] == (2, 0, -1) and all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(got, got[1:]))
    rays = spark.createDataFrame([(0.5, 3.5), (0.5, 1.5)], "a double, b double").createOrReplaceTempView("rays")
    assert rays is None and spark.sql("select distinct m.* from rays, lateral march(a, 0D, 0D, b, 0D, 0D) m").count() == 4
