import numpy as np
from pyspark.sql import functions as F

from framequarry.functions.camera import Camera
from framequarry.operators import images, matching, raster, verify


def test_presence_patches_and_lists(spark):
    set_ = {(0, 0), (1, 0), (0, 1), (1, 1), (5, 3), (6, 2)}
    df = spark.createDataFrame([(1, u, v) for u, v in set_], "frame long, u int, v int")
    got = {(r.level, r.u, r.v): r.n for r in raster.presence(df, ["frame"], 3).collect()}
    assert got[1, 0, 0] == 4 and got[1, 2, 1] == 1 and got[2, 1, 0] == 2 and got[3, 0, 0] == 6
    listed = sorted((r.place, r.u, r.v) for r in raster.listed(df, ["frame"]).collect())
    assert [p for p, _, _ in listed] == list(range(6)) and {(u, v) for _, u, v in listed[:4]} == {(0, 0), (1, 0), (0, 1), (1, 1)}
    whole = spark.createDataFrame([(1, u, v, (u, v) in set_) for u in range(8) for v in range(4)], "frame long, u int, v int, ok boolean")
    found = raster.patches(whole, ["frame"], F.col("ok"))
    assert {(r.u, r.v): (r.some, r.every) for r in found.filter("some").collect()} == {(0, 0): (True, True), (2, 1): (True, False), (3, 1): (True, False)}
    assert [(r.u, r.v, r.number) for r in raster.patch_numbers(found, ["frame"]).orderBy("number").collect()] == [(0, 0, 0), (2, 1, 1), (3, 1, 2)]


def test_depth_interval_of_blocks(spark):
    camera = Camera(10.0, 10.0, 8.0, 6.0, 16, 12)
    eye = np.eye(4).ravel().tolist()
    blocks = spark.createDataFrame([(0, eye, 0, 0, 2), (0, eye, 0, 0, 4), (0, eye, 0, 0, -3)], "frame long, transform array<double>, bx int, by int, bz int")
    got = {(r.u, r.v): (r.near, r.far) for r in raster.ray_intervals(blocks, camera, 0.1).collect()}
    assert np.allclose(got[9, 7], (1.55, 3.95)) and all(n < f for n, f in got.values()) and (0, 0) not in got


def test_match_frames_equals_pairwise(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4, 30, 8))
    x[1, :20] = x[0, :20] + rng.normal(size=(20, 8)) * 0.1
    x[3, 5:25] = x[1, :20]
    x /= np.linalg.norm(x, axis=-1, keepdims=True)
    points = spark.createDataFrame([(f, f * 100 + k, x[f, k].tolist()) for f in range(4) for k in range(30)] + [(2, 999, None)], "frame long, key long, descriptor array<double>")
    frames = spark.createDataFrame([(f, f != 2) for f in range(4)], "frame long, valid boolean")
    pairs = matching.earlier_pairs(frames)
    assert sorted((r.i, r.j) for r in pairs.collect()) == [(0, 1), (0, 3), (1, 3)]
    assert sorted((r.i, r.j) for r in matching.earlier_pairs(frames, 1).collect()) == [(0, 1)]
    got = {(r.i, r.j, r.key_i, r.key_j): r.dist for r in matching.match_frames(points, pairs).collect()}
    want = {}
    for i, j in ((0, 1), (0, 3), (1, 3)):
        side = lambda f, k, v: points.filter((F.col("frame") == f) & F.col("descriptor").isNotNull()).select(F.col("key").alias(k), F.col("descriptor").alias(v))
        want |= {(i, j, r.i, r.j): r.dist for r in matching.mutual_ratio_matches(side(i, "i", "vi"), side(j, "j", "vj")).collect()}
    assert set(got) == set(want) and len(got) > 30 and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_evaluation(spark):
    pairs = spark.createDataFrame([(0, 2, True), (1, 2, True), (0, 1, True), (3, 2, False), (4, 2, True)], "i long, j long, overlaps boolean")
    matches = spark.createDataFrame([(0, 2, 0.01), (0, 2, 0.5), (1, 2, 0.02), (3, 2, 0.0)], "i long, j long, error2 double")
    got = {r.j: (r.total, r.detected, r.correct) for r in verify.evaluation_counts(pairs, matches, 0.04).collect()}
    assert got == {2: (3, 2, 1), 1: (1, 0, 0)}
    assert {(r.i, r.j): (r.n, r.share) for r in verify.pair_counts(matches).collect()} == {(0, 2): (2, 1.0), (1, 2): (1, 0.5), (3, 2): (1, 0.5)}
    assert {r.node: r.others for r in verify.neighbours(matches).collect()} == {0: [2], 1: [2], 2: [0, 1, 3], 3: [2]}


def test_agreeing_depths(spark):
    camera = Camera(10.0, 10.0, 8.0, 6.0, 16, 12)
    moved = np.eye(4)
    moved[2, 3] = 0.5
    keys = spark.createDataFrame([(1, 0, 8, 6, 2.0), (2, 0, 4, 4, 2.0)], "key long, chunk long, u int, v int, depth double")
    poses = spark.createDataFrame([(0, 1, moved.ravel().tolist()), (0, 2, np.eye(4).ravel().tolist())], "chunk long, frame long, transform array<double>")
    pixels = spark.createDataFrame([(1, 8, 6, 1.53), (2, 8, 6, 2.2), (2, 4, 4, None)], "frame long, u int, v int, depth double")
    got = {r.key: (round(r.depth, 9), r.frames) for r in verify.agreeing_depth(keys, poses, pixels, camera).collect()}
    assert got == {1: (2.015, 2), 2: (2.0, 1)}


def test_stencils_of_the_depth(spark):
    rng = np.random.default_rng(1)
    image, depth = rng.normal(size=(9, 12)), rng.uniform(0.8, 2.5, (9, 12))
    depth[4, 4] = np.nan
    got = images.adaptive_smooth(image, depth, 1.0, 0.5)
    for y, x in ((0, 0), (5, 7), (8, 11)):
        s = 1.0 / depth[y, x]
        r = int(np.ceil(2 * s))
        cells = [(image[b, a], np.exp(-((a - x) ** 2 + (b - y) ** 2) / (2 * s * s))) for a in range(max(0, x - r), min(12, x + r + 1)) for b in range(max(0, y - r), min(9, y + r + 1)) if abs(depth[b, a] - depth[y, x]) < 0.5]
        assert abs(got[y, x] - sum(v * w for v, w in cells) / sum(w for _, w in cells)) < 1e-12
    assert np.isnan(got[4, 4])
    v, u = np.mgrid[0:9, 0:12].astype(float)
    points = np.stack([u, v, 0.5 * u + v], -1)
    assert np.allclose(images.sobel_normals(points)[3, 3], np.array([-0.5, -1, 1]) / 1.5) and np.isnan(images.sobel_normals(points)[0]).all()
    du, dv = images.derivatives(points)
    assert np.allclose(du[3, 3], (1, 0, 0.5)) and np.allclose(dv[3, 3], (0, 1, 1))
    flat = np.ones((9, 12, 3))
    assert np.allclose(images.smooth_planes(flat, 1.0, 0.1), 1)
    hole = np.ones((9, 9))
    hole[4, 4] = np.nan
    assert images.dilate(hole, np.ones((9, 9)))[4, 4] == 1 and np.isnan(images.dilate(np.full((9, 9), np.nan), np.ones((9, 9)))).all()
    step = np.where(u < 6, 1.0, 2.0)
    assert (images.edge_mask(step, 0.5)[:, 5:7] == 0).all() and images.edge_mask(step, 0.5).sum() == 90
    assert images.least_of(np.array([1.0, 0.0]), np.array([0.0, 0.0])).tolist() == [0, 0]
    assert np.isnan(images.strong_gradients(np.array([0.003]), np.array([0.003]))).all() and images.strong_gradients(np.array([3.0]), np.array([4.0]))[0] == 5
    up = images.upsample(u, 1)
    assert up.shape == (18, 24) and np.allclose(up[0, :5], (0, 0.5, 1, 1.5, 2)) and up[0, -1] == 11


def test_images_of_several_columns(spark):
    df = spark.createDataFrame([(1, [1.0] * 6, [2.0] * 6), (2, None, [2.0] * 6), (3, [1.0] * 5, [1.0] * 6)], "idx long, a array<double>, b array<double>")
    got = {r.idx: r.c for r in images.per_image(df, ["a", "b"], "c", 3, 2, lambda a, b: a + b).collect()}
    assert got == {1: [3.0] * 6, 2: None, 3: None}
    deep = spark.createDataFrame([(1, [float(i) for i in range(18)])], "idx long, a array<double>")
    assert images.per_image(deep, "a", "c", 3, 2, lambda a: a[..., 2]).first().c == [2.0, 5.0, 8.0, 11.0, 14.0, 17.0]
