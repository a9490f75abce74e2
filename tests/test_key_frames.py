import numpy as np

from framequarry.functions.camera import Camera
from framequarry.functions.se3 import exp_se3
from framequarry.operators import cache, fusion, images, verify

CAMERA = Camera(20.0, 20.0, 11.5, 8.5, 24, 18, 0.1, 10.0)


def test_cache_equals_the_single_operators(spark):
    rng = np.random.default_rng(1)
    depth, light = rng.uniform(1, 1.04, (18, 24)), rng.uniform(0, 1, (18, 24))
    depth[5, 6] = np.nan
    cells = lambda m: [None if np.isnan(x) else float(x) for x in m.ravel()]
    df = spark.createDataFrame([(4, cells(depth), cells(light)), (5, None, cells(light)), (6, cells(depth)[1:], cells(light))], "idx long, depth array<double>, intensity array<double>")
    small = cache.small_frames(df, CAMERA, 12, 9)
    (r,) = small.collect()
    smooth = images.smooth(depth, 2.0, 0.05)
    points = images.back_project(smooth, CAMERA.fx, CAMERA.fy, CAMERA.cx, CAMERA.cy)
    full = lambda x: np.array([np.nan if v is None else v for v in x])
    assert r.frame == 4 and np.allclose(full(r.depth), images.resize(smooth, 12, 9).ravel(), equal_nan=True)
    assert np.allclose(full(r.normals).reshape(9, 12, 3)[..., 2], images.resize(images.normals(points)[..., 2], 12, 9), equal_nan=True)
    dim = images.resize(images.smooth(light, 1.0), 12, 9)
    assert np.allclose(full(r.intensity), dim.ravel()) and np.allclose(full(r.dy), images.sobel(dim)[1].ravel(), equal_nan=True)
    rows = cache.cached_pixels(small).collect()
    want = np.isfinite(full(r.normals).reshape(-1, 3)).all(1) & np.isfinite(full(r.points).reshape(-1, 3)).all(1)
    assert len(rows) == want.sum() > 0 and all(np.isclose(x.z, full(r.points).reshape(9, 12, 3)[x.v, x.u, 2]) for x in rows)


def test_tracks_become_key_points(spark):
    move = exp_se3(np.array([[0.0, 0.1, 0.0, 0.2, 0.0, 0.0]]))[0]
    world = np.array([[0.1, 0.0, 2.0], [-0.3, 0.2, 2.5], [9.0, 0.0, 1.0], [0.2, 0.1, 3.0]])
    seen = (world - move[:3, 3]) @ move[:3, :3]
    rows = [(0, f, k, *map(float, p[k]), 1.0 + f, [float(f), float(k)]) for f, p in ((0, world), (1, seen)) for k in range(4)]
    keys = spark.createDataFrame(rows + [(0, 2, 0, 0.0, 0.0, 1.0, 1.0, [0.0])], "chunk long, frame long, key long, x double, y double, z double, scale double, descriptor array<double>")
    links = spark.createDataFrame([(0, k, 1, k) for k in (0, 1, 2)] + [(1, 1, 2, 0)], "i long, key_i long, j long, key_j long")
    poses = spark.createDataFrame([(0, np.eye(4).ravel().tolist()), (1, move.ravel().tolist())], "frame long, transform array<double>")
    got = {r.key: r for r in fusion.fuse_chunks(keys, links, poses, CAMERA).collect()}
    assert sorted(got) == [0, 1]  # 2 is outside the image, 3 has no link
    for k, r in got.items():
        assert np.allclose([r.x, r.y, r.z], world[k]) and r.members == 2 and r.scale == 1.0 and r.descriptor == [0.0, float(k)] and r.frame == 0
        assert np.allclose([r.u, r.v], [20 * world[k][0] / world[k][2] + 11.5, 20 * world[k][1] / world[k][2] + 8.5])


def test_poses_are_handed_on(spark):
    a, b = exp_se3(np.random.default_rng(2).normal(size=(2, 6)))
    flat = lambda m: m.ravel().tolist()
    chunks = spark.createDataFrame([(0, flat(a)), (1, flat(b))], "chunk long, pose array<double>")
    local = spark.createDataFrame([(0, flat(np.eye(4)), True), (9, flat(a), True), (10, flat(b), True), (11, flat(a), False), (20, None, True)], "idx long, local_pose array<double>, valid boolean")
    got = {r.chunk: np.reshape(r.pose, (4, 4)) for r in fusion.next_starts(chunks, local, 10).collect()}
    assert sorted(got) == [1, 2] and np.allclose(got[1], a @ b) and np.allclose(got[2], b)


def test_states_of_frames(spark):
    states = spark.createDataFrame([(0, "integrated"), (1, "queued"), (2, "queued"), (3, "invalid")], "idx long, state string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "idx long")
    after = fusion.confirm(states, ids(1, 1, 3, 9))
    assert {r.idx: r.state for r in after.collect()} == {0: "integrated", 1: "integrated", 2: "queued", 3: "invalid"}
    left, removals = fusion.invalidate(after, ids(0, 2))
    assert {r.idx: r.state for r in left.collect()} == {0: "invalid", 1: "integrated", 2: "invalid", 3: "invalid"}
    assert [(r.idx, r.op) for r in removals.collect()] == [(0, "remove")]


def test_overlap_by_reference_poses(spark):
    v, u = np.mgrid[0:18, 0:24]
    p = np.stack([(u - 11.5) / 20 * 2, (v - 8.5) / 20 * 2, np.full(u.shape, 2.0)], -1)
    rows = [(f, int(x), int(y), *map(float, p[y, x]), 0.0, 0.0, -1.0) for f in range(4) for y in range(18) for x in range(24)]
    pixels = spark.createDataFrame(rows, "frame long, u int, v int, x double, y double, z double, nx double, ny double, nz double")

    def at(shift):
        m = np.eye(4)
        m[0, 3] = shift
        return m.ravel().tolist()

    poses = spark.createDataFrame([(0, at(0.0)), (1, at(1.0)), (2, at(2.2))], "frame long, transform array<double>")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (0, 3)], "i long, j long")
    assert {(r.i, r.j): r.overlaps for r in verify.reference_overlap(pixels, pairs, poses, CAMERA).collect()} == {(0, 1): True, (0, 2): False, (1, 2): True, (0, 3): False}
