import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.operators import chunks, graph, matching, trajectory, voxels
from framequarry.sources import frames, sinks
from framequarry.streaming import online


def test_container_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    depth = rng.uniform(0.5, 4, (5, 12, 16)).round(3)
    depth[2, 0, 0] = np.nan
    path = tmp_path / "a.frames"
    frames.write_container(str(path), 16, 12, [(i, d, None if i == 3 else np.eye(4)) for i, d in enumerate(depth)])
    rows = frames.read_frames(spark, str(tmp_path)).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(5)) and rows[3].pose is None and rows[0].pose == np.eye(4).ravel().tolist()
    assert np.allclose(np.array(rows[1].depth, float).reshape(12, 16), depth[1], atol=1e-3) and rows[2].depth[0] is None
    some = frames.read_frames(spark, str(tmp_path)).filter("idx >= 2 and idx < 4")
    assert sorted(r.idx for r in some.collect()) == [2, 3]
    assert frames.pixels(frames.read_frames(spark, str(path))).filter("frame = 2").count() == 191


def test_depth_codec(spark):
    values = [0, 65535, 1, 1, 1, 40000]
    df = spark.createDataFrame([(values,), (None,), ([],)], "d array<int>")
    assert [r.x for r in df.select(frames.unpack_depth(frames.pack_depth("d")).alias("x")).collect()] == [values, None, []]


def test_sinks(spark, tmp_path):
    poses = spark.createDataFrame([(1, np.eye(4).ravel().tolist()), (0, None), (2, [float("-inf")] * 16)], "idx long, pose array<double>")
    sinks.write_poses(poses, str(tmp_path / "poses"))
    assert [r.value for r in spark.read.text(str(tmp_path / "poses")).collect()] == ["1 0.0 0.0 0.0 0.0 0.0 0.0 1.0"]
    mesh = spark.createDataFrame([([0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([1.0, 0.0, 0.0], [1.0, 1.0, 0.0], [0.0, 1.0, 0.0])], "v0 array<double>, v1 array<double>, v2 array<double>").coalesce(1)
    sinks.write_mesh(mesh, str(tmp_path / "mesh"))
    text = "".join(p.read_text() for p in (tmp_path / "mesh").glob("*.ply"))
    assert "element vertex 4" in text and "element face 2" in text
    times = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 1, 5.0)], "stage string, frame long, ms double")
    assert {r.stage: (r["0"], r["1"]) for r in sinks.timing_table(times, [0, 1]).collect()} == {"a": (1.0, 3.0), "b": (None, 5.0)}
    assert {r.stage: r.ms for r in sinks.timing_means(times).collect()} == {"a": 2.0, "b": 5.0}
    valid = spark.createDataFrame([(True,), (True,), (False,)], "valid boolean")
    assert sinks.run_summary(valid, 800).first().valid and not sinks.run_summary(valid, 799).first().valid


@pytest.mark.parametrize("count,want", [(0, []), (1, []), (10, []), (11, [10]), (21, [20]), (22, [20])])
def test_chunks(spark, count, want):
    rows = spark.range(count).select(F.col("id").alias("idx"))
    out = chunks.overlapping_chunks(rows, 10).groupBy("chunk").count().collect()
    assert {r.chunk: r["count"] for r in out} == {c: min(11, count - 10 * c) for c in range(-(-count // 10))}
    assert [r.idx for r in rows.filter(chunks.closes(F.col("idx"), 10)).filter(F.col("idx") == F.lit((count - 1) // 10 * 10)).collect()] == want[-1:]


def test_added_and_removed_samples_cancel(spark):
    rng = random.Random(1)
    a = [(rng.randint(-2, 2), rng.random(), rng.choice([1.0, 2.0]), 1) for _ in range(60)]
    b = [(rng.randint(-2, 2), rng.random(), 1.0, 1) for _ in range(40)]
    kind = "x int, value double, weight double, sign int"
    whole = {r.x: r for r in online.fuse_batch(spark.createDataFrame(a + b + [(*r[:3], -1) for r in a] + [(9, 1.0, 1.0, 1), (9, 1.0, 1.0, -1)], kind), ["x"]).collect()}
    alone = {r.x: r for r in online.fuse_batch(spark.createDataFrame(b, kind), ["x"]).collect()}
    assert whole[9].mean is None and whole[9].weight == 0
    for x, r in alone.items():
        assert whole[x].mean == pytest.approx(r.mean) and whole[x].weight == pytest.approx(r.weight)


def test_stream_of_samples_equals_the_batch(spark, tmp_path):
    rows = spark.range(100).selectExpr("int(id % 5) as x", "double(id) as value", "1D as weight", "int(if(id % 10 = 0, -1, 1)) as sign").repartition(4)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = online.VoxelTable(str(tmp_path / "voxels"), ["x"])
    table.start(stream, str(tmp_path / "ckpt")).awaitTermination()
    assert {r.x: (r.mean, r.weight, r.samples) for r in table.read(spark).collect()} == {r.x: (r.mean, r.weight, r.samples) for r in online.fuse_batch(rows, ["x"]).collect()}


def test_stream_of_chunks(spark, tmp_path):
    order = list(range(25))
    random.Random(2).shuffle(order)
    for k in range(5):
        (tmp_path / f"in{k}.json").write_text("".join(json.dumps({"session": s, "idx": i, "value": float(i)}) + "\n" for s in ("a", "b") for i in order[5 * k : 5 * k + 5]))
    stream = spark.readStream.schema("session string, idx long, value double").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    q = online.closed_chunks(stream, 10).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.session, r.chunk, r["first"], r["last"], r.total) for r in spark.table("closed").collect())
    assert got == [(s, c, 10.0 * c, 10.0 * c + 10, sum(range(10 * c, 10 * c + 11))) for s in ("a", "b") for c in (0, 1)]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 5), (8, 9), *[(20 + i, 21 + i) for i in range(30)]], "u long, v long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 8: 8, 9: 8, **{20 + i: 20 for i in range(31)}}
    nodes = spark.createDataFrame([(i,) for i in range(4)], "n long")
    assert [r.n for r in graph.isolated(nodes, edges, "n", "u", "v").collect()] == [0]
    links = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.9), (1, 2, 0.9)], "i long, j long, r double")
    top = graph.worst(links, [], "r", ["i", "j"]).first()
    assert (top.i, top.j, top.r) == (0, 2, 0.9)
    assert graph.drop_pairs(links, links.filter("j = 2"), ["i", "j"]).count() == 1
    assert {r.idx: r.previous for r in graph.linked_frames(spark.range(3).select(F.col("id").alias("idx")), links).collect()} == {0: None, 1: 0, 2: 1}
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 2.0, 4.0, 6.0)], "node long, x double, y double, z double")
    t = graph.tracks(edges, points).filter("root = 1").first()
    assert (t.x, t.y, t.z, t.members) == (1.0, 2.0, 3.0, 2)


def test_ties_in_matching_are_deterministic(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0])], "i long, vi array<double>")
    b = spark.createDataFrame([(7, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [0.0, 1.0])], "j long, vj array<double>")
    d = matching.distances(a, b)
    assert d.count() == 3
    assert [r.j for r in matching.best_matches(d, ["i"], ["dist", "j"], 2).orderBy("rank").collect()] == [5, 7]
    assert matching.mutual_ratio_matches(a, b).count() == 0
    assert [r.j for r in matching.mutual_ratio_matches(a, b.filter("j <> 7")).collect()] == [5]


def test_trajectories(spark):
    eye = np.eye(4)
    move = eye.copy()
    move[0, 3] = 2
    m = lambda x: x.ravel().tolist()
    local = spark.createDataFrame([(i, m(move), i != 2) for i in range(4)], "idx long, local_pose array<double>, valid boolean")
    whole = spark.createDataFrame([(0, m(eye)), (1, m(move))], "chunk long, pose array<double>")
    got = {r.idx: r.pose for r in trajectory.complete(whole, local, 2).collect()}
    assert got[0][3] == 2 and got[3][3] == 4 and got[2] is None
    poses = spark.createDataFrame([(0, m(eye)), (3, m(eye))], "idx long, pose array<double>")
    rebased = {r.idx: r.pose for r in trajectory.rebase(poses, whole, spark.createDataFrame([(0, m(move)), (1, m(move))], whole.schema), 2).collect()}
    assert rebased[0][3] == -2 and rebased[3][3] == 0
    a = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0), (9, 1.0, 1.0, 1.0)], "idx long, x double, y double, z double")
    b = spark.createDataFrame([(0, 3.0, 4.0, 0.0), (1, 0.0, 0.0, 0.0)], a.schema)
    e = trajectory.trajectory_error(a, b).first()
    assert e.frames == 2 and e.rmse == pytest.approx(np.sqrt(12.5))


def test_voxel_helpers(spark):
    v = spark.createDataFrame([(0, 0, 0.4), (0, 1, 2.7), (1, 0, 0.9)], "b int, i int, weight double")
    assert [r.b for r in voxels.live_blocks(v, ["b"]).collect()] == [0] and voxels.collect_garbage(v, ["b"]).count() == 2
    assert sorted(r.weight for r in voxels.starve(v).collect()) == [0, 0, 1]
    c = spark.createDataFrame([(0, 1, 100), (0, 2, 200), (0, 3, 101), (1, 1, 7)], "b int, seq int, c int")
    assert {r.b: r.colour for r in voxels.blend_colours(c, ["b"], "seq", "c").collect()} == {0: 116.0, 1: 7.0}
    grid = spark.createDataFrame([(x, y, z) for x in range(-3, 4) for y in range(-3, 4) for z in range(-3, 4)], "x int, y int, z int")
    inside = {(r.x, r.y, r.z) for r in voxels.chunks_in_sphere(grid, (0.2, 0.0, 0.0), 2.0, 1.0).collect()}
    want = {(x, y, z) for x, y, z in [(r.x, r.y, r.z) for r in grid.collect()] if (abs(x - 0.2) + 0.5) ** 2 + (abs(y) + 0.5) ** 2 + (abs(z) + 0.5) ** 2 <= 4.0}
    assert inside == want
    left = spark.createDataFrame([(0, 1.0, 2.0, 2)], "x int, mean double, weight double, samples long")
    assert voxels.merge(left, left.withColumn("mean", F.lit(4.0)), ["x"]).first().mean == 2.5
    assert voxels.look_up(spark.createDataFrame([(0,), (5,)], "x int"), left, ["x"]).filter("weight = 0").count() == 1
    levels = spark.createDataFrame([(0, 500), (1, 100), (2, 60), (3, 10)], "level int, n int")
    assert sorted(r.level for r in chunks.thin_levels(levels, "level", "n", 150).collect()) == [1, 2, 3]
    log = online.retry(spark.createDataFrame([(1,), (2,), (3,)], "key long"), spark.createDataFrame([(1,), (1,), (2,)], "key long"), 2)
    assert [(r.key, r.attempt) for r in log.collect()] == [(3, 1), (2, 2)]
