import numpy as np
import pytest

from framequarry.functions.se3 import exp_se3
from framequarry.streaming.tracker import Chain, track, track_batch

SCHEMA = "session string, idx long, local array<double>"


def path(rng, frames, n):
    """World poses with the identity first, and each frame's pose in its chunk."""
    steps = exp_se3(rng.normal(size=(frames, 6)) * 0.1)
    world = [np.eye(4)]
    for s in steps[1:]:
        world.append(world[-1] @ s)
    local = [np.linalg.inv(world[max(i - 1, 0) // n * n]) @ world[i] for i in range(frames)]
    return world, local


def rows_of(spark, parts):
    return spark.createDataFrame([(s, i, None if m is None else m.ravel().tolist()) for s, i, m in parts], SCHEMA)


def by_frame(rows):
    return {(r.session, r.idx): (r.chunk, None if r.pose is None else np.round(r.pose, 9).tolist(), r.valid, r.recent) for r in rows}


def test_chain_gives_the_world_poses():
    world, local = path(np.random.default_rng(1), 35, 10)
    chain = Chain(10)
    got = [chain.add(i, m)[1] for i, m in enumerate(local)]
    assert np.allclose(got, world)


def test_invalid_frames_move_nothing(spark):
    world, local = path(np.random.default_rng(2), 25, 10)
    parts = [("a", i, None if i in (4, 5, 13) else m) for i, m in enumerate(local)] + [("b", 3, np.eye(4)), (None, 1, np.eye(4)), ("a", None, np.eye(4)), ("c", 0, np.full((4, 4), np.nan))]
    got = by_frame(track_batch(rows_of(spark, parts), 10, 3).collect())
    assert len(got) == 27
    for i in range(25):
        chunk, pose, valid, recent = got["a", i]
        assert chunk == max(i - 1, 0) // 10 and valid == (i not in (4, 5, 13)) and recent == list(range(max(0, i - 2), i + 1))
        assert pose is None if not valid else np.allclose(pose, world[i].ravel())
    assert got["b", 3][1] == np.eye(4).ravel().tolist() and got["c", 0][1] is None


def test_stream_equals_batch_also_after_a_restart(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = np.random.default_rng(3)
    parts = []
    for s in "ab":
        _, local = path(rng, 24, 10)
        parts += [(s, i, None if i % 7 == 3 else m) for i, m in enumerate(local)]
    order = rng.permutation(len(parts))
    shuffled = [parts[i] for i in order]
    cuts = [shuffled[:15], shuffled[15:30] + shuffled[:4], shuffled[30:]]

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = track(stream, 10, 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    for part in cuts[:2]:
        rows_of(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    rows_of(spark, cuts[2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()  # a new query from the checkpoint
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = track_batch(rows_of(spark, parts), 10, 3).collect()
    assert len(got) == len(want) and by_frame(got) == by_frame(want)


def test_a_gap_is_given_up_by_the_timer(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    _, local = path(np.random.default_rng(4), 6, 10)
    rows_of(spark, [("a", i, local[i]) for i in (0, 1, 3, 4)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = track(stream, 10, 2, patience=1).writeStream.format("memory").queryName("gap").option("checkpointLocation", str(tmp_path / "at")).trigger(processingTime="200 milliseconds").start()
    for _ in range(90):
        if spark.table("gap").count() == 4 or query.awaitTermination(1):
            break
    query.stop()
    assert sorted(r.idx for r in spark.table("gap").collect()) == [0, 1, 3, 4]
