import random

import pytest
from pyspark.sql import functions as F

from framequarry.streaming.admission import POLICIES, admit, drop, gated
from framequarry.streaming.cold import ColdStore


def voxels(spark, n=400, seed=1):
    rng = random.Random(seed)
    blocks = sorted({tuple(rng.randint(-12, 12) for _ in range(3)) for _ in range(n)})
    return spark.createDataFrame([(*b, i, rng.random()) for b in blocks for i in range(2)], "bx int, by int, bz int, i int, sdf double")


def test_moves_lose_no_voxel(spark, tmp_path):
    hot = voxels(spark)
    want = sorted(tuple(r) for r in hot.collect())
    store, rng = ColdStore(spark, str(tmp_path / "cold"), 0.5, per=4), random.Random(2)
    assert store.move_in((0, 0, 0), 1)[0] is None
    for k in range(5):
        centre = tuple(rng.uniform(-5, 5) for _ in range(3))
        hot = store.move_out(hot, centre, 3.0, k % 2, 2)
        if k % 2:
            came, done = store.move_in(centre, 2.5)
            hot = hot.unionByName(came).checkpoint()
            with pytest.raises(ValueError) if came.count() else pytest.MonkeyPatch.context():
                store.check(hot, ["i"])
            done()
        store.check(hot, ["i"])
    assert sorted(tuple(r) for r in hot.unionByName(store.rows().drop("cx", "cy", "cz")).collect()) == want


def test_only_touched_partitions_are_read(spark, tmp_path):
    store = ColdStore(spark, str(tmp_path / "cold"), 0.5, per=4)
    kept = store.move_out(voxels(spark), (0.0, 0.0, 0.0), 0.0)
    assert kept.count() == 0
    whole = store.rows()
    near = whole.filter(store._touched((0.0, 0.0, 0.0), 1.0))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cx" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = near.select(F.input_file_name().alias("f")).distinct().count()
    assert 0 < read < whole.select(F.input_file_name().alias("f")).distinct().count() / 4


def test_chunks_that_do_not_exist_stay(spark, tmp_path):
    store = ColdStore(spark, str(tmp_path / "cold"), 0.5, per=4, limit=1)
    kept = store.move_out(voxels(spark), (0.0, 0.0, 0.0), 0.0)
    assert kept.count() > 0 and kept.filter("bx between -4 and 7 and by between -4 and 7 and bz between -4 and 7").count() == 0


def test_drop_policies_count():
    items = list(range(40))
    assert drop(items, 40, "oldest", "s") == (items[1:], [0])
    kept, lost = drop(items, 40, "random_one", "s")
    assert len(lost) == 1 and sorted(kept + lost) == items and drop(items, 40, "random_one", "s") == (kept, lost)
    kept, lost = drop(items, 40, "every_tenth", "s")
    assert lost == [0, 10, 20, 30]
    kept, lost = drop(items, 40, "random_five_percent", "s")
    assert len(lost) == 2 + 4 and sorted(kept + lost) == items
    for policy in POLICIES:
        buffer, lost = admit([], list(range(100)), 20, policy, "0:a")
        assert len(buffer) <= 20 and sorted(buffer + lost) == list(range(100)) and buffer[-1] == 99
    with pytest.raises(ValueError):
        drop(items, 40, "newest", "s")


def test_gate_in_a_stream(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for low in (0, 30):
        spark.createDataFrame([("a", i) for i in range(low, low + 30)] + [("b", low), (None, 1)], "session string, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, seq long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = gated(stream, 10, 4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).filter("session = 'a'").collect()
    assert sorted(r.seq for r in rows if not r.dropped) == [20, 21, 22, 23, 50, 51, 52, 53]
    assert len([r for r in rows if r.dropped]) == 20 + 26
