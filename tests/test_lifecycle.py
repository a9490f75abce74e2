import random

import pytest

from framequarry.operators.graph import components
from framequarry.streaming.lifecycle import Lifecycle

SCHEMA = "session string, chunk long, aligned boolean, links array<long>, valid array<boolean>"


def batch(spark, rows):
    return spark.createDataFrame([(*r, [True, False, True]) if len(r) == 4 else r for r in rows], SCHEMA)


def states(life):
    return {(r.session, r.chunk): (r.state, r.attempt) for r in life.chunks().collect()}


def test_chunks_are_processed_retried_lost_and_cancelled(spark, tmp_path):
    life = Lifecycle(spark, str(tmp_path / "t"), most=3)
    life.add(batch(spark, [("a", 0, True, []), ("a", 1, True, [0]), ("a", 2, True, [1]), ("a", 3, False, [2]), ("a", 4, True, [3, None]), ("b", 0, False, []), ("b", 1, True, [0]), (None, 1, True, [0])]), 0)
    assert states(life) == {("a", 0): ("processed", 1), ("a", 1): ("processed", 1), ("a", 2): ("processed", 1), ("a", 3): ("invalid", 1), ("a", 4): ("waiting", 1), ("b", 0): ("invalid", 1), ("b", 1): ("cancelled", 1)}
    life.add(batch(spark, [("a", 5, True, [4]), ("a", 6, True, [9]), ("a", 1, False, []), ("b", 2, True, [1])]), 1)
    assert states(life)["a", 4] == ("waiting", 2) and states(life)["a", 5] == ("waiting", 1) and states(life)["a", 1] == ("processed", 1) and states(life)["b", 2] == ("cancelled", 1)
    life.add(batch(spark, [("a", 7, True, [2, 6])]), 2)  # 7 is linked to 6, which is the newest that waits
    assert states(life)["a", 6] == ("processed", 2) and states(life)["a", 7] == ("processed", 1) and states(life)["a", 4] == ("waiting", 2)
    life.add(batch(spark, [("a", 8, True, [7, 5])]), 3)  # 5 is the newest now and brings no 4: that isn't tried in this batch
    assert states(life)["a", 5] == ("processed", 2)
    assert life.flush() == 1 and states(life)["a", 4] == ("processed", 3)  # by the link of 5
    frames = {(r.session, r.idx): r.valid for r in life.frames(2).collect()}
    assert frames["a", 0] is True and frames["a", 1] is False and frames["a", 6] is False and frames["a", 8] is True and frames["b", 2] is False


def test_a_killed_epoch_runs_again(spark, tmp_path, monkeypatch):
    source, place = str(tmp_path / "in"), str(tmp_path / "t")
    parts = [[("a", 0, True, []), ("a", 2, True, [1])], [("a", 1, True, [0])], [("a", 3, False, [2]), ("a", 4, True, [2])]]
    for p in parts:
        batch(spark, p).coalesce(1).write.mode("append").parquet(source)

    class Failing(Lifecycle):
        def add(self, rows, epoch):
            super().add(rows, epoch)
            if epoch == 1:  # the table is written, the epoch isn't committed
                raise RuntimeError("killed")

    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    with pytest.raises(Exception, match="killed"):
        Failing(spark, place).start(stream(), str(tmp_path / "at")).awaitTermination()
    life = Lifecycle(spark, place)
    assert life.start(stream(), str(tmp_path / "at")).awaitTermination(180)
    life.flush()
    whole = Lifecycle(spark, str(tmp_path / "whole"))
    for i, p in enumerate(parts):
        whole.add(batch(spark, p), i)
    whole.flush()
    assert states(life) == states(whole)
    assert {k: v[0] for k, v in states(life).items()} == {("a", 0): "processed", ("a", 1): "processed", ("a", 2): "processed", ("a", 3): "invalid", ("a", 4): "processed"}
    assert len(life._epochs()) == len(set(life._epochs())) and life.chunks().count() == 5


def test_components_by_stars(spark):
    order = list(range(150))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame([*zip(order, order[1:]), (500, 501), (501, 500), (7, 7), (900, 900), (None, 3)], "u long, v long")
    assert {(r.node, r.root) for r in components(df).collect()} == {(i, 0) for i in range(150)} | {(500, 500), (501, 500), (900, 900)}
    assert components(df.limit(0)).count() == 0
