import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.sources import bits, dump, frames, messages


@pytest.mark.parametrize("seed", range(6))
def test_bit_codec_round_trip(seed):
    rng = random.Random(seed)
    values = [rng.randint(0, 2047)]
    for _ in range(rng.randint(0, 900)):
        kind = rng.random()
        values.append(values[-1] if kind < 0.5 else min(2047, max(0, values[-1] + rng.randint(-2, 2))) if kind < 0.9 else rng.randint(0, 2047))
    values += [values[-1]] * rng.randint(0, 90)
    assert bits.decode_shifts(bits.encode_shifts(np.array(values)), len(values)).tolist() == values


def test_bit_layout():
    def packed(text):
        return np.packbits(np.frombuffer(text.encode(), np.uint8) - 48).tobytes()

    text = "0111" + "00000001010" + "11" + "11" + "10" + "00" + "01101" + "01100" + "010" + "00010" + "10"
    want = [10, 11, 12, 11, 11, 13, 11] + [11] * 7 + [10]
    assert bits.decode_shifts(packed(text), len(want)).tolist() == want
    assert bits.decode_shifts(packed("010" + "11111"), 36).tolist() == [0] * 36
    assert bits.decode_shifts(b"", 0).tolist() == [] and bits.encode_shifts(np.array([], int)) == b""
    with pytest.raises(ValueError):
        bits.decode_shifts(packed("0111"), 3)
    with pytest.raises(ValueError):
        bits.encode_shifts(np.array([4000]))


def test_packed_column_and_table(spark):
    values = [0, 0, 0, 0, 0, 0, 5, 900, 902, 1000]
    table = bits.shift_table(345_000.0, 1090.0)
    assert table[0] == 0 and table[90] == 345 and table[1090] == 0 and table[900] == 1816
    df = spark.createDataFrame([(values,), (None,), ([],)], "s array<int>")
    back = df.select(bits.unpack_shifts(bits.pack_shifts("s"), F.size("s")).alias("s"), bits.shifts_to_metres(F.col("s"), table).alias("m")).collect()
    assert [r.s for r in back] == [values, None, []]
    assert back[0].m[0] is None and back[0].m[7] == 1.816 and back[1].m is None and back[2].m == []


def made(n, seed=0):
    rng = np.random.default_rng(seed)
    depth = rng.uniform(0.5, 4, (n, 6, 8)).astype(np.float32)
    depth[:, 0, 0] = np.nan
    return depth, rng.integers(0, 256, (n, 3, 4, 4), dtype=np.uint8)


def test_dump_in_ranges_with_columns_and_filters(spark, tmp_path):
    depth, color = made(23)
    dump.write_dump(str(tmp_path / "a.dump"), depth, color, {"fx": 1.5})
    dump.write_dump(str(tmp_path / "b.dump"), depth[:2])
    dump.write_dump(str(tmp_path / "c.dump"), [])
    whole = dump.read_dump(spark, str(tmp_path), split=1000)
    assert whole.rdd.getNumPartitions() > 5
    rows = {(r.file[-6], r.idx): r for r in whole.collect()}
    assert len(rows) == 25 and rows["b", 1].color is None and rows["a", 3].camera == '{"fx": 1.5}'
    assert rows["a", 22].depth[0] is None and np.allclose(rows["a", 22].depth[1:], depth[22].ravel()[1:]) and rows["a", 22].color == color[22].tobytes()
    some = dump.read_dump(spark, str(tmp_path / "a.dump"), ["idx", "depth"], split=500).filter("idx > 4 and idx <= 6 and idx != 5")
    assert some.columns == ["idx", "depth"] and [r.idx for r in some.collect()] == [6] and some.rdd.getNumPartitions() <= 2
    with pytest.raises(ValueError):
        dump.write_dump(str(tmp_path / "d"), depth, color[:3])
    (tmp_path / "short.dump").write_bytes((tmp_path / "a.dump").read_bytes()[:-1])
    with pytest.raises(Exception, match="ends before"):
        dump.read_dump(spark, str(tmp_path / "short.dump")).count()


def test_one_container_is_many_tasks(spark, tmp_path):
    depth, _ = made(20)
    path = str(tmp_path / "a.frames")
    frames.write_container(path, 8, 6, [(100 + i, d, np.eye(4) if i % 2 else None) for i, d in enumerate(depth)])
    whole = frames.read_frames(spark, path, split=600)
    assert whole.rdd.getNumPartitions() > 3
    rows = {r.idx: r for r in whole.collect()}
    assert sorted(rows) == list(range(100, 120)) and rows[100].pose is None and rows[101].pose == np.eye(4).ravel().tolist()
    assert rows[119].depth[0] is None and np.allclose(np.array(rows[119].depth[1:], float), depth[19].ravel()[1:], atol=1e-3)
    some = whole.filter("idx = 107")
    assert [r.idx for r in some.collect()] == [107] and some.rdd.getNumPartitions() == 1
    data = (tmp_path / "a.frames").read_bytes()
    (tmp_path / "b.frames").write_bytes(data[: int.from_bytes(data[-16:-8], "little")])  # without its index
    assert sorted(r.idx for r in frames.read_frames(spark, str(tmp_path / "b.frames"), split=600).collect()) == list(range(100, 120))


def test_messages_come_once_over_a_restart(spark, tmp_path):
    folder, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "at")
    folder.mkdir()
    shifts, color = np.full((2, 3), 900), np.arange(18).reshape(2, 3, 3)

    def write(i):
        both = messages.camera_payload(shifts + i, color, {"number": i})
        half = messages.camera_payload(shifts, None, {"number": -1})
        messages.write_messages(str(folder / f"{i:04d}.msgs"), [(3, 10 * i, b"start" if i != 2 else b"stop"), (1, 10 * i + 1, half), (2, 10 * i + 2, b"m"), (1, 10 * i + 3, both), (9, 10 * i + 4, b"?")])

    def run():
        query = messages.stream_messages(spark, str(folder), 2).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        assert query.awaitTermination(90)

    for i in range(3):
        write(i)
    (folder / "9999.msgs.part").write_bytes(b"not whole")
    run()
    for i in range(3, 8):
        write(i)
    run()
    run()  # nothing new
    rows = spark.read.parquet(out)
    assert sorted(r.seq for r in rows.collect()) == sorted(10 * i + k for i in range(8) for k in range(5))
    found = messages.camera_frames(rows, bits.shift_table(345_000.0, 1090.0)).orderBy("seq").collect()
    assert [r.seq for r in found] == [10 * i + 3 for i in range(8)] and found[0].depth == [1.816] * 6 and found[0].color[:8] == bytes([0, 1, 2, 255, 3, 4, 5, 255])
    assert messages.calibration(rows).first().calibration == '{"number": 0}'
    assert messages.calibration(rows.limit(0)).first().calibration is None
    whole = messages.read_messages(spark, str(folder))
    assert whole.count() == 40 and whole.groupBy("kind").count().orderBy("kind").collect()[0]["count"] == 16
    assert sorted(r.seq for r in messages.recorded(whole).collect()) == sorted(10 * i + k for i in range(8) if i != 2 for k in (1, 3))


def test_admission_takes_so_many_files_a_batch(tmp_path):
    for i in range(7):
        messages.write_messages(str(tmp_path / f"{i}.msgs"), [(2, i, b"")])
    reader = messages.MessageStreamReader(str(tmp_path), 2)
    first = reader.latestOffset()
    assert first["last"].endswith("6.msgs") and reader.latestOffset() == first and len(reader.partitions({"last": ""}, first)) == 7
    for i in range(7, 12):
        messages.write_messages(str(tmp_path / f"{i + 60}.msgs"), [(2, i, b"")])
    second = reader.latestOffset()
    assert second["last"].endswith("68.msgs") and [p.path[-7:] for p in reader.partitions(first, second)] == ["67.msgs", "68.msgs"]
    assert reader.latestOffset()["last"].endswith("70.msgs")
