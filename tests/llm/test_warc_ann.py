import gzip
import hashlib

import numpy as np
from pyspark.sql import functions as F

from framequarry.llm import ann
from framequarry.llm.ann import Tables, learn, nearest_neighbours
from framequarry.llm.warc import read_records, read_warc, write_warc
from framequarry.llm.workspace import shared_dir


def test_round_trip_and_revisits(spark):
    long = "é<p>" * 400
    rows = [(1, "http://a/ b\r\nx", long), (2, None, long), (3, "u", None), (4, "u", ""), (5, "v", "short"), (6, "v", "short"), (None, "w", long), (7, "z", long + "\r\n\r\nWARC/1.1\r\n"), (8, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    path = shared_dir(spark, "warc")
    made = write_warc(pages, path)
    assert sum(m.records for m in made) == len(rows)
    got = {r.record_id: r for r in read_warc(spark, path).filter("record_type <> 'warcinfo'").collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        r = got[f"<urn:page:{'none' if i is None else i}>"]
        data = (html or "").encode()
        assert r.payload_digest == "sha1:" + hashlib.sha1(data).hexdigest() and r.http_headers["content-length"] == str(len(data))
        if i in (1, None):
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("revisit", "<urn:page:2>", b"")
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, data)
    raw = gzip.decompress(b"".join(open(m.file.removeprefix("file://"), "rb").read() for m in made))
    assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows) + len(made)


def test_filters_reach_the_reader_and_payloads_are_skipped(spark, tmp_path):
    path = shared_dir(spark, "warc")
    write_warc(spark.range(40).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(string(id), 2000) as html"), path)
    records = read_warc(spark, path)
    assert records.filter("record_type = 'warcinfo'").count() >= 1
    assert records.filter(F.col("target_uri").startswith("http://h/1")).count() == 11
    assert records.filter(F.col("record_id").isin("<urn:page:3>", "<urn:page:5>")).count() == 2
    assert records.filter("record_type <> 'response'").filter("target_uri is null").count() == records.filter("record_type = 'warcinfo'").count()
    assert read_warc(spark, path, payload=False).filter("payload is not null").count() == 0
    plain = tmp_path / "a.warc"
    files = [r.file for r in records.select("file").distinct().collect()]
    plain.write_bytes(b"".join(gzip.decompress(open(f.removeprefix("file://"), "rb").read()) for f in files))
    assert [len(r["payload"]) for r in read_records(str(plain), lambda r: r["record_id"] == "<urn:page:12>")] == [4000]
    cut_off = tmp_path / "b.warc"
    cut_off.write_bytes(plain.read_bytes()[:-3000])
    assert 0 < len(list(read_records(str(cut_off)))) < 40 + len(files)


def test_members_without_length_field(tmp_path):
    record = lambda i: b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <r%d>\r\nContent-Length: 5000\r\n\r\n" % i + bytes([65 + i]) * 5000 + b"\r\n\r\n"
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(gzip.compress(record(i)) for i in range(5)))
    assert [r["record_id"] for r in read_records(str(path))] == [f"<r{i}>" for i in range(5)]
    assert [r["payload"][:1] for r in read_records(str(path), lambda r: r["record_id"] in ("<r1>", "<r4>"))] == [b"B", b"E"]


def test_no_pages(spark):
    path = shared_dir(spark, "warc")
    assert write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path) == []
    assert read_warc(spark, path).count() == 0


def brute(rows, asks, k):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q in asks:
        if q in ok:
            best = sorted(((-float((ok[q] * v).sum()), i) for i, v in ok.items() if i != q))[:k]
            out += [(q, r + 1, i) for r, (_, i) in enumerate(best)]
    return out


def test_nearest_with_ties_and_bad_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(90)]
    rows += [(100 + i, rows[4][1]) for i in range(40)] + [(200, None), (201, [0.0] * 8), (202, [None, *[1.0] * 7]), (203, [float("nan"), *[1.0] * 7]), (204, [float("inf"), *[1.0] * 7]), (205, [-0.0, *[1.0] * 7]), (206, [0.0, *[1.0] * 7]), (207, [1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(ann, "ROWS", 40)
    monkeypatch.setattr(ann, "QUERIES", 10)
    got = nearest_neighbours(df, F.col("vec_id") % 5 == 0, k=6, recall=1.0, bits=64).orderBy("query_id", "rank").collect()
    want = brute([r for r in rows if r[0] != 207], [i for i, _ in rows if i % 5 == 0], 6)
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(found & {(q, i) for q, _, i in want}) >= 0.95 * len(want)
    exact = [(r.query_id, r["rank"], r.vec_id) for r in got if r.query_id in (100, 105, 110)]
    assert exact == [w for w in want if w[0] in (100, 105, 110)]
    few = nearest_neighbours(df.filter("vec_id < 3"), F.col("vec_id") == 0, k=6).collect()
    assert len(few) == 2
    assert nearest_neighbours(df.limit(0), F.lit(True)).count() == 0


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (500, 6), dtype=np.uint8)
    for radius in (0, 3, 7, 12, 20):
        tables = Tables(codes, radius)
        want = np.flatnonzero(np.bitwise_count(codes ^ codes[7]).sum(1) <= radius)
        assert tables.within(codes[7]).tolist() == want.tolist()


def test_codes_keep_the_nearest_close():
    x = np.random.default_rng(3).normal(size=(400, 16))
    codes = learn(x, 5, 0.9, 128)
    assert 0 < codes.radius < 128 and codes.encode(x).shape == (400, 16)


def test_isolated_vectors_of_clustered_data_get_all_their_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    x = np.concatenate([centres[i % 6] + rng.normal(size=16) * 0.01 for i in range(400)] + [rng.normal(size=16) * 0.8 for _ in range(12)]).reshape(-1, 16)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest_neighbours(df, (F.col("vec_id") >= 396) | (F.col("vec_id") % 40 == 0), k=20).collect()
    counts = {q: sum(r.query_id == q for r in got) for q in {r.query_id for r in got}}
    assert set(counts) == {*range(396, 412), *range(0, 396, 40)} and set(counts.values()) == {20}


def test_repeated_id_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], "a", 1), (1, [0.9, 0.1], "b", 2), (2, [0.5, 0.5], "c", 3), (None, [1.0, 1.0], "d", 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string, rank int")
    got = nearest_neighbours(df, F.col("vec_id") == 2, k=5).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(2, 1, 1), (2, 2, 1)]


def test_recall_at_the_querys_own_settings(spark):
    x = np.random.default_rng(6).normal(size=(1500, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect()}
    want = {(q, int(i)) for q in range(0, 1500, 20) for i in [j for j in np.argsort(-(x @ x[q]), kind="stable") if j != q][:20]}
    assert len(got & want) >= 0.9 * len(want) and len(got) == 75 * 20
