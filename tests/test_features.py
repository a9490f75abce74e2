import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.functions import descriptor, se3
from framequarry.operators import features


def blob(u, v, n=40):
    y, x = np.mgrid[0:n, 0:n]
    return np.exp(-((x - u) ** 2 + (y - v) ** 2) / 18.0)


def test_detects_a_blob(spark):
    df = spark.createDataFrame([(0, blob(20, 18).ravel().tolist()), (1, None), (2, [1.0])], "idx long, image array<double>")
    found = features.detect(df, "image", 40, 40, least=0.02).collect()
    assert found and all(r.frame == 0 and abs(r.u - 20) <= 2 and abs(r.v - 18) <= 2 for r in found)


def test_orientation_and_descriptor_turn_with_the_image():
    y, x = np.mgrid[0:40, 0:40]
    ramp = 0.05 * x + blob(24, 20)
    one = features.orientations(features.window_votes(ramp, 20, 20, 4.0))
    assert len(one) >= 1 and min(abs(np.angle(np.exp(1j * a))) for a in one) < 0.4
    turned = np.rot90(ramp)
    two = features.orientations(features.window_votes(turned, 20, 19, 4.0))
    assert min(abs(np.angle(np.exp(1j * (a - one[0] + np.pi / 2)))) for a in two) < 0.3
    d = features.descriptors(ramp, 20, 20, one[0], 2.0)
    assert d.shape == (128,) and np.linalg.norm(d) == pytest.approx(1)
    e = features.descriptors(turned, 20, 19, one[0] - np.pi / 2, 2.0)
    assert d @ e > 0.95 > d @ features.descriptors(blob(10, 30), 20, 20, 0.0, 2.0)


def test_descriptor_columns(spark):
    r = spark.createDataFrame([([3.0, 4.0, 0.0],), ([0.0, 0.0, 0.0],)], "d array<double>").select(descriptor.normalise(F.col("d")).alias("n"), descriptor.to_bytes(F.transform("d", lambda x: x / 10)).alias("b"), descriptor.quantise(F.lit(-1.0)).alias("q")).collect()
    assert np.allclose(r[0].n, [np.sqrt(0.5), np.sqrt(0.5), 0]) and r[1].n == [0, 0, 0] and r[0].b == [154, 205, 0] and r[0].q == 0


def test_seeded_filter(spark):
    rng = np.random.default_rng(3)
    m = se3.exp_se3(rng.normal(size=(1, 6)))[0]
    src = rng.normal(size=(12, 3))
    dst = src @ m[:3, :3].T + m[:3, 3]
    dst[[2, 7]] += 1
    rows = [(1, i, float(i), *map(float, src[i]), *map(float, dst[i]), 30.0 * i, 10.0 * (i % 3), 0.0, 0.0) for i in range(12)]
    df = spark.createDataFrame(rows, "pair int, match_id long, dist double, sx double, sy double, sz double, tx double, ty double, tz double, u1 double, v1 double, u2 double, v2 double")
    assert features.filter_pairs_seeded(df, ["pair"]).first().kept == [i for i in range(12) if i not in (2, 7)]
    assert features.wide_pairs(df, ["pair"], 100.0).count() == 1 and features.wide_pairs(df, ["pair"], 1e6).count() == 0


def test_dense_frames(spark):
    df = spark.createDataFrame([(1, "a")], "idx long, x string")
    assert {r.idx: r.x for r in features.dense_frames(df, 3).collect()} == {0: None, 1: "a", 2: None}
