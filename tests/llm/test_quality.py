import random

import numpy as np
import pyarrow as pa
import pytest

from framequarry.llm import quality, textkernel
from framequarry.llm.quality import drop_low_quality, features, fit_view, moments, score_quality, train_quality

from .conftest import sentence


@pytest.fixture(scope="module")
def pages(spark):
    """Bad pages have marks behind every word, so their words are longer too; most are not labelled."""
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        text = " ".join(w + ("###" if bad else "") for w in sentence(rng, "en", rng.randint(30, 60)).split())
        rows.append((i, text, "en", f"s{i % 4}", len(text), "x", 1.0))
        if i % 3 == 0:
            labels.append((i, int(not bad)))
    rows += [rows[10], (2000, sentence(rng, "en", 90_000), "en", "s1", 900_000, "x", 1.0), (2001, None, None, None, None, None, None), (None, "no id", "en", "s1", 5, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label string, quality double")
    return docs.repartition(3), spark.createDataFrame([*labels, (9999, 0), (None, 1)], "doc_id long, quality int")


def test_both_views_exchange_labels_and_count(pages):
    docs, labels = pages
    model = train_quality(docs, labels)
    assert len(model.given) == 2 and all(n > 0 for handed in model.given for n in handed)
    assert (model.weights[:2] > 0.2).all()
    alone = train_quality(docs, labels, rounds=0)
    assert alone.given == () and not np.allclose(alone.text.beta, model.text.beta)
    out = score_quality(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "label", "quality", "text_quality", "meta_quality"]
    rows = out.collect()
    assert len(rows) == 904 and len({r.quality for r in rows if r.doc_id == 10}) == 1
    assert np.mean([(r.quality >= 0.5) == (r.doc_id % 5 != 0) for r in rows if r.doc_id is not None and r.doc_id < 900]) > 0.97
    assert next(r for r in rows if r.doc_id == 2000).quality > 0.5 and next(r for r in rows if r.doc_id == 2001).quality == 0
    assert drop_low_quality(docs, labels).columns == docs.columns


def test_fit_is_that_of_all_rows_at_once(spark, pages):
    """The model from sums over partitions equals least squares on the collected rows."""
    docs, labels = pages
    model = train_quality(docs, labels, rounds=0)
    label = {r.doc_id: r.quality for r in labels.collect()}
    from framequarry.llm.sampling import fold

    kept = docs.filter(fold(docs["doc_id"]) != 1).collect()
    kept = [r for r in kept if r.doc_id is not None and r.doc_id in label]
    text = np.concatenate([t for _, t, _ in features(pa.array([r.text for r in kept]), np.array([r.n_chars for r in kept], float), np.zeros(len(kept), int), np.zeros(len(kept), int))])
    y = np.array([label[r.doc_id] for r in kept], float)
    plain = fit_view(moments(text.astype(np.float16).astype(float), y, np.ones(len(y))))
    assert np.allclose(plain.beta, model.text.beta, atol=1e-6)


def test_features_do_not_depend_on_runs(monkeypatch):
    rng = random.Random(4)
    texts = pa.array([sentence(rng, n=rng.randint(0, 40)) for _ in range(30)] + [None, "", " a  a b"])
    n = len(texts)
    args = (np.full(n, np.nan), np.zeros(n, int), np.zeros(n, int))
    one = np.concatenate([np.concatenate([t, m], 1) for _, t, m in features(texts, *args)])
    monkeypatch.setattr(quality, "ROWS", 4)
    assert np.allclose(one, np.concatenate([np.concatenate([t, m], 1) for _, t, m in features(texts, *args)]))
    stats = one[-1, 256 + quality.WORDS : quality.TEXT]
    assert stats[0] == pytest.approx(1 / 3) and stats[1] == pytest.approx(2 / 3) and not one[-2, : quality.TEXT].any()
    monkeypatch.setattr(textkernel, "PIECE", 60)
    long = np.concatenate([t for _, t, _ in features(texts, *args)])
    assert np.allclose(long[:, :256], one[:, :256])
