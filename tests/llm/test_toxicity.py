import random
import re
import zlib
from collections import Counter
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from framequarry.llm import textkernel
from framequarry.llm.sampling import fold
from framequarry.llm.toxicity import Index, Rows, Vocabulary, counted, grams, score_toxicity, train_toxicity

from .conftest import sentence


def plain_grams(text):
    words = re.findall(r"[a-z0-9\x80-\xff]+", "".join(chr(c + 32 if 65 <= c <= 90 else c) for c in (text or "").encode()))
    return [f" {w} "[i : i + 5] for w in words if len(w) > 3 for i in range(len(w) - 2)]


def random_rows(rng, n, terms):
    bounds, out, weights = [0], [], []
    for i in range(n):
        mine = np.flatnonzero(rng.random(terms) < (0.1 if i % 7 else 0))
        out.append(mine)
        w = rng.random(len(mine)) + 0.1
        weights.append(w / np.linalg.norm(w) if len(w) else w)
        bounds.append(bounds[-1] + len(mine))
    return Rows(np.array(bounds), np.concatenate(out), np.concatenate(weights))


def test_block_max_search_is_exact(monkeypatch):
    from framequarry.llm import toxicity

    monkeypatch.setattr(toxicity, "FULL", 12)
    rng = np.random.default_rng(3)
    rows, queries = random_rows(rng, 400, 60), random_rows(rng, 70, 60)
    index = Index(np.arange(400)[::-1].copy(), np.arange(400) % 2, rows, 60)
    assert len(index.full[0]) == 12 and len(index.weight)
    best, cosine, visited = index.nearest(queries, 9)
    dense = lambda r: r.dense(np.arange(60), 60)
    exact = dense(queries) @ dense(rows).T
    want = -np.sort(-exact, axis=1)[:, :9]
    assert np.allclose(cosine, np.where(want > 1e-9, want, 0))
    assert visited < 70 * index.blocks
    for q in range(70):
        for b, c in zip(best[q], cosine[q]):
            assert b < 0 or abs(exact[q, 399 - index.ids[b]] - c) < 1e-12


def test_counts_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(1)
    texts = pa.array([sentence(rng, n=rng.randint(0, 90)) for _ in range(20)] + [None, "", "É é!", sentence(rng, n=900), "a"])
    vocabulary = Vocabulary(np.unique(np.concatenate([h for *_, h in grams(texts)])))

    def flat():
        return [(sorted(zip(t[b[i] : b[i + 1]].tolist(), c[b[i] : b[i + 1]].tolist()))) for _, b, t, c in counted(texts, vocabulary) for i in range(len(b) - 1)]

    whole = flat()
    monkeypatch.setattr(textkernel, "PIECE", 700)
    assert flat() == whole
    assert [sorted(c for _, c in row) for row in whole] == [sorted(Counter(plain_grams(t)).values()) for t in texts.to_pylist()]


def test_scores_are_those_of_a_plain_search(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(260):
        words = sentence(rng, "en", rng.randint(3, 40)).split()
        if i % 4 == 0:
            words.insert(1, "vileword")
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(i % 4 == 0)))
    rows += [(1000, rows[4][1]), (1001, rows[4][1]), (1002, None), (1003, "")]
    docs, judged = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5000, 1)], "doc_id long, toxic int")
    model = train_toxicity(docs, judged, fold(F.col("id")) == 0)
    texts, label = dict(rows), dict(labels)
    frequency = Counter(g for t in texts.values() for g in set(plain_grams(t)))
    known = {i for i in label if zlib.crc32(str(i).encode()) % 5}
    examples = [i for i in sorted(known) if i in set(model.index.ids.tolist())]
    assert 0 < len(examples) < len(known) and 5000 not in model.index.ids
    vocabulary = {g for i in examples for g in plain_grams(texts[i])}
    holders = {c: Counter(g for i in examples if label[i] == c for g in set(plain_grams(texts[i]))) for c in (0, 1)}
    many = Counter(label[i] for i in examples)

    def contrast(g):
        have, lack = ([f(c) + 0.5 for c in (1, 0)] for f in (lambda c: holders[c][g], lambda c: many[c] - holders[c][g]))
        return abs(log(have[0] / lack[0]) - log(have[1] / lack[1])) / sqrt(sum(1 / x for x in have + lack))

    clear = {g: 0.1 + contrast(g) for g in vocabulary}

    def vector(text):
        w = {g: (1 + log(n)) * (log((1 + len(rows)) / (1 + frequency[g])) + 0.1) * clear[g] for g, n in Counter(plain_grams(text)).items() if g in vocabulary}
        size = sqrt(sum(x * x for x in w.values()))
        return {g: x / size for g, x in w.items()}

    held = [(i, vector(texts[i])) for i in examples]
    for r in score_toxicity(docs, judged).collect():
        q = vector(texts[r.doc_id])
        cosine = sorted(((round(sum(x * v.get(g, 0) for g, x in q.items()), 9), -i) for i, v in held), reverse=True)[:200]
        near = [(c, -i) for c, i in cosine if c > 1e-9]
        assert [e.id for e in r.evidence] == [i for _, i in near[:5]] and np.allclose([e.cosine for e in r.evidence], [c for c, _ in near[:5]], atol=1e-7)
        weight = [c / (1.05 - min(c, 1)) for c, _ in near]
        shares = [(sum(w for w, (_, i) in zip(weight[:k], near) if label[i]) + 0.01) / (sum(weight[:k]) + 0.02) for k in (15, 50, 200)]
        lead = sum([c for c, i in near if label[i]][:5]) - sum([c for c, i in near if not label[i]][:5])
        z = np.array([*[log(x / (1 - x)) for x in shares], 2 * lead, 1]) @ model.beta if near else model.base
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-6
    assert {r.score for r in score_toxicity(docs, judged).filter("doc_id in (1000, 1001)").collect()}.__len__() == 1


def test_long_texts_and_clashing_columns(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, sentence(rng, n=30) + (" nastyone" * (i % 2)), "x", 0.5) for i in range(80)] + [(90, sentence(rng, n=9000), "x", 0.5), (91, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, score double")
    judged = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(90, 0), (91, 0)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in score_toxicity(docs, judged).collect()}
    assert len(out) == 82 and np.mean([out[i].predicted == i % 2 for i in range(80)]) > 0.8
    assert out[90].evidence and not out[91].evidence
