import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framequarry.llm import textkernel
from framequarry.llm.decontamination import Index, Rule, align, drop_contaminated, find_contamination, normalise
from framequarry.llm.language import identify_languages, train_languages
from framequarry.llm.quality import drop_low_quality, score_quality, train_quality
from framequarry.llm.sampling import fold
from framequarry.llm.toxicity import score_toxicity

from .conftest import sentence


def test_words_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(0)
    texts = pa.array([sentence(rng, n=rng.randint(0, 300)) for _ in range(30)] + [None, "", "  ", "x" * 5000, "a b " * 3000])
    whole = [(f.tolist(), c.tolist()) for _, f, c in textkernel.words(texts)]
    flat = lambda runs: ([x for f, _ in runs for x in f], [x for _, c in runs for x in c])
    monkeypatch.setattr(textkernel, "PIECE", 1000)
    assert flat([(f.tolist(), c.tolist()) for _, f, c in textkernel.words(texts)]) == flat(whole)
    assert flat(whole)[1] == [len((t or "").split()) for t in texts.to_pylist()]


def test_languages(documents, nothing):
    train = documents.filter("doc_id is not null and doc_id < 100")
    model = train_languages(train)
    out = {r.doc_id: r for r in identify_languages(documents, model).collect()}
    test = [r for i, r in out.items() if i is not None and 100 <= i < 120]
    assert np.mean([r.lang_pred == r.lang for r in test]) == 1.0
    assert all(out[i].lang_pred == "und" and out[i].lang_score == 0 for i in (201, 202, 203, 209))
    assert out[211].lang_pred in ("en", "de") and all(0 <= r.lang_score <= 1 for r in out.values())
    assert identify_languages(nothing, model).count() == 0
    bare = identify_languages(documents, train_languages(nothing))
    assert {r.lang_pred for r in bare.collect()} == {"und"} and bare.count() == documents.count()


def test_texts_without_letters_are_unknown(spark, documents):
    model = train_languages(documents.filter("doc_id is not null and doc_id < 100"))
    rows = [(1, "3 141 592 653 " * 50), (2, "— … 🙂 " * 50), (3, "3 141 592 653 " * 50 + "π"), (4, "語"), (5, None), (6, "_" * 300 + "a")]
    out = {r.doc_id: r.lang_pred for r in identify_languages(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert {i for i, lang in out.items() if lang == "und"} == {1, 2, 5}


def test_fold_is_the_checksum(spark):
    rows = spark.range(50).select("id", fold(F.col("id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_contamination(spark, documents, nothing):
    rng = random.Random(5)
    items = [(i, sentence(rng, "en", 30)) for i in range(20)] + [(50, "short"), (51, None), (52, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    edited = list(items[3][1])
    edited[40] = "q"
    rows = [(1000, "before it " + items[0][1].upper().replace(" ", "\n - ") + " and after"), (1001, sentence(rng, "de", 200) + " " + "".join(edited)), (1002, items[1][1][: len(items[1][1]) // 8]), (1003, None)]
    extra = documents.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id: r.matches for r in find_contamination(extra, bench).collect()}
    assert {m.item_id for m in found[1000]} == {0} and {m.item_id for m in found[1001]} == {3} and found[1002] == [] and found[1003] == []
    assert max(m.edits for m in found[1001]) >= 1
    m = found[1000][0]
    span = rows[0][1].lower()[m.start : m.end]
    assert normalise(span)[0].tobytes() in normalise(items[0][1])[0].tobytes()
    kept = [r.doc_id for r in drop_contaminated(extra, bench).collect()]
    assert not {1000, 1001} & set(kept) and len(kept) >= extra.count() - 3  # the very long text has a passage by chance
    assert find_contamination(nothing, bench).count() == 0
    assert find_contamination(documents, bench.limit(0)).filter("size(matches) > 0").count() == 0


def test_contamination_in_slices(spark, monkeypatch):
    from framequarry.llm import decontamination

    monkeypatch.setattr(decontamination, "SLICE", 600)
    rng = random.Random(6)
    items = [(i, sentence(rng, "de", 30)) for i in range(12)]
    docs = spark.createDataFrame([(i, sentence(rng, "en", 50) + " " + t) for i, t in items], "doc_id long, text string")
    found = find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, x.item_id) for r in found.collect() for x in r.matches} == {(i, i) for i in range(12)}


def test_bands_find_every_region_within_the_budget():
    rng = random.Random(2)
    rule = Rule()
    items = [(i, sentence(rng, "en", 40)) for i in range(5)]
    index = Index(items, rule)
    for trial in range(60):
        number, piece = index.segments[trial % len(index.segments)]
        codes = piece.tolist()
        for _ in range(rule.budget(len(piece))):
            at, how = rng.randrange(len(codes)), rng.randrange(3)
            codes[at : at + (how != 1)] = [] if how == 2 else [rng.randint(97, 122)]
        text = np.array([*normalise(sentence(rng, "de", 20))[0], *codes, *normalise(sentence(rng, "de", 20))[0]], np.uint32)
        assert number in {r[1] for r in index.regions(text, np.array([0, len(text)]))}


def test_align_is_the_edit_distance():
    rng = random.Random(4)
    for _ in range(60):
        a = np.array([rng.randint(0, 3) for _ in range(12)], np.uint32)
        b = np.array([rng.randint(0, 3) for _ in range(15)], np.uint32)
        best = 99
        for i in range(len(b) + 1):
            for j in range(i, len(b) + 1):
                row = list(range(j - i + 1))
                for x in range(len(a)):
                    new = [x + 1]
                    for y in range(j - i):
                        new.append(min(row[y] + (a[x] != b[i + y]), row[y + 1] + 1, new[-1] + 1))
                    row = new
                best = min(best, row[-1])
        got = align(a, b, 4)
        assert (got is None) == (best > 4) and (got is None or got[2] == best)


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        bad, toxic = i % 6 == 0, i % 5 == 1
        words = sentence(rng, "en" if i % 2 else "de", rng.randint(30, 90)).split()
        if toxic:
            words[3:3] = ["vileword"]
            words[9:9] = ["nastyone"]
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)
        rows.append((i, text, "en", "s1", len(text)))
        if i < 500:
            labels.append((i, int(not bad), int(toxic)))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0)]
    labels += [(None, 1, 1), (3, None, None), (4, 1, 0), (4, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(judged, nothing):
    docs, labels = judged
    out = {r.doc_id: r for r in score_quality(docs, train_quality(docs, labels)).collect()}
    assert all((out[i].quality >= 0.5) == (i % 6 != 0) for i in range(600))
    assert out[900].quality == 0 and out[901].quality == 0
    kept = drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(600) if i % 6}
    assert drop_low_quality(nothing, labels).count() == 0
    assert score_quality(docs, train_quality(docs, labels.limit(0))).count() == docs.count()


def test_toxicity(judged, nothing):
    docs, labels = judged
    out = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    held = [r for i, r in out.items() if i < 600 and r.held_out]
    assert len(out) == 602 and np.mean([r.predicted == (r.doc_id % 5 == 1) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values()) and out[900].predicted == 0 and out[900].score == out[901].score
    hit = next(r for r in held if r.predicted)
    assert hit.evidence and all(zlib.crc32(str(e.id).encode()) % 5 != 0 for e in hit.evidence)
    assert score_toxicity(nothing, labels).count() == 0
    assert len({r.score for r in score_toxicity(docs, labels.limit(0)).collect()}) == 1
