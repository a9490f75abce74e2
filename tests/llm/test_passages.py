"""Part quotes and one-word changes of benchmark items, against brute force."""

import random
from functools import lru_cache

import numpy as np

from framequarry.llm.decontamination import Index, Rule, find_contamination, hold, normalise

from .conftest import sentence


def words(rng, n):
    return ["".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(2, 12))) for _ in range(n)]


def found(index, text):
    codes = normalise(text)[0]
    return {r[1] for r in index.regions(codes, np.array([0, len(codes)]))}


def test_part_quotes_and_one_word_changes():
    rng = random.Random(8)
    items = [(i, words(rng, rng.randint(13, 25))) for i in range(3)]
    index = Index([(i, " ".join(w)) for i, w in items], Rule())
    for i, w in items:
        if len(normalise(" ".join(w))[0]) < Rule().least:
            continue
        for a in range(len(w)):
            before, after = sentence(rng, "en", 40) + " ", " " + sentence(rng, "de", 40)
            quote = " ".join(w[a:])[:90]
            if len(normalise(quote)[0]) >= Rule().least:
                assert found(index, before + quote + after) == {i}
            for other in ("q" * len(w[a]), "q" * 20, "q"):
                assert found(index, before + " ".join([*w[:a], other, *w[a + 1 :]]) + after) == {i}


def test_hold_is_the_brute_force():
    rng = random.Random(9)

    @lru_cache(None)
    def edits(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(edits(a[1:], b[1:]) + (a[0] != b[0]), edits(a[1:], b) + 1, edits(a, b[1:]) + 1)

    def brute(a, b, k, run):
        n, m = len(a), len(b)
        ahead = [[min(edits(a[:i], b[s:j]) for s in range(j + 1)) for j in range(m + 1)] for i in range(n + 1)]
        back = [[min(edits(a[i:], b[j:e]) for e in range(j, m + 1)) for j in range(m + 1)] for i in range(n + 1)]
        spans = [(i, x) for i in range(n + 1) for x in range(i, min(n, i + run) + 1)], [(j, y) for j in range(m + 1) for y in range(j, min(m, j + run) + 1)]
        return min(ahead[i][j] + back[x][y] for i, x in spans[0] for j, y in spans[1]) <= k

    seen = set()
    for trial in range(50):
        a, b = ("".join(rng.choice("abcd") for _ in range(n)) for n in (9, 12))
        k, run = trial % 2, rng.randint(0, 4)
        code = lambda t: np.array([ord(c) for c in t], np.uint32)
        got = hold(code(a)[None, :], code(b), k, run)
        assert (got is not None) == brute(a, b, k, run)
        seen.add(got is not None)
        if got is not None:
            region = b[got[1] : got[2]]
            assert edits(a, region) <= got[3] <= k + run
    assert seen == {True, False}


def test_index_finds_what_a_search_of_every_passage_finds():
    rng = random.Random(10)
    rule = Rule()
    items = [(i, "".join(words(rng, n))) for i, n in enumerate((5, 6, 8, 12, 20))]
    index = Index(items, rule)
    for trial in range(15):
        number, item = items[trial % len(items)]
        n = min(len(item), rule.least)
        a = rng.randrange(len(item) - n + 1)
        piece = list(item[a : a + n])
        for _ in range(rng.randint(0, rule.budget(n) + 1)):
            piece[rng.randrange(len(piece))] = rng.choice("xyz")
        at, size = rng.randrange(len(piece)), rng.randint(0, rule.run(n) + 3)
        piece[at : at + size] = "v" * rng.randint(0, rule.run(n) + 3)
        text = "".join([*words(rng, 6), *piece, *words(rng, 6)])
        codes = normalise(text)[0]
        want = set()
        for i, other in items:
            c = normalise(other)[0]
            m = min(len(c), rule.least)
            if hold(np.lib.stride_tricks.sliding_window_view(c, m), codes, rule.budget(m), rule.run(m)):
                want.add(i)
        assert found(index, text) == want


def test_short_items_stand_exactly_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "Forty-two!"), (2, "ok"), (3, "--"), (4, None)], "item_id long, text string")
    rows = [(1, "the answer is forty two."), (2, "fortytwos"), (3, "is it OK, then"), (4, "okay"), (5, None), (6, "FORTY  TWO")]
    out = {r.doc_id: [m.item_id for m in r.matches] for r in find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert out == {1: [1], 2: [], 3: [2], 4: [], 5: [], 6: [1]}


def test_pieces_of_a_long_text_and_many_slices(spark, monkeypatch):
    from framequarry.llm import decontamination

    rng = random.Random(9)
    items = [(i, sentence(rng, "de", 14)) for i in range(20)]
    filler = lambda: sentence(rng, "en", rng.randint(100, 400))
    text = " ".join(x for _, t in items for x in (filler(), t)) + " Σίσυφος ΣΊΣΥΦΟΣ"
    docs = spark.createDataFrame([(1, text, "q"), (2, filler(), "q"), (3, None, None)], "doc_id long, text string, row string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = find_contamination(docs, bench).orderBy("doc_id").collect()
    assert {m.item_id for m in want[0].matches} == set(range(20)) and want[1].matches == [] == want[2].matches
    assert decontamination._matches(decontamination.Index(items, decontamination.Rule()), [text])[0] == [m.asDict() for m in want[0].matches]
    monkeypatch.setattr(decontamination, "PIECE", 1500)
    pieces = decontamination._matches(decontamination.Index(items, decontamination.Rule()), [text])[0]
    assert {m["item_id"] for m in pieces} == set(range(20)) and all(any(p["item_id"] == m.item_id and abs(p["start"] - m.start) < 60 for p in pieces) for m in want[0].matches)
    monkeypatch.setattr(decontamination, "SLICE", 400)
    sliced = find_contamination(docs, bench).orderBy("doc_id").collect()
    assert [r.asDict(True) for r in sliced] == [r.asDict(True) for r in want]
