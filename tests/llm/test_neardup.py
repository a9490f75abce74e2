import random
import re
from collections import defaultdict

import pytest

from framequarry.llm.components import components
from framequarry.llm.neardup import drop_near_duplicates, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def shingles(text, width):
    words = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else [])


def brute(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    group = defaultdict(list)
    for a in range(len(sets)):
        group[find(a)].append(sets[a][0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in group.items()}
    return sorted(((i, len(s), least[find(a)], i == least[find(a)]) for a, (i, s) in enumerate(sets)), key=repr)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_equals_brute_force(documents, width, percent):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = near_duplicates(documents, width=width, percent=percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, width, percent)


def test_chains_hot_groups_and_shared_passages(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(40)]
    rows, at = [], 0
    for _ in range(60):  # unlike documents that share a passage
        rows.append((at, " ".join([*passage, *[word() for _ in range(rng.randint(5, 120))]])))
        at += 1
    base = [word() for _ in range(100)]
    for i in range(60):  # a family of near copies, more and more unlike the first
        copy = list(base)
        for j in range(i // 6):
            copy[(7 * j + i) % 100] = word()
        rows.append((at, " ".join(copy)))
        at += 1
    rows += [(1000 + i, " ".join(base)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for block in (2048, 16):  # one task for the family, and many
        got = sorted((tuple(r) for r in near_duplicates(df, width=3, percent=85, block=block).collect()), key=repr)
        assert got == brute(rows, 3, 85)


def test_drop_keeps_one_of_each_group(documents):
    kept = drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 206 in ids and 207 not in ids and 208 not in ids and {201, 202, 203} <= set(ids)


def test_empty(nothing):
    assert near_duplicates(nothing).count() == 0
    assert drop_near_duplicates(nothing).count() == 0


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame([*zip(order, order[1:]), (500, 501), (501, 500), (7, 7)], "u long, v long")
    assert {(r.node, r.root) for r in components(df).collect()} == {(i, 0) for i in range(1, 200)} | {(501, 500)}
