import random
import re
from collections import defaultdict

import numpy as np
import pytest

from framequarry.llm import ngramjoin
from framequarry.llm.ngramjoin import asked, jaccard_join, open_groups, shown, spare


WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def shingles(text, width):
    words = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else [])


def brute(rows, width, percent):
    """id, size, component, links: every pair compared."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
                links[a] += 1
                links[b] += 1
    ids = defaultdict(list)
    for a in range(len(sets)):
        ids[find(a)].append(sets[a][0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(((i, len(s), least[find(a)], links[a]) for a, (i, s) in enumerate(sets)), key=repr)


def same(df, rows, width, percent):
    got = jaccard_join(df, width=width, percent=percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, width, percent)


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_equals_brute_force(documents, width, percent):
    same(documents, [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()], width, percent)


@pytest.mark.parametrize("group,values", [(512, 1 << 19), (4, 1 << 19), (512, 500)])
def test_families_passages_and_copies(spark, monkeypatch, group, values):
    monkeypatch.setattr(ngramjoin, "GROUP", group)
    monkeypatch.setattr(ngramjoin, "VALUES", values)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage, base, rows = [word() for _ in range(40)], [word() for _ in range(100)], []
    for _ in range(50):  # unlike documents, most of which are a passage they share
        rows.append((len(rows), " ".join([*passage, *[word() for _ in range(rng.randint(1, 60))]])))
    for i in range(60):  # a family of near copies, more and more unlike the first
        copy = list(base)
        for j in range(i // 10):
            copy[(7 * j + i) % 100] = word()
        rows.append((len(rows), " ".join(copy)))
    rows += [(1000 + i, " ".join(base)) for i in range(30)] + [(None, " ".join(base[:-1])), (5, " ".join(base[1:])), (2000, "a b"), (2001, "A  b"), (2002, "a")]
    same(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows, 4, 85)


def test_empty_and_bad_settings(nothing):
    assert jaccard_join(nothing).count() == 0
    with pytest.raises(ValueError):
        jaccard_join(nothing, percent=20)


def test_linked_sets_show_common_values_and_are_led_to_each_other():
    rng = np.random.default_rng(1)
    for percent in (60, 85, 100):
        for _ in range(300):
            n = int(rng.integers(1, 80))
            both = np.sort(rng.choice(10_000, 2 * n, replace=False))
            x = both[rng.permutation(2 * n)[:n]]
            drop, add = rng.integers(0, n // 5 + 2, 2)
            y = np.union1d(x[min(drop, n - 1) :], rng.choice(10_000, add))
            common = len(np.intersect1d(x, y))
            if 100 * common < percent * (len(x) + len(y) - common):
                continue
            x.sort()
            seen = len(np.intersect1d(x[: shown(len(x), percent)], y[: shown(len(y), percent)]))
            assert common >= max(asked(len(x), percent), asked(len(y), percent))
            assert seen >= spare(asked(max(len(x), len(y)), percent))


def test_groups_below_the_bound_are_not_opened():
    near = [np.arange(i, i + 50).astype(np.uint64) for i in (0, 1, 2)]
    far = [np.arange(1000 * i, 1000 * i + 50).astype(np.uint64) for i in range(1, 6)]
    sets = near + far
    sizes, ones = np.array([50] * 8), np.ones(8, np.int64)
    label, links, compared = open_groups(sizes, np.array([0, 0, 0, 1, 1, 1, 1, 1]), sets, ones, 85)
    assert compared == 0 and not links.any()
    label, links, compared = open_groups(sizes, np.zeros(8, int), sets, ones, 85)
    assert compared == 3 and links.tolist() == [2, 2, 2, 0, 0, 0, 0, 0] and label[:3].tolist() == [0, 0, 0]
