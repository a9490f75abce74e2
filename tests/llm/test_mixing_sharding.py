import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np

from framequarry.llm.mixing import mix_sources, mixture
from framequarry.llm.sharding import pack, shard_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1)):
    """Shares by weight; what exceeds three times a source is shared again among the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        left = Fraction(sum(sizes.values()) - sum(3 * sizes[s] for s in capped))
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: float(3 * sizes[s] if s in capped else level * weight[s]) for s in order}
        capped |= over


def test_targets_and_taken(documents):
    assert mix_sources(documents).count() == documents.count()
    documents = documents.filter("doc_id is null or doc_id <> 200")  # one document that is most of its source
    out = mix_sources(documents).collect()
    sizes, taken, got = defaultdict(int), defaultdict(int), {}
    for r in out:
        assert r["size"] == len(WORD.findall(r.text or "")) and r.taken in {0, r["size"], 2 * r["size"], 3 * r["size"]}
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        got[r.source] = r["target"]
    want = targets(sizes)
    for s, t in want.items():
        assert abs(got[s] - t) < 1e-6 * max(1, t)
        assert abs(taken[s] - t) <= 0.1 * t + 60
    again = sorted((str(r.doc_id), r.text or "", r.taken) for r in mix_sources(documents.repartition(7)).select("doc_id", "text", "taken").collect())
    assert again == sorted((str(r.doc_id), r.text or "", r.taken) for r in out)


def test_many_even_documents_come_close(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "concat('s', id % 5) as source", "repeat('w ', int(1 + id % 37)) as text")
    rows = mix_sources(df).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 20 for r in rows)


def test_mixture_repeats_rows(documents, nothing):
    mixed = mixture(documents)
    assert mixed.columns == documents.columns
    want = sum(r.copies for r in mix_sources(documents).collect())
    assert mixed.count() == want
    assert mix_sources(nothing).count() == 0 and mixture(nothing).count() == 0


def test_shards(documents, nothing):
    rows = shard_documents(documents, 4).collect()
    texts = sorted(len((r.text or "").encode()) + 1 for r in documents.select("text").collect())
    assert sorted(r["size"] for r in rows) == texts
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(4))
    where = defaultdict(set)
    for r in rows:
        where[r["size"], r.text_crc32].add(r.shard)
    assert all(len(v) == 1 for v in where.values())
    one = next(r for r in rows if r.doc_id == 204)
    assert one.text_crc32 == zlib.crc32(b"one") and one["size"] == 4
    assert next(r for r in rows if r.doc_id == 201).text_crc32 == 0
    assert shard_documents(nothing, 4).count() == 0


def test_hot_group_is_dealt_out(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 2 = 0 then repeat('hot ', 50) else concat('text ', id, repeat(' x', int(id % 60))) end as text")
    rows = shard_documents(df, 8).groupBy("shard").agg({"size": "sum", "slot": "max", "*": "count"}).collect()
    loads = [r["sum(size)"] for r in rows]
    assert len(rows) == 8 and max(loads) - min(loads) <= 0.01 * np.mean(loads)
    assert all(r["max(slot)"] == r["count(1)"] - 1 for r in rows)


def test_pack_places_each_item_by_the_dot_product():
    rng = np.random.default_rng(0)
    items = np.column_stack([rng.integers(1, 1000, 500), rng.integers(1, 200, 500), np.ones(500)]).astype(float)
    left = np.tile(items.sum(0) / 8, (8, 1))
    placed = pack(items, left.copy())
    loads = np.stack([np.bincount(placed, items[:, i], 8) for i in range(3)], 1)
    assert (np.ptp(loads, axis=0) / loads.mean(0) < [0.01, 0.1, 0.1]).all()
    unit, rest, todo = items.sum(0), left.copy(), items.sum(0)
    for i in sorted(range(500), key=lambda i: (-(items[i] / unit) @ [1, 0.1, 0.1], i)):  # a plain reading of the rule
        x = items[i]
        scores = [sum(r[d] / todo[d] * x[d] / todo[d] * w for d, w in enumerate((1, 0.1, 0.1))) for r in rest]
        fits = [s for s in range(8) if rest[s][0] >= x[0]] or range(8)
        assert scores[placed[i]] >= max(scores[s] for s in fits) - 1e-9 and placed[i] in fits
        rest[placed[i]] -= x
        todo = todo - x


def test_chunks_balance_together(spark, monkeypatch):
    from framequarry.llm import sharding

    monkeypatch.setattr(sharding, "CHUNK", 50)
    df = spark.range(2000).selectExpr("id as doc_id", "concat('text ', id, repeat(' xy', int(id * 7919 % 97)), case when id = 5 then repeat('z', 40000) else '' end) as text", "1 as shard", "'q' as size")
    rows = shard_documents(df, 8).collect()
    loads = np.bincount([r.shard for r in rows], [r["size"] for r in rows], 8)
    assert len(rows) == 2000 and (loads.max() - loads.min()) / loads.mean() < 0.02
    assert len({(r.shard, r.slot) for r in rows}) == 2000
