import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from framequarry.llm import trie
from framequarry.llm.queries import op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, id string, seq int, n string"


def conversations(rows):
    found = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            found[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in found.items()}


def rebuilt(turns):
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        head = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = turns.get(head, [])[:h] + turns[c][h:]
    return out


def brute(convs):
    nodes, kids = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    rows = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(p))))
        rows.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def made(rng, n=120):
    """Conversations with shared starts, copies, nulls, ties, repeated rows and a long one."""
    say = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(0, 3)))
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 2, 5, 9, 12])):
            rows.append((c, t if t else None, rng.choice(["user", "assistant", None]), rng.choice([say(), "same", None])))
    rows += [(-7 + i, t, "user", "hello") for i in range(8) for t in range(3)]
    for c in (200, 205, 206, 207, 210):
        rows += [(c, t, "user", f"turn {t}") for t in range(40)]
    rows += [(300, t, "user", str(t % 7)) for t in range(200)] + [(305, t, "user", str(t % 7)) for t in range(190)]
    rows += [(220, 1, "b", "z"), (220, 1, "a", "y"), (220, 1, "a", "x"), (220, 1, "a", "x"), (220, None, "u", "p"), (220, None, None, None), (None, 1, "user", "nobody")]
    return rows


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size,batch", [(4 << 20, 10_000), (1024, 7)])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, size, batch):
    rows = made(random.Random(4))
    spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(trie, "RANGE", size)
    monkeypatch.setattr(trie, "BLOCK", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert got(op13_prefix_trie(spark, str(tmp_path))) == brute(rebuilt(conversations(rows)))
        monkeypatch.setattr(trie, "BROADCAST", 0)
        if size < 1000:
            assert got(trie.prefix_trie(trie.sequences(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)))) == brute(conversations(rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_splitters_cut_and_their_prefixes_are_put_together(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(c, t, "user", "start" if t < 2 else str(rng.randint(0, 2))) for c in range(300) for t in range(rng.randint(0, 8))]
    monkeypatch.setattr(trie, "RANGE", 256)
    strings = trie.sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    cuts = trie.splitters(strings)
    assert len(cuts) > 5 and cuts == sorted(set(cuts)) and max(map(len, cuts)) <= trie.HEAD * trie.TOKEN
    assert got(trie.prefix_trie(strings)) == brute(conversations(rows))


def test_no_rows(spark):
    assert trie.prefix_trie(trie.sequences(spark.createDataFrame([], SCHEMA))).count() == 0
    only = trie.prefix_trie(trie.sequences(spark.createDataFrame([(None, 1, "a", "b", "", 1, "")], SCHEMA)))
    assert only.count() == 0


def coded(strings):
    out, before = [], b""
    for s in strings:
        lcp = trie.shared(before, s) if out else 0
        out.append((lcp, s[16 * lcp :], b"", 0, 1, b""))
        before = s
    return out


def test_merge_compares_no_shared_turn_twice():
    rng = random.Random(2)
    token = lambda i: bytes([i]) * 16
    start = b"".join(token(9) for _ in range(500))
    strings = sorted({start + b"".join(token(rng.randint(0, 3)) for _ in range(rng.randint(1, 9))) for _ in range(400)})
    for k in (1, 2, 3, 8, 13):
        runs = [coded(strings[i::k]) for i in range(k)]
        tree = trie.LoserTree(runs)
        merged = [(s, lcp) for s, lcp, _ in tree]
        assert [s for s, _ in merged] == strings
        assert [lcp for _, lcp in merged] == [0] + [trie.shared(a, b) for a, b in zip(strings, strings[1:])]
        assert tree.compared <= 501 * k + 12 * len(strings) * k.bit_length()  # the 500 shared turns once for each run, not once for each string
    assert not list(trie.LoserTree([[]]))


def test_shared():
    a = np.random.default_rng(1).integers(0, 2, 16 * 300, dtype=np.uint8).tobytes()
    for i in (0, 1, 2, 17, 63, 64, 200, 299):
        b = a[: 16 * i] + b"\xff" * 16 + a[16 * i + 16 :]
        assert trie.shared(a, b) == i == trie.shared(b, a, i // 2)
    assert trie.shared(a, a[:160]) == 10 and trie.shared(a, b"") == 0
