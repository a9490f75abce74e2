"""Prefix tree of conversations by an LCP-aware external mergesort.

1. A turn becomes a token of 16 bytes (SHA-256 of role and text, cut), a
   conversation the string of its tokens; texts never move.  Equal conversations
   become one string with a weight.
2. The strings' order is cut into ranges by splitters from a sample.  Map tasks
   write sorted *runs* for each range.  A run's string is stored as the number of
   leading turns it shares with the one before it (its LCP) and the turns after
   those.  Spark's exchange is the external memory of the runs.
3. For each range a loser tree merges the runs.  Strings are compared by their LCPs
   with the last output first, and only from there on turn by turn, so turns
   that are known to be shared are not compared again.
4. The merged stream keeps a stack of the open path.  A string that shares ``l``
   turns with its predecessor finishes every node deeper than ``l``.
5. Only nodes that are prefixes of a splitter can have members in two ranges.
   Those (the *spine*, at most ``HEAD`` + 1 for each splitter) leave as sums of
   each range and are put together by key.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import cut, split_join

#: Bytes of a token; turns of a string that a splitter may have.
TOKEN, HEAD = 16, 64
#: Token bytes that a range holds, about; ids that are joined into one block.
RANGE, BLOCK = 4 << 20, 4096
#: Rows that are broadcast after they were counted, at most.
BROADCAST = 100_000
ROOT = bytes(TOKEN)
EMPTY = hashlib.sha256(b"").hexdigest()


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def sequences(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn -> one row for each key: ``id``, ``seq`` (tokens), ``sizes`` (UTF-8 bytes of each text, 32-bit integers).

    Turns are in order of ``turn``, null first; equal turns in order of role, then
    text.  Texts are carried to be ordered only for keys and turns that repeat,
    which are counted first.  Rows with a null key are left out.
    """
    named = rows.filter(F.col(key).isNotNull())
    at = [F.col(key).cast("long").alias("id"), F.col(turn).alias("t")]
    token = F.unhex(F.substring(F.sha2(F.concat(F.length(_text(role)).cast("string"), F.lit(":"), _text(role), _text(text)), 256), 1, 2 * TOKEN))
    size = F.octet_length(_text(text)).alias("size")
    twice = cut(named.select(*at).groupBy("id", "t").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("id").alias("id2"), F.col("t").alias("t2")), "twice")
    many = twice.count()
    turns = named.select(*at, token.alias("token"), size, *([_text(role).alias("r"), _text(text).alias("x")] if many else []))
    tie = F.lit(None).cast("struct<r:string,x:string>")
    if many:
        twice = F.broadcast(twice) if many <= BROADCAST else twice
        turns = turns.join(twice, (F.col("id") == F.col("id2")) & F.col("t").eqNullSafe(F.col("t2")), "left")
        tie = F.when(F.col("id2").isNotNull(), F.struct("r", "x"))
    slim = turns.select("id", "t", tie.alias("tie"), "token", "size")
    return slim.repartition("id").sortWithinPartitions(F.col("id"), F.col("t").asc_nulls_first(), F.col("tie")).select("id", "token", "size").mapInArrow(_joined, "id long, seq binary, sizes binary")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of id -> one row an id; a conversation may span batches."""
    now, seq, sizes = None, bytearray(), bytearray()
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        tokens, lengths = b"".join(batch.column(1).to_pylist()), batch.column(2).to_numpy().astype(np.int32).tobytes()
        starts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]]).tolist()
        done = []
        for s, e in zip(starts, starts[1:]):
            if ids[s] != now:
                if now is not None:
                    done.append((now, bytes(seq), bytes(sizes)))
                now, seq, sizes = int(ids[s]), bytearray(), bytearray()
            seq += tokens[TOKEN * s : TOKEN * e]
            sizes += lengths[4 * s : 4 * e]
        if done:
            yield _batch(done, ["id", "seq", "sizes"], [pa.int64(), pa.binary(), pa.binary()])
    if now is not None:
        yield _batch([(now, bytes(seq), bytes(sizes))], ["id", "seq", "sizes"], [pa.int64(), pa.binary(), pa.binary()])


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def swapped_start(seqs: DataFrame, other: Column, turns: Column) -> DataFrame:
    """Each row's first ``turns`` turns replaced by those of the row with id ``other`` (all if fewer, none if absent)."""
    heads = seqs.select(F.col("id").alias("head_id"), F.col("seq").alias("head_seq"), F.col("sizes").alias("head_sizes"))
    both = seqs.withColumn("other", other).withColumn("swap", turns.cast("int")).join(heads, F.col("other") == F.col("head_id"), "left")

    def mixed(head: str, own: str, width: int) -> Column:
        first = F.coalesce(F.substring(head, F.lit(1), F.col("swap") * width), F.lit(b""))
        return F.concat(first, F.substring(own, F.col("swap") * width + 1, F.length(own)))

    return both.select("id", mixed("head_seq", "seq", TOKEN).alias("seq"), mixed("head_sizes", "sizes", 4).alias("sizes"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, id) in order -> digest, first id, number of ids, ids joined by commas; BLOCK ids at most."""
    now, ids = None, []
    for batch in batches:
        done = []
        for digest, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest != now or len(ids) == BLOCK:
                if ids:
                    done.append((now, ids[0], len(ids), ",".join(map(str, ids)).encode()))
                now, ids = digest, []
            ids.append(i)
        yield _batch(done, ["digest", "id", "n", "ids"], [pa.binary(), pa.int64(), pa.int64(), pa.binary()])
    if ids:
        yield _batch([(now, ids[0], len(ids), ",".join(map(str, ids)).encode())], ["digest", "id", "n", "ids"], [pa.binary(), pa.int64(), pa.int64(), pa.binary()])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of (digest, id) -> for each digest its least id, number of ids, SHA-256 of all ids joined."""
    now, least, n, state = None, 0, 0, None
    for batch in batches:
        done = []
        for digest, i, m, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if digest != now:
                if now is not None:
                    done.append((least, n, state.digest()))
                now, least, n, state = digest, i, 0, hashlib.sha256()
            elif n:
                state.update(b",")
            state.update(ids)
            n += m
        yield _batch(done, ["id", "n", "ends"], [pa.int64(), pa.int64(), pa.binary()])
    if now is not None:
        yield _batch([(least, n, state.digest())], ["id", "n", "ends"], [pa.int64(), pa.int64(), pa.binary()])


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """Leading tokens that ``a`` and ``b`` share, if they share ``at`` at least."""
    i, end = at * TOKEN, min(len(a), len(b))
    step = TOKEN
    while i < end:  # longer and longer stretches while they agree, shorter ones where they don't
        if a[i : min(end, i + step)] == b[i : min(end, i + step)]:
            i, step = min(end, i + step), step * 2
        elif step == TOKEN:
            break
        else:
            step = max(TOKEN, step // 4 // TOKEN * TOKEN)
    return i // TOKEN


def splitters(strings: DataFrame) -> list[bytes]:
    """Ascending strings that cut the order into ranges of about RANGE bytes, each as short as tells it from the sampled one before."""
    total = strings.agg(F.coalesce(F.sum(F.length("seq") + TOKEN), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    ranges = max(-(-total["bytes"] // RANGE), min(int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")), total["bytes"] // (RANGE // 16)))
    if ranges < 2:
        return []
    taken = strings.sample(min(1.0, HEAD * ranges / total["n"]), 0) if HEAD * ranges < total["n"] else strings
    found = sorted((bytes(r.head), r.size) for r in taken.select(F.substring("seq", 1, HEAD * TOKEN).alias("head"), (F.length("seq") + TOKEN).alias("size")).collect())
    edges = np.cumsum([size for _, size in found])
    chosen = set()
    for i in range(1, ranges):
        j = int(np.searchsorted(edges, edges[-1] * i / ranges))
        if 0 < j < len(found) and found[j][0] != found[j - 1][0]:
            chosen.add(found[j][0][: TOKEN * (shared(found[j - 1][0], found[j][0]) + 1)])
    return sorted(chosen)


def _runs(cuts: list[bytes]):
    """Batches of strings -> sorted runs of each range, each string as its LCP and what follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(batches):
            rows = sorted(zip(*(c.to_pylist() for c in batch.columns)))
            out, before, last = [], b"", -1
            for at, (seq, sizes, i, n, ends) in enumerate(rows):
                part = bisect.bisect_right(cuts, seq)
                lcp = shared(before, seq) if part == last else 0
                out.append((part, task + number, at, lcp, seq[TOKEN * lcp :], sizes[4 * lcp :], i, n, ends))
                before, last = seq, part
            yield _batch(out, ["range", "run", "at", "lcp", "seq", "sizes", "id", "n", "ends"], [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()])

    return run, "range int, run long, at int, lcp int, seq binary, sizes binary, id long, n long, ends binary"


class LoserTree:
    """Merges sorted runs of (lcp with the one before, rest, ...); yields (string, lcp with the last one yielded, row)."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.now: list[bytes | None] = [r[0][1] if r else None for r in runs]
        self.lcp = [0] * len(runs)
        self.leaves = 1 << max(0, len(runs) - 1).bit_length()
        self.now += [None] * (self.leaves - len(runs))
        self.lcp += [0] * (self.leaves - len(runs))
        self.losers = [0] * self.leaves
        self.compared = 0

    def play(self, a: int, b: int) -> tuple[int, int]:
        """Winner (smaller) and loser; the loser's LCP becomes that with the winner.

        Both know how many tokens they share with the last output.  The one that
        shares more is smaller, and the other's number already is what it shares
        with the winner; only where they are equal are tokens compared, from there on.
        """
        x, y = self.now[a], self.now[b]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        if self.lcp[a] != self.lcp[b]:
            return (a, b) if self.lcp[a] > self.lcp[b] else (b, a)
        both = shared(x, y, self.lcp[a])
        self.compared += both - self.lcp[a] + 1
        first, second = (a, b) if x[TOKEN * both : TOKEN * both + TOKEN] <= y[TOKEN * both : TOKEN * both + TOKEN] else (b, a)
        self.lcp[second] = both
        return first, second

    def _start(self, node: int) -> int:
        if node >= self.leaves:
            return node - self.leaves
        winner, self.losers[node] = self.play(self._start(2 * node), self._start(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple[bytes, int, tuple]]:
        winner = self._start(1)
        while self.now[winner] is not None:
            run, at = self.runs[winner], self.at[winner]
            yield self.now[winner], self.lcp[winner], run[at]
            self.at[winner] = at = at + 1
            if at < len(run):
                self.lcp[winner] = run[at][0]
                self.now[winner] = self.now[winner][: TOKEN * run[at][0]] + run[at][1]
            else:
                self.now[winner] = None
            node = (winner + self.leaves) >> 1
            while node:
                winner, self.losers[node] = self.play(winner, self.losers[node])
                node >>= 1


class _Open:
    """A node on the open path."""

    __slots__ = ("digest", "size", "spine", "n", "least", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, digest: bytes, size: int, spine: bool):
        self.digest, self.size, self.spine = digest, size, spine
        self.n, self.least, self.children, self.leaves, self.saved, self.ends, self.waiting = 0, None, 0, 0, 0, None, []


def _below(digest: bytes, token: bytes) -> bytes:
    return hashlib.blake2b(digest + token, digest_size=TOKEN).digest()


def _paths(strings: list[bytes]) -> set[bytes]:
    """Digests of all prefixes."""
    found = {ROOT}
    for s in strings:
        digest = ROOT
        for i in range(0, len(s), TOKEN):
            digest = _below(digest, s[i : i + TOKEN])
            found.add(digest)
    return found


#: id, depth, parent's id, parent's digest (if on the spine), n, children, leaves, saved, ends; of the spine also digest, path, size.
_NODE = ["id", "depth", "parent_id", "parent", "n", "children", "leaves", "saved", "ends", "node", "path", "size"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
NODES = "id long, depth long, parent_id long, parent binary, n long, children long, leaves long, saved long, ends binary, node binary, path binary, size long"


def finished_nodes(merged: Iterator[tuple[bytes, int, tuple]], spine: set[bytes]) -> Iterator[tuple]:
    """Rows of ``_NODE`` as their nodes are finished; a node's row waits for its parent's least id, unless that is on the spine."""
    stack: list[_Open] = []

    def close() -> Iterator[tuple]:
        node, depth = stack.pop(), len(stack)
        up = stack[-1] if stack else None
        if up is not None:
            up.n += node.n
            up.least = node.least if up.least is None else min(up.least, node.least)
        if node.spine:
            path = b"".join(x.digest for x in stack) + node.digest
            yield (node.least, depth, None, up.digest if up else None, node.n, node.children, node.leaves, node.saved, node.ends, node.digest, path, node.size)
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * node.size
        for row in node.waiting:
            yield (*row[:2], node.least, *row[3:])
        row = (node.least, depth, None, up.digest if up.spine else None, node.n, node.children, leaves, saved, node.ends, None, None, None)
        up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
        if up.spine:
            yield row
        else:
            up.waiting.append(row)

    for seq, lcp, row in merged:
        if not stack:
            stack.append(_Open(ROOT, 0, True))
        while len(stack) - 1 > lcp:
            yield from close()
        sizes = np.frombuffer(row[2], np.int32).tolist()
        first = len(seq) // TOKEN - len(sizes)
        for i in range(lcp, len(seq) // TOKEN):
            digest = _below(stack[-1].digest, seq[TOKEN * i : TOKEN * i + TOKEN])
            stack.append(_Open(digest, sizes[i - first], stack[-1].spine and digest in spine))
        last = stack[-1]
        last.n += row[4]
        last.least = row[3] if last.least is None else min(last.least, row[3])
        last.ends = row[5]
    while stack:
        yield from close()


def _merge(cuts: list[bytes]):
    """Runs in order of (range, run, at) -> rows of ``_NODE``; one range is held at a time."""

    def nodes(part: int, runs: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        spine = _paths([c for i in (part - 1, part) if 0 <= i < len(cuts) for c in [cuts[i]]])
        rows = []
        for row in finished_nodes(iter(LoserTree(runs)), spine):
            rows.append(row)
            if len(rows) == 10_000:
                yield _batch(rows, _NODE, _KINDS)
                rows = []
        yield _batch(rows, _NODE, _KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs, last = None, [], None
        for batch in batches:
            for part, number, _, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    if runs:
                        yield from nodes(now, runs)
                    now, runs, last = part, [], None
                if number != last:
                    runs.append([])
                    last = number
                runs[-1].append(tuple(row))
        if runs:
            yield from nodes(now, runs)

    return run


def _whole_spine(parts: DataFrame) -> DataFrame:
    """The spine's nodes from the sums of the ranges; subtree sums go from each node to all on its path."""
    put = parts.groupBy("node").agg(
        F.min("id").alias("id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.sum("n").alias("n"), F.sum("children").alias("children"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"), F.first("path").alias("path"), F.max("size").alias("size"),
    )
    put = cut(put, "spine")
    inner = put.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("more")).select(F.col("parent").alias("node"), "more")
    put = put.join(inner, "node", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0))).drop("more")
    own = put.select("path", "depth", (F.col("leaves") + F.when(F.col("children") == 0, 1).otherwise(0)).alias("l"), (F.col("saved") + (F.col("n") - 1) * F.col("size")).alias("s"))
    up = own.select("l", "s", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("depth")), lambda i: F.substring("path", (i * TOKEN + 1).cast("int"), F.lit(TOKEN)))).alias("node"))
    return cut(put.drop("leaves", "saved").join(up.groupBy("node").agg(F.sum("l").alias("leaves"), F.sum("s").alias("saved")), "node"), "spine")


def prefix_trie(seqs: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row for each distinct start of the sequences (``id``, ``seq``, ``sizes`` as of :func:`sequences`; an ``id`` once).

    Columns: key (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Defined cases: no sequences, no rows; sequences without turns are members of the
    root and end there; equal sequences are members of the same nodes; turns are
    equal if 128 bits of their SHA-256 are.  A sequence is held as 20 bytes a turn by
    the tasks that handle it, and a range's strings (about ``RANGE`` bytes) by one; only
    strings that share their first ``HEAD`` turns can make a range larger.  SHA-256
    of a node's ids is sequential by nature: the ids of equal sequences are joined in
    blocks by many tasks, and one hashes their blocks as a stream.
    """
    strings = cut(seqs.select("id", "seq", "sizes", F.unhex(F.substring(F.sha2("seq", 256), 1, 2 * TOKEN)).alias("digest")), "strings")
    ordered = strings.select("digest", "id").repartitionByRange("digest", "id").sortWithinPartitions("digest", "id")
    blocks = ordered.mapInArrow(_blocks, "digest binary, id long, n long, ids binary")
    groups = blocks.repartition("digest").sortWithinPartitions("digest", "id").mapInArrow(_hashed, "id long, n long, ends binary")
    weighted = cut(groups.join(strings.select("id", "seq", "sizes"), "id").select("seq", "sizes", "id", "n", "ends"), "weighted")

    cuts = splitters(weighted)
    run, kinds = _runs(cuts)
    runs = weighted.mapInArrow(run, kinds)
    nodes = cut(runs.repartition(len(cuts) + 1, "range").sortWithinPartitions("range", "run", "at").mapInArrow(_merge(cuts), NODES), "nodes")

    spine = _whole_spine(nodes.filter("node is not null"))
    parents = spine.select(F.col("node").alias("parent"), F.col("id").alias("above"))
    few = spine.count() <= BROADCAST

    def named(rows: DataFrame, how: str) -> DataFrame:
        return rows.join(F.broadcast(parents), "parent", how) if few else split_join(rows, parents, "parent", how)

    slim = ["id", "depth", "parent", "n", "children", "leaves", "saved", "ends"]
    local = nodes.filter("node is null")
    inside = local.filter("parent is null").select(*slim, F.col("parent_id").alias("above"))
    whole = inside.unionByName(named(local.filter("parent is not null").select(*slim), "inner")).unionByName(named(spine.select(*slim), "left"))
    return whole.select(
        F.col("id").alias(key), "depth", F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce(F.lower(F.hex("ends")), F.lit(EMPTY)).alias("ends_sha256"),
    )
