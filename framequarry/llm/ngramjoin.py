"""Jaccard join of documents' n-gram sets through a token-group matrix.

1. Documents with equal sets of hashed word n-grams are one class.
2. Of a set of ``n`` values a class shows the ``n - ceil(t n) + l`` smallest, with
   ``l`` about a tenth of ``n``.  Two sets of similarity ``t`` show at least ``l`` (of
   the smaller set) common values, so each is led to the other by one of its
   rarest shown values, all but ``l - 1`` of them.  These bounds are certain.
3. Classes are put into groups of bounded size: first by the least of
   the values that lead to most of them, inside it by the hash of their least value, so that copies
   with changes stay together.
4. The *matrix* has a cell for each value and each group that it leads to.  Where two
   groups share a value of the matrix and their sizes fit, the classes of the one
   are queries to the other.  A group meets its queries once, in chunks of bounded size.
5. There the values of the whole group are one union.  A query can share no more
   values with any member than with that union; only where the bound reaches what
   its size asks for is the group opened to it, and its members are compared one by
   one.  Exact counts decide each link.
6. Links are counted; one star for each set of connected classes in such a meeting
   goes on to the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel
from .components import components
from .workspace import cut, split_join, written

#: Classes of a group, at most; values of all its classes, about.
GROUP, VALUES = 512, 1 << 19


def asked(n: int, percent: int) -> int:
    """Values that a set of ``n`` shares with every set it is linked to, at least."""
    return -(-n * percent // 100)


def spare(n: int) -> int:
    """Common values that two linked sets show, at least, if ``n`` is the smaller set's size."""
    return max(1, n // 10)


def shown(n: int, percent: int) -> int:
    return n - asked(n, percent) + min(spare(n), asked(n, percent)) if n else 0


def _asked(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100)


def _sets(width: int, percent: int | None, id_name: str = "id"):
    """Batches of (id, text) -> id, n, key (128 bits of the set), values (those shown, or all where ``percent`` is None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, found, counts in textkernel.words(batch.column(1)):
                n, keys, values = [], [], []
                for s in textkernel.shingles(found, counts, width):
                    n.append(len(s))
                    keys.append(textkernel.digest(s) if len(s) else None)
                    values.append((s if percent is None else s[: shown(len(s), percent)]).view(np.int64))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(counts)), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists], names=[id_name, "n", "key", "values"])

    return run


def open_groups(sizes: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Links between the sets of sides 0 and 1, or among all where there is one side.

    Returns for each set the first of those it is connected with, the number of
    documents it is linked to, and how many pairs were compared.
    """
    m = len(sets)
    two = bool((sides != sides[0]).any())
    rows, values = np.repeat(np.arange(m), sizes), np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    rows, values = rows[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    holders = np.bincount(column)
    if two:  # a query's values that the other group's union holds
        other = np.bincount(column, sides[rows])
        useful = (other > 0) & (other < holders)
    else:
        useful = holders > 1
    kept = useful[column]
    rows, column = rows[kept], (np.cumsum(useful) - 1)[column[kept]]
    bound = np.bincount(rows, minlength=m)
    least = np.array([sizes[sides != s].min() if two else 0 for s in (0, 1)])[sides]
    opened = np.flatnonzero(100 * bound >= percent * np.maximum(sizes, least))
    opened = opened[np.argsort(sizes[opened], kind="stable")]

    place = np.full(m, -1)
    place[opened] = np.arange(len(opened))
    rows, column = place[rows], column
    rows, column = rows[rows >= 0], column[rows >= 0]
    wide = max(1, -(-int(useful.sum()) // 64))
    bits = np.zeros(len(opened) * wide, np.uint64)
    np.bitwise_or.at(bits, rows * wide + (column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    bits = bits.reshape(len(opened), wide)

    label, links, compared = np.arange(m), np.zeros(m, np.int64), 0
    n, side = sizes[opened], sides[opened]
    for i in range(len(opened)):
        near = np.arange(i + 1, int(np.searchsorted(n, n[i] * 100 // percent, "right")))
        near = near[side[near] != side[i]] if two else near
        if not len(near):
            continue
        compared += len(near)
        used = np.flatnonzero(bits[i])  # only words in which the query has a value
        common = np.bitwise_count(bits[np.ix_(near, used)] & bits[i, used]).sum(1).astype(np.int64)
        hit = opened[near[100 * common >= percent * (n[near] + n[i] - common)]]
        if len(hit):
            a = opened[i]
            links[a] += copies[hit].sum()
            links[hit] += copies[a]
            together = np.unique(label[np.append(hit, a)])
            label[np.isin(label, together)] = together[0]
    return label, links, compared


def _open(percent: int):
    """Rows (t, chunk, side, cid, copies, values) in order of (t, chunk) -> cid, first (of the connected ones), links."""

    def one(rows: list[tuple]) -> pa.RecordBatch:
        once = list({r[1]: r for r in rows}.values())
        sets = [r[3] for r in once]
        label, links, _ = open_groups(np.array([len(s) for s in sets]), np.array([r[0] for r in once]), sets, np.array([r[2] for r in once]), percent)
        hit = np.flatnonzero(links)
        cids = np.array([r[1] for r in once])
        return pa.RecordBatch.from_arrays([pa.array(cids[hit]), pa.array(cids[label[hit]]), pa.array(links[hit])], names=["cid", "first", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            group, chunk, side, cid, copies = (c.to_pylist() for c in batch.columns[:5])
            lists = batch.column(5)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            for i, pair in enumerate(zip(group, chunk)):
                if pair != now:
                    if len(rows) > 1:
                        yield one(rows)
                    now, rows = pair, []
                rows.append((side[i], cid[i], copies[i], flat[ends[i] : ends[i + 1]].copy()))
        if len(rows) > 1:
            yield one(rows)

    return run


def _groups(leads: DataFrame, classes: DataFrame) -> DataFrame:
    """cid -> gid: groups of at most about GROUP classes and VALUES values, by the least of the values that lead to most of them, then by the least value of all.

    ``leads``: cid, value, m (the classes that the value leads to).  Of a class's values
    those with at least half its greatest ``m`` count: nearly all of a family of changed
    copies share the least of these, while a rare value that a change made leads to few.
    """
    listed = leads.groupBy("cid").agg(F.collect_list(F.struct("m", "value")).alias("x"), F.max("m").alias("most"))
    pivot = listed.select("cid", F.array_min(F.transform(F.filter("x", lambda x: x["m"] * 2 >= F.col("most")), lambda x: x["value"])).alias("pivot"))
    known = cut(pivot.join(classes.select("cid", "n", "least"), "cid"), "pivots")
    blocks = F.ceil(F.greatest(F.col("m") / GROUP, F.col("v") / VALUES)).cast("long")
    size = [F.count("*").alias("m"), F.sum("n").alias("v")]
    first = split_join(known, known.groupBy("pivot").agg(*size), "pivot").select("cid", "n", F.xxhash64("pivot", F.pmod(F.xxhash64("least"), blocks)).alias("block"))
    first = cut(first, "blocks")  # many copies of one text with changes have one least value: those are dealt by their own
    return split_join(first, first.groupBy("block").agg(*size), "block").select("cid", "n", F.xxhash64("block", F.pmod(F.xxhash64("cid"), blocks)).alias("gid"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, n_links.

    Words are runs of non-white-space after A-Z are lower-cased; two rows link if
    ``100 * |A & B| >= percent * |A | B|`` for their sets of ``width``-word shingles.
    ``component_id`` is the smallest id reachable over links, the row's own included;
    ``n_links`` is the number of other rows that the row is linked with.

    Defined cases: a null or wordless text has the empty set and no links; fewer
    than ``width`` words form one shingle; equal sets are linked (so ties and repeated
    rows share a component and count each other); a null id takes no part in the
    minimum, and a component of only null ids has component_id null; an empty table
    gives no rows; other columns are ignored.  Sets are held as 64-bit hashes of
    whole texts, classes as 128-bit digests.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent: 50 to 100")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = f"id {slim.schema['id'].dataType.simpleString()}, n long, key binary, values array<long>"
    signatures, done = written(slim.mapInArrow(_sets(width, percent), made), "signatures")
    grouped = signatures.filter("n > 0").groupBy("key", "n").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("values").alias("values"))
    heads, values_done = written(grouped.withColumn("cid", F.monotonically_increasing_id()), "heads")
    classes = cut(heads.select("cid", "key", "n", "id", "copies", F.col("values")[0].alias("least")), "classes")
    rows = cut(signatures.select("id", "n", "key"), "rows")
    done()  # the shown values are the bulk: each table of them goes as soon as the next is written

    values = heads.select("cid", F.explode("values").alias("value"))
    lists = values.groupBy("value").agg(F.count("*").alias("held")).filter("held > 1")
    common = split_join(values, lists, "value").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("held", "value"))).alias("common"))
    smaller = _asked(F.col("n"), percent)
    follow = (F.size("common") - F.greatest(F.lit(1), F.floor(smaller / 10)) + 1).cast("int")
    led = classes.select("cid", "n").join(common, "cid").filter(follow > 0).select("cid", F.explode(F.slice("common", F.lit(1), follow)).alias("x"))
    led = cut(led.select("cid", F.col("x.value").alias("value")), "led")
    values_done()
    leads = cut(split_join(led, led.groupBy("value").agg(F.count("*").alias("m")).filter("m > 1"), "value"), "leads")

    groups = cut(_groups(leads, classes), "groups")
    spans = groups.groupBy("gid").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("m"), F.sum("n").alias("v"))
    matrix = cut(leads.select("cid", "value").join(groups.select("cid", "gid"), "cid").select("value", "gid").distinct(), "matrix")
    wide = cut(split_join(matrix, spans, "gid"), "cells")
    span = F.struct("m", "gid", "v", "lo", "hi")
    fits = (F.col("q") < F.col("t")) & (F.col("q.hi") * 100 >= F.col("t.lo") * percent) & (F.col("t.hi") * 100 >= F.col("q.lo") * percent)  # the group of more classes is opened, the other asks
    pairs = cut(wide.select("value", span.alias("q")).join(wide.select("value", span.alias("t")), "value").filter(fits).select(F.col("q.gid").alias("q"), F.col("t.gid").alias("t"), "q.m", "q.v").distinct(), "pairs")

    load = F.ceil(F.greatest(F.sum("m") / (4 * GROUP), F.sum("v") / (2 * VALUES))).cast("long").alias("chunks")
    asks = cut(split_join(pairs, pairs.groupBy("t").agg(load), "t").select("q", "t", F.pmod(F.xxhash64("q"), F.col("chunks")).alias("chunk")), "asks")
    met = asks.select(F.col("q").alias("gid"), "t", "chunk", F.lit(1).alias("side")).union(asks.select("t", "t", "chunk", F.lit(0)).distinct())
    met = met.union(spans.filter("m > 1").select("gid", "gid", F.lit(-1).cast("long"), F.lit(0)))
    members = groups.select("cid", "gid").join(classes.select("cid", "key", "id", "copies"), "cid")
    members = cut(members.join(met.select("gid").distinct(), "gid", "left_semi"), "members")
    named = members.select(F.col("id").alias("member")).distinct()
    sets = slim.join(named, slim["id"].eqNullSafe(named["member"]), "left_semi").mapInArrow(_sets(width, None), made).select("key", "values")
    meeting = sets.join(members.select("key", "cid", "gid", "copies"), "key").join(met, "gid").select("t", "chunk", "side", "cid", "copies", "values")
    stars = cut(meeting.repartition("t", "chunk").sortWithinPartitions("t", "chunk").mapInArrow(_open(percent), "cid long, first long, links long"), "stars")

    roots = components(stars.select(F.col("cid").alias("u"), F.col("first").alias("v")))
    label = roots.union(roots.select("root", "root").distinct())
    smallest = classes.select("cid", "id").join(label, F.col("cid") == F.col("node")).groupBy("root").agg(F.min("id").alias("component_id"))
    connected = split_join(label, smallest, "root").select(F.col("node").alias("cid"), "component_id")
    counted = stars.groupBy("cid").agg(F.sum("links").alias("links"))
    found = classes.select("cid", "key", "id", "copies").join(connected, "cid", "left").join(counted, "cid", "left")
    found = found.select("key", F.coalesce("component_id", "id").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return split_join(rows, found, "key", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
