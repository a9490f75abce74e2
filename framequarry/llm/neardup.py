"""Near-duplicate classes by bottom-k sketches of one hash function.

1. Every document becomes the set of its hashed word shingles; equal sets fall
   into one class at once, and only classes go on.
2. A class keeps the ``k`` smallest hash values (its bottom-k sketch).  Inverted
   lists of retained values say how many classes hold each value.
3. Two classes of the wanted similarity share at least ``alpha`` retained
   values, so they share one of the ``k - alpha + 1`` rarest of either (the
   prefix-filter argument).  Only those are followed: values of boilerplate that
   many unlike documents hold come last and are seldom reached.
4. Classes joined by followed lists form families.  Inside a family, in blocks
   of bounded size, overlaps of retained values, then the union-sketch estimate,
   then the exact Jaccard similarity of full sets decide each link.
5. Components of the verified links are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel
from .components import components
from .workspace import cut, fresh, split_join

#: Classes of one family that one task compares with each other, or with as many others.
BLOCK = 512
_SETS = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("values", pa.list_(pa.int64()))])


def least_overlap(size: int, k: int, percent: int) -> int:
    """Retained values that a class of ``size`` shingles shares with any class it is linked to.

    A set below ``k`` is retained whole, so the bound is certain; else the share
    of the union's k smallest values is hypergeometric around ``percent``, and the
    bound lies five standard deviations of the (wider) binomial below.
    """
    t = percent / 100
    whole = math.ceil((1 - (1 - t) / t) * min(size, k) - 1e-9)
    return max(1, whole if size < k else min(whole, math.floor(k * t - 5 * math.sqrt(k * t * (1 - t)))))


def _digest(values: np.ndarray) -> bytes:
    """128 bits of a set."""
    return np.array([textkernel.mix(values, 5).sum(), textkernel.mix(values, 6).sum() + np.uint64(len(values))], np.uint64).tobytes()


def _sets(width: int, keep: int | None, id_name: str, id_type: pa.DataType):
    """Batches of (id, text) -> id, n, key, values: the ``keep`` smallest values of each set (None: all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, found, counts in textkernel.words(batch.column(1)):
                n, keys, values = [], [], []
                for s in textkernel.shingles(found, counts, width):
                    n.append(len(s))
                    keys.append(_digest(s) if len(s) else None)
                    values.append(s[:keep].view(np.int64))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(counts)), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists], names=[id_name, "n", "key", "values"])

    return run


def _bits(rows: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """A row of bits for each of ``count`` sets; values that only one set holds get none."""
    order = np.argsort(values, kind="stable")
    sorted_values = values[order]
    new = np.ones(len(values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    group = np.cumsum(new) - 1
    often = np.bincount(group) > 1 if len(group) else np.zeros(0, bool)
    column = (np.cumsum(often) - 1)[group]
    kept = often[group]
    wide = max(1, -(-int(often.sum()) // 64))
    out = np.zeros(count * wide, np.uint64)
    np.bitwise_or.at(out, rows[order][kept] * wide + (column[kept] >> 6), np.uint64(1) << (column[kept] & 63).astype(np.uint64))
    return out.reshape(count, wide)


def _union_sketch(mine: np.ndarray, others: np.ndarray, k: int) -> np.ndarray:
    """Estimated Jaccard similarity from the k smallest values of each union (rows padded with the largest value)."""
    both = np.sort(np.concatenate([np.broadcast_to(mine, others.shape), others], axis=1), axis=1)
    real = both != np.uint64(2**64 - 1)
    same = np.zeros(both.shape, bool)
    same[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~same, axis=1)
    return (same & (rank <= k)).sum(1) / np.minimum(k, rank[:, -1])


def _links(sizes: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], k: int, percent: int) -> np.ndarray:
    """For each set the first of its class, by links between all sets (or those of sides 0 and 1)."""
    m = len(sets)
    order = np.argsort(sizes, kind="stable")
    sizes, sides, sets = sizes[order], sides[order], [sets[i] for i in order]
    rows = np.repeat(np.arange(m), sizes)
    full = _bits(rows, np.concatenate(sets), m)
    heads = [s[:k] for s in sets]
    retained = _bits(np.repeat(np.arange(m), [len(s) for s in heads]), np.concatenate(heads), m)
    padded = np.full((m, k), 2**64 - 1, np.uint64)
    for i, s in enumerate(heads):
        padded[i, : len(s)] = s
    least = np.array([least_overlap(int(n), k, percent) for n in sizes])
    low = percent / 100 - 5 * math.sqrt(percent / 100 * (1 - percent / 100) / k)
    label = np.arange(m)
    two = bool((sides != sides[0]).any())
    for i in range(m):
        end = int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
        near = np.arange(i + 1, max(i + 1, end))
        near = near[label[near] != label[i]]
        if two:
            near = near[sides[near] != sides[i]]
        if len(near):
            near = near[np.bitwise_count(retained[near] & retained[i]).sum(1) >= np.maximum(least[near], least[i])]
        for part in np.array_split(near, -(-len(near) // 512)) if len(near) else ():
            part = part[(sizes[part] < k) | (_union_sketch(padded[i], padded[part], k) >= low)]
            common = np.bitwise_count(full[part] & full[i]).sum(1).astype(np.int64)
            part = part[100 * common >= percent * (sizes[part] + sizes[i] - common)]
            for old in np.unique(label[part]):
                label[label == old] = label[i]
    out = np.empty(m, np.int64)
    out[order] = order[label]
    return out


def _verify(k: int, percent: int):
    """Rows (family, pair, side, node, values), sorted by family and pair -> star links between their nodes."""

    def one(nodes: list[bytes], sides: list[int], sets: list[np.ndarray]) -> tuple[list[bytes], list[bytes]]:
        seen = {}
        for i, x in enumerate(nodes):
            seen.setdefault(x, i)
        at = list(seen.values())
        first = _links(np.array([len(sets[i]) for i in at]), np.array([sides[i] for i in at]), [sets[i] for i in at], k, percent)
        moved = np.flatnonzero(first != np.arange(len(at)))
        return [nodes[at[i]] for i in moved], [nodes[at[first[i]]] for i in moved]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sides, sets = None, [], [], []
        for batch in batches:
            groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            side, node, lists = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            for i, group in enumerate(groups):
                if group != now:
                    if len(nodes) > 1:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in one(nodes, sides, sets)], names=["u", "v"])
                    now, nodes, sides, sets = group, [], [], []
                nodes.append(node[i])
                sides.append(side[i])
                sets.append(flat[ends[i] : ends[i + 1]].copy())
        if len(nodes) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in one(nodes, sides, sets)], names=["u", "v"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, k: int = 64, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Words are runs of non-white-space after A-Z are lower-cased; rows are linked
    if ``100 * |A & B| >= percent * |A | B|`` for their sets of ``width``-word
    shingles.  ``component_id`` is the smallest id reachable over links, the row's
    own included; ``kept`` marks rows whose id equals it.

    Defined cases: a null or wordless text has the empty set and no links; fewer
    than ``width`` words form one shingle; equal sets are one class (so ties and
    repeated rows share a component, and repeated rows of the smallest id are all
    kept); a null id takes no part in the minimum, and a component of only null
    ids has component_id null and kept true; an empty table gives no rows; other
    columns are ignored.  Sets are held as 64-bit hashes of whole texts; classes
    as 128-bit digests.
    """
    sketches, found = _classes(docs, id_col, text_col, width, percent, k, block)
    return split_join(sketches, found, "key", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("key").isNull(), True).otherwise(F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, k: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, key) of every row, key null for empty sets; (key, component_id) of every class of equal sets."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    made = f"id {kind}, n long, key binary, values array<long>"
    sketches = cut(slim.mapInArrow(_sets(width, k, "id", None), made), "sketches")
    classes = cut(sketches.filter("n > 0").groupBy("key", "n").agg(F.min("id").alias("id"), F.first("values").alias("values")), "classes")

    kept = classes.select("key", F.explode("values").alias("value"))
    lists = kept.groupBy("value").agg(F.count("*").alias("held")).filter("held > 1")
    shared = split_join(kept, lists, "value").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("held", "value"))).alias("shared"))
    bounds = spark_map({n: least_overlap(n, k, percent) for n in range(1, k + 1)})
    size = F.least("n", F.lit(k))
    follow = size - bounds[size.cast("int")] + 1 - (size - F.size("shared"))
    followed = cut(
        classes.select("key", "n").join(shared, "key").filter(follow > 0).select("key", F.explode(F.slice("shared", F.lit(1), F.greatest(F.lit(1), follow).cast("int"))).alias("x")).select("key", F.col("x.value").alias("value")),
        "followed",
    )
    pivots = followed.groupBy("value").agg(F.min("key").alias("pivot"), F.count("*").alias("m")).filter("m > 1").drop("m")
    families = components(split_join(followed, pivots, "value").select(F.col("key").alias("u"), F.col("pivot").alias("v")))
    members = cut(families.select("node", F.col("root").alias("family")).union(families.select("root", "root").distinct()), "members")

    blocks = F.ceil(F.col("m") / block).cast("int")
    dealt = split_join(members, members.groupBy("family").agg(F.count("*").alias("m")), "family").select("node", "family", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"))
    named = dealt.join(classes.select(F.col("key").alias("node"), "id"), "node")
    wanted = slim.join(named.select("id").distinct(), slim["id"].eqNullSafe(named["id"]), "left_semi")
    sets = wanted.mapInArrow(_sets(width, None, "id", None), made).select(F.col("key").alias("node"), "values")
    other = F.col("other")
    pairs = (
        sets.join(dealt, "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("family", (F.least("own", other) * F.lit(1 << 20).cast("long") + F.greatest("own", other)).alias("pair"), (F.col("own") > other).cast("int").alias("side"), "node", "values")
    )
    links = pairs.repartition("family", "pair").sortWithinPartitions("family", "pair").mapInArrow(_verify(k, percent), "u binary, v binary")
    roots = components(links)

    label = roots.union(roots.select("root", "root").distinct())
    smallest = classes.join(label, classes["key"] == label["node"]).groupBy("root").agg(F.min("id").alias("component_id"))
    linked = split_join(label, smallest, "root").select(F.col("node").alias("key"), "component_id")
    found = classes.select("key", "id").join(linked, "key", "left").select("key", F.coalesce("component_id", "id").alias("component_id"))
    return sketches.select("id", "n", "key"), found


def spark_map(values: dict[int, int]):
    """A literal map column."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` of which :func:`near_duplicates` keeps the id: one document of each component.

    Repeated rows with one id stay together (they are told apart by nothing).
    Rows with a null id stay.
    """
    settings = {"width": 5, "percent": 80, "k": 64, "block": BLOCK} | options
    sketches, found = _classes(docs, id_col, text_col, **settings)
    flag = fresh(docs, "kept_id")
    ids = found.select("component_id").union(sketches.filter("key is null").select("id")).distinct().toDF(flag)
    return docs.join(ids, docs[id_col].eqNullSafe(ids[flag]), "left_semi")
