"""Sharding by vector bin packing of bytes, tokens and rows.

Every group of equal texts goes where the dot product of its (bytes, tokens, rows)
with the shards' residual capacity is highest.  Groups are packed in chunks, one
task each: a chunk gets its share of what every shard has left, so chunks need not
know of each other and their residues stay below the size of a small group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .mixing import _small, words
from .workspace import cut

#: A group with at least 1 / HEAVY of all bytes, tokens or rows is packed before all others.  At most 3 * HEAVY exist.
HEAVY = 2048
#: A group with more bytes than a shard may have is packed in parts of 1 / SPLIT of a shard.
SPLIT = 4
#: Groups of a chunk, about.
CHUNK = 4096
SUMS = ("size", "tokens", "n")
#: What bytes, tokens and rows count for in the dot product.
WEIGHTS = np.array([1.0, 0.1, 0.1])


def pack(items: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The shard of each item (rows of bytes, tokens, rows); ``left``, the shards' residual capacities, is changed.

    Items in order of size go where the dot product with the residual capacity is
    highest, both in units of what is still to be placed; among shards whose
    bytes fit, or all if none does.
    """
    out = np.empty(len(items), np.int64)
    todo = items.sum(0)
    load = items / np.maximum(todo, 1e-12)
    for i in np.lexsort((np.arange(len(items)), -(load @ WEIGHTS))).tolist():
        x = items[i]
        score = left @ (x * WEIGHTS / np.maximum(todo, 1e-9) ** 2)
        fits = left[:, 0] >= x[0]
        best = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else score))
        out[i] = best
        left[best] -= x
        todo -= x
    return out


def _place(left: np.ndarray, light: np.ndarray):
    """Rows (chunk, group, size, tokens, n), sorted by chunk -> (group, chunk, shard).

    ``left``: what the shards have left in all; ``light``: the sums of all groups to place.
    """

    def one(chunk: int, groups: np.ndarray, items: np.ndarray) -> pa.RecordBatch:
        shards = pack(items, left * (items.sum(0) / np.maximum(light, 1)))
        return pa.RecordBatch.from_arrays([pa.array(groups), pa.array(np.full(len(groups), chunk, np.int64)), pa.array(shards.astype(np.int32))], names=["group", "chunk", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, groups, items = None, [], []
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            rows = np.column_stack([batch.column(c).to_numpy().astype(float) for c in (2, 3, 4)])
            for part in np.split(np.arange(len(chunk)), np.flatnonzero(np.diff(chunk)) + 1):
                if len(part) and chunk[part[0]] != now:
                    if groups:
                        yield one(now, np.concatenate(groups), np.concatenate(items))
                    now, groups, items = chunk[part[0]], [], []
                groups.append(batch.column(1).to_numpy()[part])
                items.append(rows[part])
        if groups and now is not None:
            yield one(now, np.concatenate(groups), np.concatenate(items))

    return run


def _part(id_: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(id_, F.lit(3)), parts)


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, tokens, text_crc32, shard and slot of every row.

    ``size`` is the UTF-8 bytes of the text plus 1 (null: 1), ``tokens`` its words.
    Rows with equal texts are a group and share a shard, unless the group has
    more bytes than a shard may have: then it is dealt in parts by a hash of the
    id.  Bytes come out nearly equal; tokens and rows as well as the
    data allow.  ``slot`` numbers the rows of a shard from 0 without gaps.

    Heavy groups (at most 3 * HEAVY, whatever the data) are placed by the driver,
    all others by tasks of about CHUNK groups.  Rows are ranked within a chunk's
    shard or a part of a heavy group, and ranks are added up over chunks.

    Defined cases: null texts are one group; a null id is hashed like a value and
    ordered first; repeated rows get different slots; an empty table gives no
    rows; other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long").alias("size"), words(text).alias("tokens"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("crc"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("group"),
        ).withColumn("group", F.xxhash64("group", "crc", "size")),
        "sizes",
    )
    spark = docs.sparkSession
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    total = rows.agg(*sums).first()
    if not total["n"]:
        return rows.select(F.col("id").alias(id_col), "size", "tokens", F.col("crc").alias("text_crc32"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    whole = np.array([float(max(1, total[c])) for c in SUMS])
    groups = cut(rows.groupBy("group").agg(*sums).withColumn("share", F.greatest(*[F.col(c) / F.lit(x) for c, x in zip(SUMS, whole)])), "groups")

    parts = F.when(F.col("size") * shards > F.lit(total["size"]), F.ceil(F.col("share") * shards * SPLIT)).otherwise(1).cast("int")
    heavy = cut(groups.filter(F.col("share") >= 1 / HEAVY).select(F.col("group").alias("heavy"), parts.alias("parts")), "heavy")
    marked = rows.join(F.broadcast(heavy), F.col("group") == F.col("heavy"), "left").withColumn("part", _part(F.col("id"), F.col("parts")))
    pieces = marked.filter("heavy is not null").groupBy("heavy", "part").agg(*sums).orderBy("heavy", "part").collect()
    left = np.tile(whole / shards, (shards, 1))
    items = np.array([[p[c] for c in SUMS] for p in pieces], float).reshape(-1, 3)
    placed = pack(items, left)
    light = whole - items.sum(0)

    rest = groups.filter(F.col("share") < 1 / HEAVY)
    chunks = max(1, -(-rest.count() // CHUNK))
    dealt = rest.select(F.pmod(F.xxhash64("group", F.lit(1)), F.lit(chunks)).alias("chunk"), "group", *SUMS)
    dealt = dealt.repartition(min(chunks, 4096), "chunk").sortWithinPartitions("chunk", "group")
    found = cut(dealt.mapInArrow(_place(left, light), "group long, chunk long, shard int"), "placed")
    plan = F.broadcast(spark.createDataFrame([(p["heavy"], p["part"], int(s), -1 - i) for i, (p, s) in enumerate(zip(pieces, placed))], "h long, p long, heavy_shard int, heavy_chunk long"))
    # a group below 1 / HEAVY of the rows is no hot key
    ours = marked.filter("heavy is null").join(found, "group").select("id", "size", "tokens", "crc", "chunk", "shard")
    theirs = marked.filter("heavy is not null").join(plan, (F.col("heavy") == F.col("h")) & (F.col("part") == F.col("p"))).select("id", "size", "tokens", "crc", F.col("heavy_chunk").alias("chunk"), F.col("heavy_shard").alias("shard"))
    all_rows = cut(ours.union(theirs), "shards")
    counts = all_rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = cut(counts.select(F.col("shard").alias("s"), F.col("chunk").alias("c"), before.alias("first")), "first")
    rank = F.row_number().over(W.partitionBy("shard", "chunk").orderBy(F.col("id").asc_nulls_first(), "size", "crc")) - 1
    ranked = all_rows.withColumn("rank", rank)
    first = F.broadcast(first) if _small(first) else first
    return ranked.join(first, (ranked["shard"] == first["s"]) & (ranked["chunk"] == first["c"])).select(
        F.col("id").alias(id_col), "size", "tokens", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot")
    )
