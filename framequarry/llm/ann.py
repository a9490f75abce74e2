"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors are turned into binary codes by a rotation learned on a bounded sample
(iterative quantisation of the centred vectors, lengthened by one component so
that the largest inner product becomes the smallest angle).  Codes are split into
substrings and every substring is indexed.  Two codes within Hamming radius
``r = m * a + b`` (b < m) agree up to ``a`` bits in one of the first ``b + 1`` of
the ``m`` substrings or up to ``a - 1`` bits in one of the others, so probing those
neighbourhoods finds every code within the radius.  The candidates are ranked by
the inner product of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .sampling import lowest_hash
from .workspace import cut, split_join

#: Vectors that the codes are learned on, at most; of them so many ask in the calibration of the radius.
SAMPLE, ASK = 8192, 256
#: Vectors and queries that one task compares.
ROWS, QUERIES = 16384, 4096


@dataclass(frozen=True)
class Codes:
    """x -> bits of ((x, sqrt(longest^2 - |x|^2)) - mean) @ rotation; radius: Hamming distance searched."""

    mean: np.ndarray
    rotation: np.ndarray
    longest: float
    radius: int

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def encode(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Codes as bytes.  A query has no lengthening component: its direction alone decides."""
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))
        y = np.column_stack([x, last])
        if query:
            y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300) * self.longest
        bits = (y - self.mean) @ self.rotation > 0
        return np.packbits(bits, axis=1)


def learn(x: np.ndarray, k: int, recall: float, bits: int, rounds: int = 30, seed: int = 0) -> Codes:
    """Rotations by iterative quantisation, as many as give ``bits`` bits, and the radius that finds ``recall`` of the k nearest in the sample.

    In the whole table the k nearest are nearer than in the sample, so the sample's
    recall is a lower estimate.
    """
    rng = np.random.default_rng(seed)
    longest = float(np.sqrt((x * x).sum(1).max())) if len(x) else 1.0
    y = np.column_stack([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))])
    mean = y.mean(0) if len(y) else np.zeros(x.shape[1] + 1)
    z = y - mean
    parts, dims = [], z.shape[1]
    while sum(p.shape[1] for p in parts) < bits:
        r = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        for _ in range(rounds if len(z) else 0):
            u, _, v = np.linalg.svd(z.T @ np.where(z @ r > 0, 1.0, -1.0))
            r = u @ v
        parts.append(r)
    codes = Codes(mean, np.concatenate(parts, 1)[:, :bits], longest, bits)
    ask = x[:: max(1, len(x) // ASK)][:ASK]
    if len(x) <= k + 1:
        return codes
    asked = codes.encode(ask, query=True)
    have = codes.encode(x)
    scores = ask @ x.T
    near = np.argpartition(-scores, k, axis=1)[:, : k + 1]
    far = np.stack([np.bitwise_count(have[n] ^ q).sum(1) for n, q in zip(near, asked)])
    return Codes(mean, codes.rotation, longest, int(np.quantile(far, recall, method="higher")))


#: Hamming distance of two substrings.
DIFFERENCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


class Tables:
    """Codes of one block, indexed by each of their substrings (bytes) for one radius.

    The postings of a substring value are the rows whose substring lies in its
    neighbourhood, as a bitmap; probing a code joins one bitmap for each substring.
    """

    def __init__(self, codes: np.ndarray, radius: int):
        self.radius, self.rows = radius, len(codes)
        wide = np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))).view(np.uint64)
        self.words = np.ascontiguousarray(wide.T)
        a, b = divmod(radius, codes.shape[1])
        self.probed = [j for j in range(codes.shape[1]) if (a if j <= b else a - 1) >= 0]
        size = -(-len(codes) // 64) * 8
        self.postings = np.zeros((len(self.probed), 256, size), np.uint8)
        for t, j in enumerate(self.probed):
            near = DIFFERENCE <= (a if j <= b else a - 1)
            self.postings[t, :, : -(-len(codes) // 8)] = np.packbits(near[:, codes[:, j]], axis=1)

    def within(self, code: np.ndarray) -> np.ndarray:
        """Positions of all codes within the radius."""
        lists = self.postings[np.arange(len(self.probed)), code[self.probed]].view(np.uint64)
        seen = np.unpackbits(np.bitwise_or.reduce(lists, axis=0).view(np.uint8), count=self.rows).view(bool)
        query = np.pad(code, (0, -len(code) % 8)).view(np.uint64)
        found = np.flatnonzero(seen) if seen.mean() < 0.3 else None
        words = self.words if found is None else self.words[:, found]
        far = np.zeros(words.shape[1], np.uint16)
        for mine, theirs in zip(query, words):
            far += np.bitwise_count(theirs ^ mine)
        inside = far <= self.radius
        return np.flatnonzero(seen & inside) if found is None else found[inside]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _search(codes, k: int, radius: int):
    """Rows (pair, is_query, key, vector, ids), sorted by pair and kind, vectors first -> (key, found) for each query: its best rows of the block."""

    def answers(keys: list[str], queries: np.ndarray, ids: list[np.ndarray], x: np.ndarray) -> Iterator[tuple[str, list[tuple[int, float]]]]:
        c: Codes = codes.value
        tables = Tables(c.encode(x), radius)
        counts = np.array([len(i) for i in ids])
        for key, q, code in zip(keys, queries, c.encode(queries, query=True)):
            near = tables.within(code)
            score = (x[near] * q).sum(1)  # row by row in one order, so equal vectors score the same
            if len(near) > k:
                keep = score >= np.partition(score, -k)[-k]
                near, score = near[keep], score[keep]
            own = np.repeat(score, counts[near])
            rows = np.concatenate([ids[i] for i in near]) if len(near) else np.zeros(0, np.int64)
            best = np.lexsort((rows, -own))[:k]
            yield key, list(zip(rows[best].tolist(), own[best].tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, x, keys, q = None, [], [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if keys and ids:
                got = list(answers(keys, np.array(q), ids, np.array(x)))
                ends = np.concatenate([[0], np.cumsum([len(f) for _, f in got])]).astype(np.int32)
                flat = [pair for _, f in got for pair in f]
                found = pa.StructArray.from_arrays([pa.array([p[0] for p in flat], pa.int64()), pa.array([p[1] for p in flat], pa.float64())], names=["vec_id", "score"])
                yield pa.RecordBatch.from_arrays([pa.array([k_ for k_, _ in got], pa.string()), pa.ListArray.from_arrays(pa.array(ends), found)], names=["key", "found"])

        for batch in batches:
            pairs, asks, own = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            vectors, members = _matrix(batch.column(3)), batch.column(4)
            for i, pair in enumerate(pairs):
                if pair != now:
                    yield from flush()
                    now, ids, x, keys, q = pair, [], [], [], []
                if asks[i]:
                    keys.append(own[i])
                    q.append(vectors[i])
                else:
                    ids.append(np.array(members[i].as_py(), np.int64))
                    x.append(vectors[i])
        yield from flush()

    return run


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, no null or non-finite component."""
    big = F.lit(float("inf"))
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.97, bits: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``queries`` holds, the k rows of largest inner product found, its own left out.

    Equal vectors are indexed once with their k + 1 smallest ids, which no answer
    can exceed, so a vector that a third of all rows hold costs no more than
    another.  Vectors are dealt in blocks of about ROWS, queries in blocks of about
    QUERIES; one task searches one pair of blocks and keeps k + 1 rows a query.
    Queries that find no k + 1 rows within the radius ask again with twice the
    radius, until they have them or the radius covers all bits, so an isolated
    vector gets as many neighbours as any other.

    Defined cases: vectors null, zero or holding null or non-finite components,
    rows without id, and vectors of another length than most take no part; ties go
    to the smaller id; an id that repeats is one candidate per row; with no more
    than k candidates all are returned; an empty table gives no rows; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), queries.alias("asks")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if size is None:
        return empty
    # the key is a hash of 128 bits: two of 10^10 vectors share one with a chance below 10^-18; + 0.0 makes -0.0 and 0.0 one value
    rows = cut(rows.filter(F.size("vector") == size["n"]).withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0))).withColumn("key", F.concat_ws(" ", F.xxhash64(F.lit(1), "vector"), F.xxhash64(F.lit(2), "vector"))), "vectors")
    sample = lowest_hash(rows.select("id", "vector"), SAMPLE).toArrow()
    codes = learn(np.unique(_matrix(sample.column("vector").combine_chunks()), axis=0), k, recall, bits)
    shared = spark.sparkContext.broadcast(codes)

    one = W.partitionBy("key", "vector").orderBy("id")
    indexed = rows.withColumn("r", F.row_number().over(one)).filter(F.col("r") <= k + 1).groupBy("key", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = rows.filter(F.coalesce("asks", F.lit(False))).groupBy("key", "vector").agg(F.count("*").alias("n"))
    blocks = max(1, -(-rows.count() // ROWS))
    top, radius = None, codes.radius
    while True:
        found = cut(_pass(indexed, asked, shared, k + 1, radius, blocks), "neighbours")
        enough = F.size("top") > k
        top = found if top is None else top.join(found, "key", "left_anti").unionByName(found)
        if radius >= codes.bits:
            break
        asked = cut(asked.join(found.filter(enough), "key", "left_anti"), "short_queries")
        if asked.isEmpty():
            break
        radius = min(codes.bits, max(1, 2 * radius))
    answered = split_join(rows.filter("asks").select(F.col("id").alias("query_id"), "key"), top, "key")
    others = F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return answered.select("query_id", F.posexplode(others).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _pass(indexed: DataFrame, asked: DataFrame, codes, k: int, radius: int, blocks: int) -> DataFrame:
    """key, top: the k best rows within the radius of every asked vector that has any."""
    asking = max(1, -(-asked.count() // QUERIES))
    deal = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(n)).cast("long")
    left = indexed.select(deal(blocks, 1).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(asking - 1))).alias("a"), F.lit(False).alias("asks"), "key", "vector", "ids")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), deal(asking, 2).alias("a"), F.lit(True).alias("asks"), "key", "vector", F.array().cast("array<bigint>").alias("ids"))
    both = left.union(right).select((F.col("b") * asking + F.col("a")).alias("pair"), "asks", "key", "vector", "ids")
    pairs = both.repartition(min(blocks * asking * 2, 4096), "pair").sortWithinPartitions("pair", "asks")
    found = pairs.mapInArrow(_search(codes, k, radius), "key string, found array<struct<vec_id:bigint,score:double>>")
    best = found.select("key", F.explode("found").alias("x")).select("key", "x.vec_id", "x.score")
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("r", rank).filter(F.col("r") <= k).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("top"))
