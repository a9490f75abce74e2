"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Terms are the byte 5-grams inside words (a word's ends count as a space; words
below four bytes have none).  Every term of every example is in the vocabulary, and
all documents count for its document frequency.  A term's idf is multiplied by how
surely it tells the classes apart among the examples: without that, what texts talk
about decides which are near, and toxic wording, a few words of a text, hardly does.
The examples stand in blocks of an inverted index: a block holds, for each of its
terms, the postings (example, weight) and their largest weight; a term has entries
for the blocks that hold it only.  A query visits only blocks whose summed maxima
reach its k-th best cosine, so the neighbours are exact; the commonest terms are
full rows whose exact sums, lower bounds of the cosines, come before the lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel
from .language import cluster
from .sampling import fit_logistic, fold, lowest_hash, sigmoid
from .workspace import cut

#: Labelled documents of each class that serve as examples, and that calibrate, at most.
EXAMPLES = 1024
GRAM, BLOCK, NEIGHBOURS = 5, 64, 200
#: The vote is taken among so many of the nearest.
VOTES = (15, 50, 200)
#: Texts that are turned into vectors at a time.
ROWS = 256
#: Weight of a term that tells the classes apart not at all, beside the standard score of those that do.
FLOOR = 0.1
#: Terms whose postings are kept as full rows of a block (the most frequent ones); all others are lists.
FULL = 4096


class Vocabulary:
    """Hashes of terms -> their numbers."""

    def __init__(self, hashes: np.ndarray, bits: int = 20):
        self.hashes, self.shift = np.sort(hashes), np.uint64(64 - bits)
        place = (self.hashes >> self.shift).astype(np.int64)
        self.slots = np.full((1 << bits) + 1, -1, np.int32)
        self.slots[place] = np.arange(len(place))
        self.slots[place[1:][place[1:] == place[:-1]]] = -2  # several terms: search

    def numbers(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of known terms, their numbers)."""
        found = self.slots[(terms >> self.shift).astype(np.int64)]
        several = np.flatnonzero(found == -2)
        if len(several):
            found[several] = np.minimum(np.searchsorted(self.hashes, terms[several]), len(self.hashes) - 1)
        at = np.flatnonzero(found >= 0)
        at = at[self.hashes[found[at]] == terms[at]]
        return at, found[at].astype(np.int64)


def grams(texts: pa.Array, rows: int = ROWS) -> Iterator[tuple[int, int, bool, np.ndarray, np.ndarray]]:
    """(first row, rows, complete, row of each term, its hash) of whole texts, A-Z folded; a long row comes in several parts."""
    for at, count, whole, [(row, hashes)] in textkernel.gram_pieces(texts, textkernel.NOT_ALNUM, textkernel.LOWER, (GRAM,), rows):
        yield at, count, whole, row, hashes


def counted(texts: pa.Array, vocabulary: Vocabulary) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bounds of its rows, term numbers, their counts) for runs of at most ROWS whole texts, in order."""
    size = max(1, len(vocabulary.hashes))
    carry: tuple[np.ndarray, np.ndarray] | None = None
    for at, rows, whole, row, hashes in grams(texts):
        place, number = vocabulary.numbers(hashes) if len(vocabulary.hashes) else (np.zeros(0, int), np.zeros(0, int))
        key, count = np.unique(row[place] * size + number, return_counts=True)
        if carry is not None:
            key, back = np.unique(np.concatenate([carry[0], key]), return_inverse=True)
            count = np.bincount(back, np.concatenate([carry[1], count]), len(key)).astype(np.int64)
        carry = None if whole else (key, count)
        if whole:
            yield at, np.searchsorted(key, np.arange(rows + 1) * size), key % size, count


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> the distinct terms of each run of them."""
    for batch in batches:
        for _, _, _, _, hashes in grams(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes).view(np.int64))], names=["term"])


def _counts(vocabulary):
    """(id, label, role, text) -> id, label, role and the text's terms and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, bounds, terms, counts in counted(batch.column(3), vocabulary.value):
                lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (terms, counts)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, len(bounds) - 1) for c in range(3)], *lists], names=["id", "label", "calibrates", "terms", "counts"])

    return run


def _frequencies(vocabulary):
    """Texts -> for each partition how many of them have each term, and (term -1) how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        held, n = np.zeros(len(v.hashes), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, terms, _ in counted(batch.column(0), v):
                held += np.bincount(terms, minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(held[some], n))], names=["term", "held"])

    return run


@dataclass(frozen=True)
class Rows:
    """Sparse unit vectors: row i has ``terms[bounds[i]:bounds[i + 1]]`` with those ``weights``."""

    bounds: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, bounds: np.ndarray, terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> Rows:
        """TF-IDF: 1 + log of the count, times the term's idf; length one (a text without terms stays zero)."""
        w = (1 + np.log(counts)) * idf[terms]
        total = np.concatenate([[0.0], np.cumsum(w * w)])
        norm = np.sqrt(np.maximum(total[bounds[1:]] - total[bounds[:-1]], 1e-24))
        return cls(bounds, terms, w / np.repeat(norm, np.diff(bounds)))

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.bounds))

    def dense(self, column: np.ndarray, width: int) -> np.ndarray:
        """The columns that ``column`` (number by term, -1: none) gives, as a matrix."""
        out = np.zeros((len(self), width))
        c = column[self.terms]
        out[self.owner()[c >= 0], c[c >= 0]] = self.weights[c >= 0]
        return out

    def take(self, rows: np.ndarray) -> Rows:
        at, lengths = _runs(self.bounds[rows], self.bounds[rows + 1] - self.bounds[rows])
        return Rows(np.concatenate([[0], np.cumsum(lengths)]), self.terms[at], self.weights[at])


def _runs(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions starts[i] .. starts[i] + lengths[i] - 1 one after another, and the lengths."""
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    return np.repeat(starts - first, lengths) + np.arange(int(lengths.sum())), lengths


class Index:
    """Examples in blocks of BLOCK; every block has postings by term and their largest weights."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: Rows, terms: int):
        held = np.bincount(rows.terms, minlength=terms)
        full = np.sort(np.argsort(-held, kind="stable")[:FULL])
        self.column = np.full(terms, -1, np.int64)
        self.column[full] = np.arange(len(full))
        dense = rows.dense(self.column, len(full))
        some = np.flatnonzero(np.diff(rows.bounds) > 0)
        if len(some):  # like examples share blocks, so that the maxima tell blocks apart
            length = np.maximum(np.linalg.norm(dense[some], axis=1, keepdims=True), 1e-12)
            centre, own = cluster(dense[some] / length, max(1, len(some) // BLOCK))
            some = some[np.lexsort((ids[some], own))]
        self.ids, self.labels, self.full = ids[some], labels[some], dense[some]
        self.rank = np.argsort(np.argsort(self.ids, kind="stable"), kind="stable")
        rows = rows.take(some)
        self.blocks = -(-len(some) // BLOCK)
        owner = rows.owner()
        column = self.column[rows.terms]
        often = column >= 0
        self.full_most = np.zeros((len(full), max(1, self.blocks)))
        np.maximum.at(self.full_most, (column[often], owner[often] // BLOCK), rows.weights[often])
        rare = np.flatnonzero(~often)
        order = rare[np.lexsort((owner[rare], rows.terms[rare]))]
        self.example, self.weight = (owner[order] % BLOCK).astype(np.uint8), rows.weights[order]
        # a cell is a term in a block: where its postings start, their block and their largest weight
        cell = rows.terms[order] * max(1, self.blocks) + owner[order] // BLOCK
        start = np.flatnonzero(np.diff(cell, prepend=-1))
        self.start = np.append(start, len(order)).astype(np.int32)
        self.block = (cell[start] % max(1, self.blocks)).astype(np.uint16 if self.blocks < 1 << 16 else np.int32)
        self.most = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.cells = np.searchsorted(cell[start] // max(1, self.blocks), np.arange(terms + 1)).astype(np.int32)

    def nearest(self, queries: Rows, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, int]:
        """For each query the k examples of largest positive cosine (position, or -1), the cosines (ties to the smaller id), and the blocks visited."""
        n, size = len(queries), len(self.ids)
        if not n or not size:
            return np.full((n, k), -1), np.zeros((n, k)), 0
        full = queries.dense(self.column, self.full.shape[1])
        listed = np.flatnonzero(self.column[queries.terms] < 0)
        owner, terms, weights = queries.owner()[listed], queries.terms[listed], queries.weights[listed]
        first = self.cells[terms].astype(np.int64)
        cell, lengths = _runs(first, self.cells[terms + 1] - first)  # the cells of each query term, by block
        order = np.argsort(self.block[cell], kind="stable")
        cell, owner, weights = cell[order], np.repeat(owner, lengths)[order], np.repeat(weights, lengths)[order]
        ends = np.searchsorted(self.block[cell], np.arange(self.blocks + 1))
        listed = np.bincount(owner * self.blocks + self.block[cell], weights * self.most[cell], n * self.blocks).reshape(n, -1)
        # no weight is negative: what the full rows give is a lower bound of each cosine, and with the listed terms' maxima an upper one of each block
        found = full @ self.full.T
        least = np.partition(found, -k, axis=1)[:, -k] if size > k else np.zeros(n)
        edges = np.arange(0, size, BLOCK)
        upper = np.maximum.reduceat(found, edges, axis=1) + listed
        visited = 0
        for turn, b in enumerate(np.argsort(-upper.sum(0), kind="stable").tolist()):
            if turn % 8 == 7 and size > k:
                least = np.partition(found, -k, axis=1)[:, -k]
            active = np.flatnonzero((upper[:, b] > 0) & (upper[:, b] >= least - 1e-9))
            if not len(active):
                continue
            visited += len(active)
            lo, hi = b * BLOCK, min((b + 1) * BLOCK, size)
            row = np.full(n, -1)
            row[active] = np.arange(len(active))
            to = row[owner[ends[b] : ends[b + 1]]]
            mine = np.flatnonzero(to >= 0)
            own = cell[ends[b] + mine]
            start = self.start[own]
            at, lengths = _runs(start, self.start[own + 1] - start)
            to = np.repeat(to[mine] * BLOCK, lengths) + self.example[at]
            score = np.bincount(to, np.repeat(weights[ends[b] + mine], lengths) * self.weight[at], len(active) * BLOCK).reshape(-1, BLOCK)[:, : hi - lo]
            found[active, lo:hi] += score
        key = np.round(found * 1e9).astype(np.int64) * size + (size - 1 - self.rank)
        top = np.argpartition(-key, min(k, size) - 1, axis=1)[:, : min(k, size)]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, 1), axis=1), 1)
        cosine = np.take_along_axis(found, top, 1)
        pad = ((0, 0), (0, k - top.shape[1]))
        return np.pad(np.where(cosine > 1e-9, top, -1), pad, constant_values=-1), np.pad(np.where(cosine > 1e-9, cosine, 0.0), pad), visited


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    idf: np.ndarray
    index: Index
    beta: np.ndarray  # of the votes' inputs, and the intercept
    base: float  # smoothed log odds of toxic, for texts without neighbours
    weight: tuple[float, float] = (1.0, 1.0)  # training labels of class 0 and 1 for each example of it

    def inputs(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of the calibration (log odds of the distance-weighted votes, lead of the five nearest toxic over the five nearest clean ones), neighbours and cosines."""
        best, cosine, _ = self.index.nearest(rows)
        toxic = np.where(best >= 0, self.index.labels[best] if len(self.index.ids) else 0, 0)
        weight = np.where(best >= 0, cosine / (1.05 - np.minimum(cosine, 1)), 0.0) * np.array(self.weight)[toxic]
        shares = [((weight * toxic)[:, :k].sum(1) + 0.01) / (weight[:, :k].sum(1) + 0.02) for k in VOTES]
        near = [np.where((best >= 0) & (toxic == c) & (np.cumsum(toxic == c, axis=1) <= 5), cosine, 0.0).sum(1) for c in (1, 0)]
        return np.column_stack([*[np.log(x / (1 - x)) for x in shares], 2 * (near[0] - near[1])]), best, cosine

    def score(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inputs, best, cosine = self.inputs(rows)
        odds = np.where((best >= 0).any(1), np.column_stack([inputs, np.ones(len(rows))]) @ self.beta, self.base)
        return np.round(sigmoid(odds), 9), best, cosine


def _sampled(known: DataFrame, most: int) -> tuple[DataFrame, tuple[float, float]]:
    """At most ``most`` ids of each class, those that hash lowest, and how many labels each stands for."""
    many = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    return lowest_hash(known.filter("label = 1"), most).union(lowest_hash(known.filter("label = 0"), most)), tuple(max(1.0, many.get(c, 0) / max(1, most)) for c in (0, 1))


def train_toxicity(docs: DataFrame, labels: DataFrame, held: Column, id_col: str = "doc_id", label_col: str = "toxic", text_col: str = "text", examples: int = EXAMPLES) -> Model:
    """Examples, index and calibration from the labels of ids outside ``held`` (a condition on ``id``).

    Ids with a document are taken only, so labels without one use up no place.  A
    fifth of them (another fold of the id) calibrates and serves as no example.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    known = known.filter(~held).join(rows.select("id"), "id", "left_semi").withColumn("calibrates", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(5)) == 0)
    known = cut(known, "labelled")
    taken, weight = _sampled(known.filter("not calibrates"), examples)
    checks, check_weight = _sampled(known.filter("calibrates"), examples)
    chosen = F.broadcast(cut(taken.union(checks), "chosen"))
    texts = cut(rows.join(chosen, "id").groupBy("id", "label", "calibrates").agg(F.min("text").alias("text")), "examples")
    distinct = texts.filter("not calibrates").select("text").mapInArrow(_terms, "term long").distinct().toArrow()
    vocabulary = Vocabulary(distinct.column(0).to_numpy().view(np.uint64))
    shared = spark.sparkContext.broadcast(vocabulary)
    partial = rows.select("text").mapInArrow(_frequencies(shared), "term int, held long")
    sums = partial.groupBy("term").agg(F.sum("held").alias("held")).toArrow()
    term, count = (sums.column(c).to_numpy() for c in (0, 1))
    frequency = np.zeros(len(vocabulary.hashes))
    frequency[term[term >= 0]] = count[term >= 0]
    idf = np.log((1 + count[term < 0].sum()) / (1 + frequency)) + 0.1
    kind = rows.schema["id"].dataType.simpleString()
    sample = texts.select("id", "label", "calibrates", "text").mapInArrow(_counts(shared), f"id {kind}, label int, calibrates boolean, terms array<int>, counts array<int>").orderBy("id").toArrow()
    return fit(sample, vocabulary, idf, weight, check_weight)


def contrast(bounds: np.ndarray, terms: np.ndarray, label: np.ndarray, size: int) -> np.ndarray:
    """For each term the standard score of its log odds ratio between rows of label 1 and 0 (smoothed by a half; other labels don't count)."""
    of = np.repeat(label, np.diff(bounds))
    odds, variance = [], np.zeros(size)
    for c in (1, 0):
        held, rows = np.bincount(terms[of == c], minlength=size), int((label == c).sum())
        odds.append(np.log((held + 0.5) / (rows - held + 0.5)))
        variance += 1 / (held + 0.5) + 1 / (rows - held + 0.5)
    return (odds[0] - odds[1]) / np.sqrt(variance)


def fit(sample: pa.Table, vocabulary: Vocabulary, idf: np.ndarray, weight: tuple[float, float] = (1.0, 1.0), check_weight: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Weigh terms by the examples of ``sample`` (id, label, calibrates, terms, counts), index these and calibrate their votes on the other rows."""
    ids, label = np.array(sample.column("id").to_pylist()), np.array(sample.column("label").to_pylist(), int)
    checks = np.array(sample.column("calibrates").to_pylist(), bool)
    lists = sample.column("terms").combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.int32()))
    counts = sample.column("counts").combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.int32()))
    bounds = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))]).astype(np.int64) if len(lists) else np.zeros(1, np.int64)
    mine, other = np.flatnonzero(~checks), np.flatnonzero(checks)
    terms = lists.flatten().to_numpy().astype(np.int64)
    idf = idf * (FLOOR + np.abs(contrast(bounds, terms, np.where(checks, -1, label), len(idf))))
    rows = Rows.of(bounds, terms, counts.flatten().to_numpy(), idf)
    index = Index(ids[mine] if len(mine) else np.zeros(0, int), label[mine], rows.take(mine), len(idf))
    total = np.bincount(label, np.where(checks[:, None], check_weight, weight)[np.arange(len(label)), label], 2) if len(label) else np.zeros(2)
    base = float(np.log((total[1] + 1) / (total[0] + 1)))
    if len(set(label[other].tolist())) < 2 or len(set(label[mine].tolist())) < 2:
        return Model(vocabulary, idf, index, np.append(np.zeros(len(VOTES) + 1), base), base, weight)
    bare = Model(vocabulary, idf, index, np.zeros(len(VOTES) + 2), base, weight)
    inputs = np.concatenate([bare.inputs(rows.take(other[a : a + ROWS]))[0] for a in range(0, len(other), ROWS)])
    beta = fit_logistic(inputs, label[other].astype(float), np.array(check_weight)[label[other]], ridge=0.5)
    return Model(vocabulary, idf, index, beta, base, weight)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", text_col: str = "text", held: int = 0, examples: int = EXAMPLES) -> DataFrame:
    """id, held_out, score, predicted and evidence (the five nearest examples: id, label, cosine) of every row of ``docs``.

    Labels come only from ids outside fold ``held`` of five (crc32 of the id as
    text); of each class at most ``examples`` ids are examples and as many
    calibrate, those that hash lowest.  Both count for all training labels of their
    class, so the real ratio of the classes holds where ``examples`` binds.

    Defined cases: null and empty texts have no terms; texts without neighbours get
    the smoothed rate of toxic training labels; rows without id are held out; several labels of
    an id count as their maximum, several texts of an example as the smallest;
    null labels are left out; where examples or calibrating labels are of one class
    or none, every score is their smoothed rate; repeated rows score alike; a very
    long text is read in pieces; an empty table gives no rows; other columns are
    ignored.
    """
    model = train_toxicity(docs, labels, fold(F.col("id")) == held, id_col, label_col, text_col, examples)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, score double, evidence array<struct<id:{kind},label:int,cosine:double>>"
    scored = rows.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), schema)
    return scored.select(F.col("id").alias(id_col), (fold(F.col("id")) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def _scored(model, shown: int = 5):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            for at, bounds, terms, counts in counted(batch.column(1), m.vocabulary):
                score, best, cosine = m.score(Rows.of(bounds, terms, counts, m.idf))
                best, cosine = best[:, :shown], cosine[:, :shown]
                ends = np.concatenate([[0], np.cumsum((best >= 0).sum(1))]).astype(np.int32)
                flat = best[best >= 0]
                kind = batch.column(0).type
                evidence = pa.StructArray.from_arrays([pa.array(m.index.ids[flat], kind), pa.array(m.index.labels[flat].astype(np.int32)), pa.array(cosine[best >= 0])], names=["id", "label", "cosine"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(bounds) - 1), pa.array(score), pa.ListArray.from_arrays(pa.array(ends), evidence)], names=["id", "score", "evidence"])

    return run
