"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import textkernel

#: Labelled documents that centroids are fitted on, at most; of them so many of one language.
SAMPLE, PER_LANGUAGE = 2048, 512
#: Texts that are turned into vectors at a time.
ROWS = 256
DIMENSIONS, GRAMS, CENTROIDS = 4096, (2, 3), 4
UNKNOWN = "und"


def term_counts(texts: pa.Array) -> Iterator[np.ndarray]:
    """Rows of counts of hashed byte n-grams of whole texts (A-Z folded), for runs of texts in order."""
    carry = None
    for _, rows, whole, found in textkernel.gram_pieces(texts, textkernel.NOT_ALNUM, textkernel.LOWER, GRAMS, ROWS):
        counts = np.zeros(rows * DIMENSIONS)
        for row, grams in found:
            counts += np.bincount(row * DIMENSIONS + (grams >> np.uint64(52)).astype(np.int64), minlength=len(counts))
        counts = counts.reshape(rows, DIMENSIONS)
        if carry is not None:
            counts += carry
        carry = None if whole else counts
        if whole:
            yield counts


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    """Unit centroids (rows) with their language, the least cosine that each accepts, and the softmax's sharpness."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray
    sharpness: float

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest language, its probability, the cosine, and whether the distance is beyond what its centroid accepts."""
        cosine = _weigh(counts, self.idf) @ self.centroids.T
        best = np.stack([cosine[:, self.owner == i].max(1) for i in range(len(self.languages))], 1)
        e = np.exp(self.sharpness * (best - best.max(1, keepdims=True)))
        nearest = cosine.argmax(1)
        top = cosine[np.arange(len(cosine)), nearest]
        return self.owner[nearest], (e / e.sum(1, keepdims=True))[np.arange(len(e)), self.owner[nearest]], top, top < self.floor[nearest]


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out starts: unit centroids and each row's."""
    starts = [0]
    far = x @ x[0]
    while len(starts) < min(k, len(x)):
        starts.append(int(np.argmin(far)))
        far = np.maximum(far, x @ x[starts[-1]])
    c = x[starts]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, (x @ c.T).argmax(1)


def fit(counts: np.ndarray, langs: list[str], idf: np.ndarray, centroids: int = CENTROIDS) -> Model:
    """Centroids of each language; a centroid accepts a cosine down to four deviations below its members' mean."""
    languages = sorted(set(langs))
    x = _weigh(counts, idf)
    index = np.array([languages.index(l) for l in langs], int)
    found, owner, floor = [], [], []
    for i in range(len(languages)):
        mine = x[index == i]
        c, own = cluster(mine, centroids)
        near = (mine * c[own]).sum(1)
        for j in range(len(c)):
            inside = near[own == j]
            found.append(c[j])
            owner.append(i)
            floor.append(max(0.0, float(inside.mean() - 4 * inside.std()) - 0.05) if len(inside) else 0.0)
    owner = np.array(owner, int)
    centres = np.array(found).reshape(len(owner), counts.shape[1])
    best = np.stack([(x @ centres.T)[:, owner == i].max(1) for i in range(len(languages))], 1) if languages else np.zeros((0, 1))

    def loss(sharpness: float) -> float:
        e = sharpness * (best - best.max(1, keepdims=True))
        return float((np.log(np.exp(e).sum(1)) - e[np.arange(len(e)), index]).mean())

    sharpness = min((2.0**i for i in range(0, 9)), key=loss) if len(languages) > 1 else 1.0
    return Model(languages, idf, centres, owner, np.array(floor), sharpness)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for counts in term_counts(batch.column(2)):
            flat = pa.array(counts.astype(np.int64).ravel())
            lists = pa.FixedSizeListArray.from_arrays(flat, DIMENSIONS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(counts)), batch.column(1).slice(at, len(counts)), lists], names=["id", "lang", "counts"])
            at += len(counts)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> for each partition how many of them have each term, and (term -1) how many there are."""
    held, n = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        n += batch.num_rows
        for counts in term_counts(batch.column(0)):
            held += (counts > 0).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS, dtype=np.int32)), pa.array(np.append(n, held))], names=["term", "held"])


def train_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on at most ``sample`` labelled documents, at most ``per_language`` of each language.

    Every language gets an equal number, of the ids that hash lowest.  If there are
    more than ``sample`` languages, the most frequent ones are learned.  Document
    frequencies are those of all labelled documents.  Rows without id, text or
    language are left out.
    """
    known = docs.filter(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    ids = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"))
    languages = [r["lang"] for r in ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()]
    each = max(1, min(per_language, sample // max(1, len(languages))))
    spark = docs.sparkSession
    learned = F.broadcast(spark.createDataFrame([(l,) for l in languages], "lang string"))
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    wanted = ids.join(learned, "lang", "left_semi").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= each)
    wanted = F.broadcast(wanted.select(F.col("id").alias("wanted")).distinct())
    rows = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).join(wanted, F.col("id") == F.col("wanted"), "left_semi")
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_counted, f"id {kind}, lang string, counts array<long>").toArrow()
    if not found.num_rows:
        return Model([], np.ones(DIMENSIONS), np.zeros((0, DIMENSIONS)), np.zeros(0, int), np.zeros(0), 1.0)
    langs = found.column("lang").to_pylist()
    counts = np.concatenate([c.flatten().to_numpy() for c in found.column("counts").chunks]).reshape(-1, DIMENSIONS)
    order = sorted(range(len(langs)), key=lambda i: (langs[i], repr(found.column("id")[i].as_py())))
    held = np.zeros(DIMENSIONS + 1)
    for r in known.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_frequencies, "term int, held long").groupBy("term").agg(F.sum("held").alias("held")).collect():
        held[r["term"] + 1] = r["held"]
    return fit(counts[order].astype(np.float32), [langs[i] for i in order], np.log((1 + held[0]) / (1 + held[1:])) + 0.1)


def _has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each whole text has a letter of any script; null has none."""
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def _predict(model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        languages = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            letters = _has_letter(texts)
            at = 0
            for counts in term_counts(texts):
                n = len(counts)
                if m.languages:
                    lang, score, cosine, far = m.predict(counts)
                else:
                    lang, score, cosine, far = np.zeros(n, int), np.zeros(n), np.zeros(n), np.ones(n, bool)
                some = letters[at : at + n]
                lang = np.where(some, lang, len(m.languages))
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(languages[lang], pa.string()), pa.array(np.where(some, score, 0.0)), pa.array(np.where(some, cosine, 0.0)), pa.array(far | ~some)], names=names)
                at += n

    return run


def identify_languages(docs: DataFrame, model: Model, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``docs`` (or the columns ``keep``) with lang_pred, lang_score, lang_cosine and lang_rejected.

    ``lang_pred`` is the nearest centroid's language and ``lang_score`` its
    probability; ``lang_rejected`` marks texts farther from that centroid than it
    accepts, which callers may treat as unknown.  A text that is null or has no
    letter is ``und`` with score 0 and rejected; so is every text if nothing was
    learned.  Repeated rows fare alike; an empty table gives no rows; columns named
    as the outputs are replaced.
    """
    outs = ["lang_pred", "lang_score", "lang_cosine", "lang_rejected"]
    base = docs.select(*keep, F.col(text_col).alias(text_col)) if keep is not None else docs
    columns = [c for c in (base.columns[:-1] if keep is not None else base.columns) if c not in outs]
    slim = base.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col).cast("string").alias("\0text"))
    kind = T.StructType([*slim.schema.fields[:-1], T.StructField(outs[0], T.StringType()), T.StructField(outs[1], T.DoubleType()), T.StructField(outs[2], T.DoubleType()), T.StructField(outs[3], T.BooleanType())])
    return slim.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), kind.names), kind)
