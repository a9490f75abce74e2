"""Quality classification by co-training two views of a page.

One classifier sees the text's content (shares of byte values, hashed words,
repetition), the other only what a page's listing tells about it (language,
source, size, and characters per word and line).  In each round each view ranks
the unlabelled documents and hands its surest share of each class to the other's
training set.  Both are then calibrated on held-out labels, and a combination
fitted there scores all documents.

The views are linear models fitted by weighted least squares.  What they need of
the training rows, labelled or pseudo-labelled, are sums, so every document of the
corpus takes part and no row leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel
from .sampling import fit_logistic, fold, logit, lowest_hash, sigmoid
from .workspace import cut, fresh

#: Labelled documents that the fit takes, at most, and held-out ones that calibrate.  All others are the pool.
LABELLED, CHECKS = 32768, 8192
LANGS, SOURCES, LENGTHS, SIZES, WORDS = 16, 48, 12, 12, 128
TEXT, META = 256 + WORDS + 6, LANGS * LENGTHS + SOURCES + 3 * SIZES + 2
#: Cells of the grid on which a view's scores of the pool are counted.
GRID, LOW, HIGH = 4096, -1.0, 2.0
ROWS = 512


def features(texts: pa.Array, chars: np.ndarray, lang: np.ndarray, source: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, text view, metadata view) for runs of at most ROWS whole texts; nan ``chars`` are unknown.

    Null and empty texts have a text view of zeros.
    """
    kept: list[tuple] = []
    seen, last = np.zeros(0, np.uint64), np.uint64(0)
    plain = np.arange(256, dtype=np.uint8)
    for at, data, bounds, whole in textkernel.pieces(texts, textkernel.SPACE, plain, ROWS):
        n = len(bounds) - 1
        size = np.diff(bounds)
        row = np.repeat(np.arange(n), size)
        bytes_ = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256)
        found, count = textkernel.word_hashes(textkernel.LOWER[data], bounds, textkernel.SPACE)
        owner = np.repeat(np.arange(n), count)
        words = np.bincount(owner * WORDS + (found >> np.uint64(57)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
        again = np.bincount(owner[1:], (found[1:] == found[:-1]) & (owner[1:] == owner[:-1]), n) if len(found) else np.zeros(n)
        order = np.lexsort((found, owner))
        new = np.ones(len(found), bool)
        new[1:] = (found[order][1:] != found[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = np.bincount(owner[order], new, n)
        if not whole or kept:  # one long row in pieces: its words are distinct over all of them
            again = again + int(len(seen) > 0 and len(found) > 0 and found[0] == last)
            seen, last = np.union1d(seen, found), found[-1] if len(found) else last
            distinct = np.array([len(seen)])
        kept.append((bytes_, words, count, again, size))
        if not whole:
            continue
        bytes_, words, count, again, size = (np.sum([k[i] for k in kept], axis=0) for i in range(5))
        kept, seen, last = [], np.zeros(0, np.uint64), np.uint64(0)
        upper, lower = bytes_[:, 65:91].sum(1), bytes_[:, 97:123].sum(1) + bytes_[:, 128:].sum(1)
        k, s = np.maximum(count, 1), np.maximum(size, 1)
        stats = np.column_stack([again / k, distinct / k, np.minimum(1, distinct / np.sqrt(k) / 30), upper / np.maximum(1, upper + lower), (upper + lower) / s, np.minimum(count, 1)])
        text = np.concatenate([np.sqrt(bytes_ / s[:, None]), np.sqrt(words / k[:, None]), np.where(count[:, None] > 0, stats, 0)], 1)
        yield at, text, _meta(chars[at : at + n], lang[at : at + n], source[at : at + n], count, bytes_[:, 10])


def _meta(chars: np.ndarray, lang: np.ndarray, source: np.ndarray, words: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    known = np.isfinite(chars)
    c = np.where(known, np.maximum(chars, 0), 0)
    each = c / np.maximum(words, 1)
    length = np.clip((np.log2(np.maximum(each, 1)) - 2) * 6, 0, LENGTHS - 1).astype(int)
    place = np.zeros((len(c), LANGS * LENGTHS))
    place[np.arange(len(c)), lang * LENGTHS + length] = known & (words > 0)
    # sizes are classes, not numbers, so that no page lies beyond what the fit has seen
    classes = [np.where(known, np.log2(c + 1) - 4, -1), np.where(known, np.log2(c / (breaks + 1) + 1) * 1.5 - 3, -1), np.log2(words / (breaks + 1) + 1) * 1.5]
    sizes = [np.eye(SIZES)[np.clip(x, 0, SIZES - 1).astype(int)] for x in classes]
    return np.concatenate([place, np.eye(SOURCES)[source], *sizes, ~known[:, None], (words == 0)[:, None]], 1)


@dataclass(frozen=True)
class View:
    """A calibrated linear model."""

    beta: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.beta[:-1] + self.beta[-1]

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.raw(x) * self.slope + self.shift, -30, 30)


@dataclass(frozen=True)
class Model:
    text: View
    meta: View
    weights: np.ndarray  # of the text's and the metadata's log odds, and the intercept
    given: tuple = ()  # for each round: labels (good, bad) that the text view and the metadata view handed over

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, text and metadata probabilities of good quality."""
        a, b = self.text.odds(text), self.meta.odds(meta)
        return sigmoid(np.column_stack([a, b, np.ones(len(a))]) @ self.weights), sigmoid(a), sigmoid(b)


def moments(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted sums over rows of (x, 1, y) by itself: all that least squares needs of them."""
    z = np.column_stack([x, np.ones(len(x)), y])
    return (z * weight[:, None]).T @ z


def fit_view(sums: np.ndarray, ridge: float = 1e-3) -> View:
    """Least squares of the label on standardised features, shrunk by ``ridge`` for each unit of weight."""
    d = len(sums) - 2
    total = max(sums[d, d], 1e-12)
    mean = sums[:d, d] / total
    spread = np.sqrt(np.maximum(np.diag(sums)[:d] / total - mean**2, 0))
    scale = np.where(spread > 1e-6, spread, np.inf)
    cov = (sums[:d, :d] / total - np.outer(mean, mean)) / np.outer(scale, scale)
    with_label = (sums[:d, d + 1] / total - mean * sums[d, d + 1] / total) / scale
    beta = np.linalg.solve(cov + (ridge + 20.0 / total) * np.eye(d), with_label) / scale
    return View(np.append(beta, sums[d, d + 1] / total - mean @ beta))


def soft(y: np.ndarray) -> np.ndarray:
    """Labels as smoothed rates, so that views that separate the classes get finite odds."""
    return np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))


def calibrate(view: View, x: np.ndarray, y: np.ndarray) -> View:
    slope, shift = fit_logistic(view.raw(x)[:, None], soft(y), ridge=1e-3)
    slope = max(float(slope), 0.0)
    return View(view.beta, slope, float(shift) if slope else float(logit(np.array([y.mean()]))[0]))


def combine(text: View, meta: View, xt: np.ndarray, xm: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of both views' log odds; a view that only hurts gets none."""
    odds = np.column_stack([text.odds(xt), meta.odds(xm)])
    weights = fit_logistic(odds, soft(y), ridge=0.3)
    if (weights[:2] < 0).any():
        i = int(np.argmax(weights[:2]))
        only = fit_logistic(odds[:, [i]], soft(y), ridge=0.3)
        weights = np.zeros(3)
        weights[i], weights[2] = only
    return weights


def _columns(docs: DataFrame, text_col: str, chars_col: str, lang_col: str, source_col: str) -> list[Column]:
    have = set(docs.columns)
    hashed = lambda c, n: (F.pmod(F.xxhash64(c), F.lit(n)) if c in have else F.lit(0)).cast("int")
    return [F.col(text_col).cast("string"), (F.col(chars_col) if chars_col in have else F.lit(None)).cast("double"), hashed(lang_col, LANGS), hashed(source_col, SOURCES)]


def _features(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    return features(batch.column(at), batch.column(at + 1).to_pandas().to_numpy(float), batch.column(at + 2).to_numpy(), batch.column(at + 3).to_numpy())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(role, label, text, chars, lang, source) -> role, label and both views in half precision."""
    for batch in batches:
        for at, text, meta in _features(batch, 2):
            rows = np.concatenate([text, meta], 1).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), batch.column(1).slice(at, len(rows)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["role", "label", "views"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(role, label, text view, metadata view) of at most ROWS rows at a time."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        rows = np.frombuffer(b"".join(part.column(2).to_pylist()), np.float16).reshape(-1, TEXT + META).astype(float)
        yield part.column(0).to_numpy(), part.column(1).to_numpy().astype(float), rows[:, :TEXT], rows[:, TEXT:]


def _sums(views, cuts, weight: float):
    """Packed rows -> one row of moments for each view: labelled rows and those that the other view labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((TEXT + 2, TEXT + 2)), np.zeros((META + 2, META + 2))]
        given = np.zeros(4)
        for batch in batches:
            for role, label, *x in _unpacked(batch):
                known = role == 1
                for i in (0, 1):
                    y, w = label, known.astype(float)
                    if views is not None:
                        raw = views[1 - i].raw(x[1 - i])
                        good, bad = (role == 0) & (raw >= cuts[1 - i][1]), (role == 0) & (raw <= cuts[1 - i][0])
                        given[2 * (1 - i) : 2 * (2 - i)] += good.sum(), bad.sum()
                        y, w = np.where(known, label, good), w + weight * (good ^ bad)
                    if w.any():
                        total[i] += moments(x[i][w > 0], y[w > 0], w[w > 0])
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total[0].ravel(), total[1].ravel(), given]).tobytes()], pa.binary())], names=["sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column(0):
            part = np.frombuffer(x.as_buffer(), float)
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def _grid(views):
    """Packed rows -> for each partition how many pool rows each view gives each cell of the score grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, GRID), np.int64)
        for batch in batches:
            for role, _, *x in _unpacked(batch):
                for i in (0, 1):
                    cell = np.clip((views[i].raw(x[i][role == 0]) - LOW) / (HIGH - LOW) * GRID, 0, GRID - 1).astype(int)
                    held[i] += np.bincount(cell, minlength=GRID)
        view, cell = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(view.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(held[view, cell])], names=["view", "cell", "n"])

    return run


def _fit_round(rows: DataFrame, views, cuts, weight: float) -> tuple[list[View], np.ndarray]:
    sums = rows.mapInArrow(_sums(views, cuts, weight), "sums binary")
    for parts in (64, 4):
        sums = sums.repartition(parts).mapInArrow(_added, "sums binary")
    total = sum(np.frombuffer(r[0], float) for r in sums.collect())
    a = (TEXT + 2) ** 2
    return [fit_view(total[:a].reshape(TEXT + 2, -1)), fit_view(total[a:-4].reshape(META + 2, -1))], total[-4:]


def _cuts(rows: DataFrame, views: list[View], share: float, rate: float) -> list[tuple[float, float]]:
    """For each view the scores at or below and at or above which it hands a row over: its surest ``share`` of the pool, split by the classes' rate."""
    held = np.zeros((2, GRID))
    for r in rows.mapInArrow(_grid(views), "view int, cell int, n long").groupBy("view", "cell").agg(F.sum("n").alias("n")).collect():
        held[r["view"], r["cell"]] = r["n"]
    out = []
    for counts in held:
        n = counts.sum()
        low = np.flatnonzero(np.cumsum(counts) <= share * (1 - rate) * n)
        high = np.flatnonzero(np.cumsum(counts[::-1])[::-1] <= share * rate * n)
        edge = lambda cell: LOW + (HIGH - LOW) * cell / GRID
        out.append((edge(low[-1] + 1) if len(low) and n else -np.inf, edge(high[0]) if len(high) and n else np.inf))
    return out


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", chars_col: str = "n_chars", lang_col: str = "lang", source_col: str = "source", rounds: int = 2, share: float = 0.2, weight: float = 0.25, labelled: int = LABELLED, checks: int = CHECKS) -> Model:
    """Fit both views on at most ``labelled`` labelled documents (whose ids hash lowest), exchanging pseudo-labels of all others.

    Labels above 0 mean good.  Rows without id or label are left out; several
    labels of one id count as their minimum.  Every fifth labelled id is no
    training row; of them ``checks`` at most, those that hash lowest, calibrate.  Each round a view
    hands over the ``share`` of the pool that it ranks surest; a pseudo-label weighs ``weight``.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.min(label_col) > 0).cast("int").alias("label"))
    slim = docs.select(F.col(id_col).alias("id"), *[c.alias(f"c{i}") for i, c in enumerate(_columns(docs, text_col, chars_col, lang_col, source_col))])
    known = F.broadcast(cut(lowest_hash(known.join(slim.select("id"), "id", "left_semi"), labelled), "labelled"))
    check = fold(F.col("id")) == 1
    rows = slim.join(known, "id", "left").select(F.when(F.col("label").isNull(), 0).when(check, 2).otherwise(1).alias("role"), F.coalesce("label", F.lit(-1)).alias("label"), "c0", "c1", "c2", "c3")
    rows = cut(rows.mapInArrow(_packed, "role int, label int, views binary"), "views")
    counts = {(r["role"], r["label"]): r["count"] for r in rows.groupBy("role", "label").count().collect()}
    good, bad = counts.get((1, 1), 0), counts.get((1, 0), 0)
    if not good or not bad:
        good, bad = (sum(counts.get((r, c), 0) for r in (1, 2)) for c in (1, 0))
        rate = float(logit(np.array([(good + 1) / (good + bad + 2)]))[0])
        return Model(View(np.append(np.zeros(TEXT), 0.0), 0.0, rate), View(np.append(np.zeros(META), 0.0), 0.0, rate), np.array([1.0, 0.0, 0.0]))
    views, cuts, given = None, None, []
    for _ in range(rounds + 1):
        views, handed = _fit_round(rows, views, cuts, weight)
        if cuts is not None:
            given.append(tuple(handed.astype(int).tolist()))
        if len(given) < rounds:
            cuts = _cuts(rows, views, share, good / (good + bad))
    both = counts.get((2, 1), 0) and counts.get((2, 0), 0)
    held = lowest_hash(rows.filter(F.col("role") == (2 if both else 1)).select("views", "label"), checks).toArrow()
    y = held.column("label").to_numpy().astype(float)
    x = np.frombuffer(b"".join(held.column("views").to_pylist()), np.float16).reshape(-1, TEXT + META).astype(float)
    text, meta = calibrate(views[0], x[:, :TEXT], y), calibrate(views[1], x[:, TEXT:], y)
    return Model(text, meta, combine(text, meta, x[:, :TEXT], x[:, TEXT:], y), tuple(given))


def _score(model, names: list[str], width: int, keep: float | None):
    """Batches of ``width`` columns and then the features' inputs -> the columns and three scores (or the rows scoring ``keep``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, *views in _features(batch, width):
                part = batch.slice(at, len(views[0]))
                both, text, meta = (np.round(x, 12) for x in model.value.score(*views))
                both = np.where(np.array(pc.fill_null(pc.utf8_length(part.column(width)), 0)) == 0, 0.0, both)
                if keep is None:
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], *[pa.array(x) for x in (both, text, meta)]], names=names)
                else:
                    yield pa.RecordBatch.from_arrays(part.columns[:width], names=names).filter(pa.array(both >= keep))

    return run


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", chars_col: str = "n_chars", lang_col: str = "lang", source_col: str = "source", keep: float | None = None) -> DataFrame:
    """``docs`` with quality, text_quality and meta_quality (probabilities); with ``keep``, only the rows of that quality and no new columns.

    Defined cases: a null or empty text has quality 0; missing or null metadata
    are features of their own; columns named as the outputs are replaced; repeated
    rows score alike; an empty table gives no rows.  Without labels of both
    classes every text gets the (smoothed) rate of good ones.
    """
    outs = ["quality", "text_quality", "meta_quality"]
    base = docs if keep is not None else docs.drop(*outs)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    inputs = [c.alias(fresh(base, f"c{i}")) for i, c in enumerate(_columns(docs, text_col, chars_col, lang_col, source_col))]
    kind = T.StructType([*base.schema.fields, *([T.StructField(c, T.DoubleType()) for c in outs] if keep is None else [])])
    return base.select(*[F.col(f"`{c}`") for c in base.columns], *inputs).mapInArrow(_score(broadcast, kind.names, len(base.columns), keep), kind)


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that a classifier fitted on ``labels`` gives at least ``threshold``."""
    return score_quality(docs, train_quality(docs, labels, **options), keep=threshold)
