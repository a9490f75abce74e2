"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are reduced to their lower-cased letters and digits.
The passage that counts is any run of n = ``least`` characters of an item (the
whole item if it is shorter).  A region holds it if it is the passage after at
most ``k`` edits and the replacement of one run of at most ``w`` characters (a
word) by another such run.  The edits spoil at most q * k q-grams and the run
w + q - 1, so region and passage share ``n - 2 * q + 2 - w - q * k`` q-grams whose
diagonals (document position minus item position) differ by at most ``k + w``.
Counting the q-grams shared with each passage in overlapping diagonal bands
therefore keeps every such region; an alignment then decides.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernel import mix
from .workspace import cut, fresh

#: Characters of benchmark text that one pass over the documents searches for; more items take more passes.
SLICE = 1 << 20
#: Characters of documents that are scanned at a time.
PIECE = 1 << 20
TABLE_BITS = 22
MATCH = "array<struct<item_id:bigint,start:bigint,end:bigint,edits:int>>"


@dataclass(frozen=True)
class Rule:
    """q-gram length; least passage; shortest item searched with edits (shorter ones: exactly, as whole words); one edit allowed for every ``per_edit`` characters; longest run that may be replaced."""

    q: int = 8
    least: int = 56
    shortest: int = 20
    per_edit: int = 30
    word: int = 20

    def budget(self, n: int) -> int:
        return n // self.per_edit

    def run(self, n: int) -> int:
        """Longest replaced run in a passage of n characters: of short ones less, so that a q-gram is left."""
        return max(0, min(self.word, n * 5 // 14, n - 2 * self.q + 1 - self.q * self.budget(n)))


_kept: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is kept (a letter or digit)."""
    if not _kept:
        _kept.append(np.array([chr(c).isalnum() for c in range(0x110000)], bool))
    return _kept[0]


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased letters and digits, and their positions in the lower-cased text."""
    # one lower-case sigma wherever it stands, so that a piece of a text is lowered as in the whole
    codes = np.frombuffer(text.replace("\u03a3", "\u03c3").replace("\u03c2", "\u03c3").lower().encode("utf-32-le", "replace"), np.uint32)
    at = np.flatnonzero(_letters()[np.minimum(codes, 0x10FFFF)])
    return codes[at], at


def qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram, by doubling."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    total, done, rest = None, 0, q
    power, size = codes.astype(np.uint64) + np.uint64(1), 1
    while rest:
        if rest & 1:
            shifted = power[done : done + len(codes) - q + 1]
            total = shifted if total is None else total * np.uint64(pow(base, size, 1 << 64)) + shifted
            done += size
        rest >>= 1
        if rest:
            power = power[:-size] * np.uint64(pow(base, size, 1 << 64)) + power[size:]
            size *= 2
    return mix(total)


class Index:
    """Items of one slice of the benchmark and their q-grams."""

    def __init__(self, items: list[tuple[int, str]], rule: Rule):
        self.rule, self.segments = rule, []
        hashes, owners, places = [], [], []
        self.short: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = {}
        for item, text in items:
            codes, _ = normalise(text or "")
            if len(codes) < rule.shortest:
                if len(codes):
                    self.short.setdefault(len(codes), {}).setdefault(int(qgrams(codes, len(codes))[0]), []).append((item, codes))
                continue
            grams = qgrams(codes, rule.q)
            owners.append(np.full(len(grams), len(self.segments), np.int32))
            places.append(np.arange(len(grams), dtype=np.int32))
            hashes.append(grams)
            self.segments.append((item, codes))
        join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        hashes, owners, places = join(hashes, np.uint64), join(owners, np.int32), join(places, np.int32)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners, self.places = hashes[order], owners[order], places[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.hashes >> np.uint64(64 - TABLE_BITS)] = True
        self.passage = np.array([min(rule.least, len(s)) for _, s in self.segments], np.int64)
        self.need = np.array([self.needed(n) for n in self.passage.tolist()], np.int64)
        self.slack = np.array([rule.budget(n) + rule.run(n) for n in self.passage.tolist()], np.int64)
        self.least = int(self.need.min()) if len(self.need) else 1
        self.reach = max([int((self.passage + self.slack).max()) if len(self.need) else 1, *self.short])

    def needed(self, n: int) -> int:
        """Shared q-grams of a passage of length n and a region that holds it."""
        return max(1, n - 2 * self.rule.q + 2 - self.rule.run(n) - self.rule.q * self.rule.budget(n))

    def whole(self, codes: np.ndarray, places: np.ndarray, bounds: np.ndarray, inner: list[tuple[bool, bool]]) -> list[tuple[int, int, int, int, int]]:
        """(document, item, start, end, 0) of items below the shortest length that stand in a document exactly, as whole words; the first region of each.

        ``inner``: whether a document goes on before its first and after its last
        position here.  What touches such an end is left to the piece that holds both sides.
        """
        out = []
        for n, items in self.short.items():
            grams = qgrams(codes, n)
            at = np.flatnonzero(np.isin(grams, np.array(list(items), np.uint64)))
            document = np.searchsorted(bounds, at, "right") - 1
            seen = set()
            for p, d in zip(at.tolist(), document.tolist()):
                last = p + n - 1
                if last >= bounds[d + 1] or (p == bounds[d] and inner[d][0]) or (last + 1 == bounds[d + 1] and inner[d][1]):
                    continue
                if (p > bounds[d] and places[p - 1] + 1 == places[p]) or (last + 1 < bounds[d + 1] and places[last] + 1 == places[last + 1]):
                    continue
                for item, mine in items[int(grams[p])]:
                    if (d, item) not in seen and (codes[p : p + n] == mine).all():
                        seen.add((d, item))
                        out.append((d, item, p, p + n, 0))
        return out

    def regions(self, codes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, start, end, edits) for documents [bounds[i], bounds[i+1]) of ``codes``, in its positions.

        Every item of which a document holds a passage is reported; of its regions
        that begin within half a passage of each other, one.
        """
        grams = qgrams(codes, self.rule.q)
        if not len(grams) or not len(self.hashes):
            return []
        maybe = np.flatnonzero(self.table[grams >> np.uint64(64 - TABLE_BITS)])
        if len(maybe) < self.least:
            return []
        # a region holds at least `least` hits within `reach` positions: look the others up no further
        close = np.zeros(len(maybe), bool)
        span = maybe[self.least - 1 :] - maybe[: len(maybe) - self.least + 1]
        tight = np.flatnonzero(span <= self.reach)
        marks = np.zeros(len(maybe) + 1, np.int64)
        np.add.at(marks, tight, 1)
        np.add.at(marks, tight + self.least, -1)
        close = np.cumsum(marks[:-1]) > 0
        maybe = maybe[close]
        lo, hi = np.searchsorted(self.hashes, grams[maybe], "left"), np.searchsorted(self.hashes, grams[maybe], "right")
        count = hi - lo
        if not count.sum():
            return []
        at = np.repeat(maybe, count)
        entry = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        document = np.searchsorted(bounds, at, "right") - 1
        inside = at + self.rule.q <= bounds[document + 1]
        at, entry, document = at[inside], entry[inside], document[inside]
        owner, place = self.owners[entry].astype(np.int64), self.places[entry].astype(np.int64)
        diagonal = at - place
        band = diagonal // (self.slack[owner] + 1)
        # bands are two widths wide and overlap by one: a hit lies in two of them
        if not len(band):
            return []
        band -= band.min() - 1
        most = int(band.max()) + 1
        key = (document * len(self.segments) + owner) * most + band
        # bands with fewer hits than their passage needs are dropped before the hits are sorted by place
        key, place = np.concatenate([key - 1, key]), np.tile(place, 2)
        lowest = np.tile(diagonal // (self.slack[owner] + 1) - band, 2)
        order = np.argsort(key, kind="stable")
        key, place, lowest = key[order], place[order], lowest[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        size = np.diff(np.append(first, len(key)))
        enough = np.repeat(size >= self.need[key[first] // most % len(self.segments)], size)
        key, place, lowest = key[enough], place[enough], lowest[enough]
        order = np.lexsort((place, key))
        key, place, lowest = key[order], place[order], lowest[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])]) if len(key) else np.zeros(0, bool)
        key, lowest = key[new], lowest[new]
        rows = np.stack([key // most // len(self.segments), key // most % len(self.segments), key % most + lowest, place[new]], 1)
        if not len(rows):
            return []
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        place, need, gram_span = rows[:, 3], self.need[rows[:, 1]], self.passage[rows[:, 1]] - self.rule.q
        last = np.arange(len(rows)) + need - 1
        there = np.minimum(last, len(rows) - 1)
        full = np.flatnonzero((last < len(rows)) & (group[there] == group) & (place[there] - place <= gram_span))
        out, taken = [], defaultdict(list)
        for part in np.split(full, np.flatnonzero(np.diff(group[full])) + 1) if len(full) else []:
            d, o, y = rows[part[0], :3].tolist()
            item, text = self.segments[o]
            n, slack = int(self.passage[o]), int(self.slack[o])
            # passages that hold the needed q-grams: from the last place minus the span to the first place
            starts = np.zeros(len(text) - n + 2, np.int64)
            np.add.at(starts, np.maximum(0, place[there[part]] - int(gram_span[part[0]])), 1)
            np.add.at(starts, np.minimum(place[part], len(text) - n) + 1, -1)
            starts = np.flatnonzero(np.cumsum(starts) > 0)
            low = y * (slack + 1)
            high = low + 2 * (slack + 1) - 1
            known, size = taken[d, o], 1
            while len(starts):
                near = [s for s in starts[:size].tolist() if not any(low - n // 2 < r - s < high + n // 2 for r in known)]
                skip = starts[:size][-1] + 1
                if near:
                    begin, end = max(int(bounds[d]), low + near[0] - slack), min(int(bounds[d + 1]), high + near[-1] + n + slack)
                    found = hold(np.stack([text[s : s + n] for s in near]), codes[begin:end], self.rule.budget(n), self.rule.run(n)) if end > begin else None
                    if found is not None:
                        known.append(begin + found[1])
                        out.append((d, item, begin + found[1], begin + found[2], found[3]))
                        skip = near[found[0]] + max(1, n // 2)
                        size = 1
                    else:
                        size = max(1, n // 2)
                starts = starts[starts >= skip]
        return out


def _costs(pieces: np.ndarray, text: np.ndarray) -> np.ndarray:
    """[w, i, j]: fewest edits from the first i characters of piece w to a run of ``text`` that ends at j."""
    count, n = pieces.shape
    columns = np.arange(len(text) + 1, dtype=np.int16)
    out = np.zeros((count, n + 1, len(text) + 1), np.int16)
    for i in range(1, n + 1):
        best = out[:, i - 1] + np.int16(1)
        best[:, 1:] = np.minimum(best[:, 1:], out[:, i - 1, :-1] + (text[None, :] != pieces[:, i - 1, None]))
        out[:, i] = np.minimum.accumulate(best - columns, axis=1) + columns
    return out


def _start(cost: np.ndarray, piece: np.ndarray, text: np.ndarray, i: int, j: int) -> int:
    """Where the run of ``text`` begins that gave cost[i, j]."""
    while i:
        if j and cost[i, j] == cost[i - 1, j - 1] + (piece[i - 1] != text[j - 1]):
            i, j = i - 1, j - 1
        elif cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
    return j


def hold(pieces: np.ndarray, text: np.ndarray, k: int, run: int) -> tuple[int, int, int, int] | None:
    """(number, start, end, edits) of the first piece that ``text`` holds after k edits and one replaced run of at most ``run``, or None.

    ``edits`` counts a replaced run as its longer side.
    """
    n, m = pieces.shape[1], len(text)
    if m >= n and len(pieces) == 1:
        same = np.flatnonzero((np.lib.stride_tricks.sliding_window_view(text, n) == pieces[0]).all(1))
        if len(same):
            return 0, int(same[0]), int(same[0]) + n, 0
    ahead = _costs(pieces, text)
    fine = np.flatnonzero(ahead[:, n].min(1) <= k)
    if len(fine):
        w = int(fine[0])
        end = int(ahead[w, n].argmin())
        return w, _start(ahead[w], pieces[w], text, n, end), end, int(ahead[w, n, end])
    # a replaced run is at most `run` edits
    maybe = np.flatnonzero(ahead[:, n].min(1) <= k + run)
    if not len(maybe):
        return None
    ahead, pieces = ahead[maybe], pieces[maybe]
    back = _costs(pieces[:, ::-1], text[::-1])[:, ::-1, ::-1]
    rest = np.pad(back, ((0, 0), (0, run), (0, run)), constant_values=np.iinfo(np.int16).max // 2)
    rest = np.lib.stride_tricks.sliding_window_view(rest, run + 1, axis=1).min(-1)
    rest = np.lib.stride_tricks.sliding_window_view(rest, run + 1, axis=2).min(-1)
    total = ahead + rest
    fine = np.flatnonzero(total.min((1, 2)) <= k)
    if not len(fine):
        return None
    w = int(fine[0])
    i, j = (int(x) for x in np.unravel_index(total[w].argmin(), total[w].shape))
    corner = back[w, i : i + run + 1, j : j + run + 1]
    a, b = (int(x) for x in np.unravel_index(corner.argmin(), corner.shape))
    end = m - _start(back[w, ::-1, ::-1], pieces[w, ::-1], text[::-1], n - i - a, m - j - b)
    return int(maybe[w]), _start(ahead[w], pieces[w], text, i, j), end, int(total[w, i, j]) + max(a, b)


def align(piece: np.ndarray, text: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best region of ``text`` within ``k`` edits of ``piece``, or None.

    Only cells near the diagonals of the text's slack are computed, row by row.
    """
    n, m = len(piece), len(text)
    if m < n - k:
        return None
    if m >= n:
        windows = np.lib.stride_tricks.sliding_window_view(text, n)
        same = np.flatnonzero((windows == piece).all(1))
        if len(same):
            return int(same[0]), int(same[0]) + n, 0
    slack = m - n + k
    far = n + m
    columns = np.arange(m + 1)
    cost, origin = np.zeros(m + 1, np.int64), columns.copy()
    for i in range(1, n + 1):
        best = np.full(m + 1, far, np.int64)
        from_ = np.zeros(m + 1, np.int64)
        best[0], from_[0] = (i, 0) if i <= k else (far, 0)
        swap = cost[:-1] + (text != piece[i - 1])
        drop = cost[1:] + 1
        take = swap <= drop
        best[1:] = np.where(take, swap, drop)
        from_[1:] = np.where(take, origin[:-1], origin[1:])
        slide = best - columns
        least = np.minimum.accumulate(slide)
        source = np.maximum.accumulate(np.where(slide == least, columns, 0))
        best, from_ = least + columns, from_[source]
        outside = (columns < i - k) | (columns > i + slack)
        best[outside] = far
        cost, origin = best, from_
    end = int(np.argmin(cost))
    return (int(origin[end]), end, int(cost[end])) if cost[end] <= k else None


def _parts(text: str, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[bool, bool]]]:
    """Normalised pieces of a text and their positions, each with the ``reach`` characters before it; whether the text goes on before and after."""
    if len(text) <= PIECE:
        yield *normalise(text), (False, False)
        return
    carry, done, before = (np.zeros(0, np.uint32), np.zeros(0, np.int64)), 0, False
    for lo in range(0, len(text), PIECE):
        piece = text[lo : lo + PIECE]
        codes, at = normalise(piece)
        before = before or len(carry[0]) > reach
        carry = np.concatenate([carry[0][-reach:], codes]), np.concatenate([carry[1][-reach:], at + done])
        done += len(piece.lower())
        yield *carry, (before, lo + PIECE < len(text))


def _matches(search: Index, texts: list[str | None]) -> list[list[dict]]:
    """The regions of each text; start and end count characters of the lower-cased text."""
    found: list[list[dict]] = [[] for _ in texts]

    def scan(rows: list[int], parts: list[tuple[np.ndarray, np.ndarray, tuple[bool, bool]]]) -> None:
        bounds = np.concatenate([[0], np.cumsum([len(c) for c, _, _ in parts])])
        codes, places = np.concatenate([c for c, _, _ in parts]), np.concatenate([p for _, p, _ in parts])
        for d, item, start, end, edits in search.regions(codes, bounds) + search.whole(codes, places, bounds, [x for _, _, x in parts]):
            begin, near = int(places[start]), (end - start) // 2
            if not any(m["item_id"] == item and abs(m["start"] - begin) < near for m in found[rows[d]]):
                found[rows[d]].append({"item_id": item, "start": begin, "end": int(places[end - 1]) + 1, "edits": edits})

    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for part in _parts(text or "", 2 * search.reach):
            if rows and (size + len(part[0]) > PIECE or rows[-1] == i):
                scan(rows, parts)
                rows, parts, size = [], [], 0
            rows.append(i)
            parts.append(part)
            size += len(part[0])
    if rows:
        scan(rows, parts)
    return [sorted(x, key=lambda m: (m["start"], m["item_id"])) for x in found]


def _scan(index, text_at: int, name: str):
    """Batches with a last column of matches."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _matches(index.value, batch.column(text_at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, name])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rule: Rule = Rule(), matches_col: str = "matches") -> DataFrame:
    """``docs`` with an array of (item_id, start, end, edits) for regions that hold a passage of a benchmark item (``Rule``).

    The benchmark is read in slices of about SLICE characters.  With one slice its
    index is broadcast for one pass over the documents.  With more, each slice is
    a pass of its own that writes its few hits; hits are then joined to their rows.
    So memory is that of one slice however many items there are.

    Defined cases: a null or empty text has no matches (an empty array); items
    with fewer than ``rule.shortest`` letters and digits count where they stand
    exactly, as whole words; null items and items without letters or digits are
    not searched; a very long text is searched in overlapping pieces; repeated
    items are reported once for each item id; an empty table on either side gives
    no matches; ``docs`` keeps all its columns, but for one named as the output.
    """
    spark = docs.sparkSession
    docs = docs.drop(matches_col)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    slices = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // SLICE)
    if not slices:
        return docs.withColumn(matches_col, F.array().cast(MATCH))

    def index(i: int):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == i).orderBy("item", "text").collect()
        return spark.sparkContext.broadcast(Index(list(dict.fromkeys((r["item"], r["text"]) for r in part)), rule))

    match = T.StructField(matches_col, T._parse_datatype_string(MATCH))
    if slices == 1:
        return docs.mapInArrow(_scan(index(0), docs.columns.index(text_col), matches_col), T.StructType([*docs.schema.fields, match]))
    row = fresh(docs, "row")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    hits = None
    for i in range(slices):
        texts = numbered.select(row, text_col)
        found = texts.mapInArrow(_scan(index(i), 1, "found"), T.StructType([*texts.schema.fields, T.StructField("found", match.dataType)]))
        found = cut(found.filter(F.size("found") > 0).select(row, "found"), "hits")
        hits = found if hits is None else hits.union(found)
    hits = hits.groupBy(row).agg(F.array_sort(F.flatten(F.collect_list("found")), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["item_id"] < b["item_id"], -1).when(a["item_id"] > b["item_id"], 1).otherwise(0)).alias(matches_col))
    return numbered.join(hits, row, "left").select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(matches_col), F.array().cast(MATCH)).alias(matches_col))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a passage of a benchmark item."""
    name = fresh(docs, "matches")
    return find_contamination(docs, benchmark, matches_col=name, **options).filter(F.size(name) == 0).drop(name)
