"""Word hashes of whole texts, by array operations over Arrow's text buffers.

Used inside ``mapInArrow`` tasks.  Memory is bounded by ``PIECE`` bytes of text
at a time (a longer document is cut between words), so neither a batch nor a
very long document decides what a task needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Bytes between words: the six ASCII white-space characters.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Bytes between words when punctuation is none of the word: all but ASCII letters, digits and bytes of longer characters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, PIECE + 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: near inputs give unrelated outputs."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a text column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def word_hashes(data: np.ndarray, bounds: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data`` and how many each document [bounds[i], bounds[i+1]) has."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
    inside = ~between[data]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n)[:n], out=total[1:])
    words = mix((total[ends] - total[starts]) * _power(_INVERSE, n)[starts])
    return words, np.diff(np.searchsorted(starts, bounds))


def _cuts(texts: pa.Array, between: np.ndarray, fold: np.ndarray, most: int | None, overlap: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool, bool, bool]]:
    """What :func:`pieces` yields, and whether the piece starts and ends inside a word."""
    data, offsets = buffers(texts)
    rows, at = len(offsets) - 1, 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        to = min(to, at + most) if most else to
        lo, hi = int(offsets[at]), int(offsets[to])
        inside = False
        while True:
            end, split = hi, False
            if hi - lo > PIECE:
                end = lo + PIECE
                gaps = np.flatnonzero(between[fold[data[lo:end]]])
                while not len(gaps) and end < hi and overlap is None:  # a word longer than a piece
                    gaps = np.flatnonzero(between[fold[data[end : min(hi, end + PIECE)]]]) + (end - lo)
                    end = min(hi, end + PIECE)
                split = not len(gaps) and end < hi
                end = lo + int(gaps[-1]) + 1 if len(gaps) else end
            yield at, fold[data[lo:end]], (offsets[at : to + 1] - lo if end - lo == offsets[to] - offsets[at] else np.array([0, end - lo])), end == hi, inside, split
            if end >= hi:
                break
            lo, inside = end - (overlap if split else 0), split
        at = to


def pieces(texts: pa.Array, between: np.ndarray, fold: np.ndarray, most: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """Yield (first row, folded bytes, bounds of its rows, whether the last row is complete), in order.

    A row longer than PIECE comes alone, in several pieces cut after a byte of
    ``between``; only its last piece is complete, and a word is never cut.  ``most``
    bounds the rows of a piece.
    """
    for piece in _cuts(texts, between, fold, most, None):
        yield piece[:4]


def gram_pieces(texts: pa.Array, between: np.ndarray, fold: np.ndarray, widths: tuple[int, ...], most: int | None = None) -> Iterator[tuple[int, int, bool, list[tuple[np.ndarray, np.ndarray]]]]:
    """Yield (first row, rows, whether the last row is complete, for each width the row and the hash of every byte n-gram).

    No piece is longer than PIECE: a word that is (a text in a script without
    spaces, say) is cut inside, and the next piece starts so much earlier that every
    n-gram is seen once.
    """
    overlap = max(widths) - 1
    for at, data, bounds, whole, inside, split in _cuts(texts, between, fold, most, overlap):
        text, row = spaced(data, bounds, between)
        text, row = text[int(inside) : len(text) - int(split)], row[int(inside) : len(row) - int(split)]
        found = []
        for n in widths:
            place, hashes = byte_grams(text, n)
            new = place >= overlap - (n - 1) if inside else slice(None)
            found.append((row[place[new]], hashes[new]))
        yield at, len(bounds) - 1, whole, found


def words(texts: pa.Array, between: np.ndarray = SPACE, fold: np.ndarray = LOWER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, hashes, words per row) for runs of rows, in order."""
    parts = []
    for at, data, bounds, whole in pieces(texts, between, fold):
        found, counts = word_hashes(data, bounds, between)
        parts.append(found)
        if whole:
            if len(parts) > 1:
                found = np.concatenate(parts)
                counts = np.array([len(found)])
            yield at, found, counts
            parts = []


def spaced(data: np.ndarray, bounds: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with each of ``between`` as one space and a space before every row and at the end, and the row of each byte."""
    lengths = np.diff(bounds)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out = np.full(len(data) + len(lengths) + 1, 32, np.uint8)
    out[np.arange(len(data)) + row + 1] = np.where(between[data], 32, data)
    return out, np.append(np.repeat(np.arange(len(lengths)), lengths + 1), len(lengths) - 1)


def byte_grams(text: np.ndarray, n: int, leading: bool = True, trailing: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of byte n-grams that lie in one word, with at most a space before or after it."""
    m = len(text) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = np.concatenate([[0], np.cumsum(text == 32)])
    ok = space[n - 1 : n - 1 + m] == space[1 : 1 + m]
    if not leading:
        ok &= text[:m] != 32
    if not trailing:
        ok &= text[n - 1 :] != 32
    ok &= (text[:m] != 32) | (text[n - 1 :] != 32)
    at = np.flatnonzero(ok)
    total = np.zeros(len(at), np.uint64)
    for i in range(n):
        total = total * np.uint64(257) + text[at + i].astype(np.uint64) + np.uint64(1)
    return at, mix(total, n)


def shingles(found: np.ndarray, counts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each document, its distinct hashed shingles of ``width`` words, ascending.

    A document of 1 to width - 1 words has one shingle, its whole sequence.
    """
    n, joined = len(found), np.zeros(0, np.uint64)
    weights = [np.uint64(int(mix(np.array([i], np.uint64), 77)[0]) | 1) for i in range(width)]
    if n >= width:
        joined = np.zeros(n - width + 1, np.uint64)
        for i, weight in enumerate(weights):
            joined += found[i : n - width + 1 + i] * weight
        joined = mix(joined, width)
    at = 0
    for count in counts.tolist():
        if count >= width:
            yield np.unique(joined[at : at + count - width + 1])
        elif count:
            total = np.zeros(1, np.uint64)
            for i in range(count):
                total += found[at + i : at + i + 1] * weights[i]
            yield mix(total, 1000 + count)
        else:
            yield np.zeros(0, np.uint64)
        at += count


def digest(values: np.ndarray) -> bytes:
    """128 bits of a set of hashes."""
    return np.array([mix(values, 5).sum(), mix(values, 6).sum() + np.uint64(len(values))], np.uint64).tobytes()
