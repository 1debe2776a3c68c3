"""Word shingles of whole texts as 64-bit hashes, in numpy over the bytes of a whole batch.

A word is a run of bytes other than space, tab and line ends (0x20, 0x09-0x0D). These are single
bytes in UTF-8 and never part of another character, so bytes give the same words as code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DRAW = np.random.default_rng(20_001)
# Random values, not a table to match: any will do as long as all workers agree.
_VALUE = _DRAW.integers(0, 2**64, 256, np.uint64)
_PLACE = [_DRAW.integers(0, 2**64, 4096, np.uint64) | np.uint64(1)]
_PART = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(n: int) -> np.ndarray:
    """A random odd weight for each place in a word, the same ones in every worker."""
    while len(_PLACE[0]) < n:
        _PLACE[0] = np.concatenate([_PLACE[0], mix(_PLACE[0] + np.uint64(len(_PLACE[0]))) | np.uint64(1)])
    return _PLACE[0][:n]


def _hash_part(data: np.ndarray, breaks: np.ndarray, lower: bool, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and begin of each word; ``breaks`` are places where a new text begins."""
    inside = ~space[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[breaks[breaks < len(data)]] = False
    begins = np.flatnonzero(inside & ~before)
    if not len(begins):
        return np.zeros(0, np.uint64), begins
    letters = data[inside]
    # Place of each begin among the letters, so lengths follow.
    at = np.cumsum(inside)[begins] - 1
    lengths = np.diff(np.append(at, len(letters)))
    place = np.arange(len(letters)) - np.repeat(at, lengths)
    value = _VALUE[_LOWER[letters] if lower else letters]
    # Multiply-add over random odd weights, scrambled together with the length.
    sums = np.add.reduceat(mix(value + _places(int(lengths.max()))[place]), at)
    return mix(sums + lengths.astype(np.uint64)), begins


def word_spans(
    data: np.ndarray, offsets: np.ndarray, lower: bool, space: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and begins of all words of the texts ``data[offsets[i]:offsets[i + 1]]``, and each text's first word.

    ``space`` says for each byte if it parts words. Works through about a megabyte at a time, cut between words.
    """
    hashes, begins, a, end = [], [], int(offsets[0]), int(offsets[-1])
    while a < end:
        b = min(a + _PART, end)
        if b < end:
            gaps = np.flatnonzero(space[data[a:b]])
            if len(gaps):
                b = a + int(gaps[-1]) + 1
            else:
                more = np.flatnonzero(space[data[b:end]])
                b = b + int(more[0]) + 1 if len(more) else end
        lo, hi = np.searchsorted(offsets, [a, b])
        found, at = _hash_part(data[a:b], offsets[lo:hi] - a, lower, space)
        hashes.append(found)
        begins.append(at + a)
        a = b
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    at = np.concatenate(begins)
    return np.concatenate(hashes), at, np.searchsorted(at, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """``word_spans`` without the begins."""
    hashes, _, first = word_spans(data, offsets, lower)
    return hashes, first


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and each text's first; fewer words make one run of all.

    A text without words has none.
    """
    counts = np.diff(first)
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    ends = np.cumsum(many)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(first[:-1] - (ends - many), many)
    left = np.repeat(np.minimum(counts, size), many)
    sums = np.zeros(total, np.uint64)
    for j in range(size):
        use = left > j
        sums[use] = mix(sums[use] * np.uint64(0x9E3779B97F4A7C15) + words[at[use] + j])
    return mix(sums + left.astype(np.uint64)), np.append(0, ends)


def text_parts(column: pa.Array, most_bytes: int = 4_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``begin, end, data, offsets`` of runs of rows of a text column, each of about ``most_bytes``.

    ``data`` is the column's own buffer. A null row has no bytes.
    """
    if not len(column):
        return
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(column):
        end = int(np.searchsorted(offsets, offsets[begin] + most_bytes, "right")) - 1
        end = min(max(end, begin + 1), len(column))
        yield begin, end, data, offsets[begin : end + 1]
        begin = end


def text_shingles(column: pa.Array, size: int, lower: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each text of a column."""
    for begin, end, data, offsets in text_parts(column):
        words, first = word_hashes(data, offsets, lower)
        runs, starts = shingles(words, first, size)
        for i in range(end - begin):
            yield begin + i, np.unique(runs[starts[i] : starts[i + 1]])
