"""Word-aligned coding of unsigned integers: a 4-bit selector and as many values as fit 60 bits.

Values are coded in units of ``UNIT`` values that start at a word of their own, so units decode
independently. A value of 60 bits or more is an escape: its word holds a place in a side list.
"""

from __future__ import annotations

import numpy as np

UNIT = 4096
# Values per word, by selector; each gets 60 // count bits.
COUNTS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
_PAD = 60
_WIDE = np.uint8(61)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits each value needs, 1 for zero and 61 for what needs more than 60."""
    high = (values >> np.uint64(32)).astype(np.float64)
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    bits = np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])
    return np.clip(bits, 1, 61).astype(np.uint8)


def encode(values: np.ndarray, unit: int = UNIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of each unit (and the end), escaped values.

    Each word takes the largest count that fits from where it stands. All units advance together,
    one word at a step.
    """
    values = np.ascontiguousarray(values, np.uint64)
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    units = -(-len(values) // unit)
    bits = np.full((units, unit + _PAD), 255, np.uint8)  # padding fits no word, so none crosses units
    lengths = np.full(units * unit, 255, np.uint8)
    lengths[: len(values)] = bit_lengths(values)
    bits[:, :unit] = lengths.reshape(units, unit)
    flat = bits.reshape(-1)
    most = {1: flat}
    for count in COUNTS[1:].tolist():
        # The largest of the next ``count`` lengths, from two shorter spans that overlap.
        half = max(c for c in most if c <= count and 2 * c >= count)
        shift, wide = count - half, most[half]
        most[count] = np.maximum(wide, np.concatenate([wide[shift:], np.full(shift, 255, np.uint8)]))
    choice = np.zeros(len(flat), np.uint8)
    for selector, count in enumerate(COUNTS.tolist()):
        choice[most[count] <= 60 // count] = selector
    choice[flat == _WIDE] = ESCAPE
    step = np.append(COUNTS, [1, 1])

    row = np.arange(units) * (unit + _PAD)
    end = row + np.minimum(unit, len(values) - np.arange(units) * unit)
    at, alive = row.copy(), np.arange(units)
    seen_at, seen_unit = [], []
    while len(alive):
        here = at[alive]
        seen_at.append(here)
        seen_unit.append(alive)
        at[alive] = here + step[choice[here]]
        alive = alive[at[alive] < end[alive]]
    place, owner = np.concatenate(seen_at), np.concatenate(seen_unit)
    order = np.argsort(owner, kind="stable")
    place, owner = place[order], owner[order]
    selector = choice[place]
    first = place - owner * _PAD  # index into the values
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector[selector != ESCAPE]).tolist():
        which = np.flatnonzero(selector == s)
        begin, width = first[which], 60 // int(COUNTS[s])
        packed = words[which]
        for j in range(int(COUNTS[s])):
            packed |= values[begin + j] << np.uint64(width * j)
        words[which] = packed
    escaped = np.flatnonzero(selector == ESCAPE)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    offsets = np.searchsorted(owner, np.arange(units + 1)).astype(np.int64)
    return words, offsets, values[first[escaped]]


def decode(words: np.ndarray, escapes: np.ndarray | None = None) -> np.ndarray:
    """All values of consecutive words; any unit may be decoded alone from its own words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = np.append(COUNTS, [1, 1])[selector]
    begin = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint64)
    for s in np.unique(selector).tolist():
        which = selector == s
        some, base = words[which], begin[which]
        if s == ESCAPE:
            out[base] = escapes[(some & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        width = 60 // int(COUNTS[s])
        mask = np.uint64((1 << width) - 1)
        for j in range(int(COUNTS[s])):
            out[base + j] = (some >> np.uint64(width * j)) & mask
    return out
