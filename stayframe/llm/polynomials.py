"""Rabin-Karp hashes: polynomials of runs of values modulo 2^64, from prefix polynomials."""

from __future__ import annotations

import numpy as np

_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of an odd number modulo 2^64, remembered by the worker up to a few million."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if n <= 1 << 22:
            _POWERS[base] = known
    return known[:n]


def runs(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The polynomial in ``base`` (odd) of each run ``values[begin:end]``, by differences of the prefix polynomials."""
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=prefix[1:])
    back = _powers(pow(base, -1, 2**64), len(values) + 1)
    return (prefix[ends] - prefix[begins]) * back[begins]


def ragged(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``begin .. begin + length - 1`` of each run, one run after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(begins - (ends - lengths), lengths)


def unlike(a: np.ndarray, begins: np.ndarray, b: np.ndarray, others: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of ``a`` that differ from those of ``b`` in some value; all of a length above 0."""
    differ = a[ragged(begins, lengths)] != b[ragged(others, lengths)]
    return np.logical_or.reduceat(differ, np.cumsum(lengths) - lengths) if len(lengths) else np.zeros(0, bool)
