"""Reproducible pseudo-random numbers from keys.

Everything random in this library is a hash of a key and a seed, so a recomputed
task, a second run and another engine all draw the same values.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

HASH_BITS = 32
# Hashes worked out at once, and the constants of MD5.
_AT_ONCE = 1 << 15
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADDED = [int(x) for x in np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]


def key_draw(seed: int, *keys) -> Column:
    """Uniform integer in [0, 2**32) from the seed and the key columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def draw_text(seed: int, *keys) -> Column:
    """What ``key_draws`` hashes: the seed and the key columns."""
    return F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]).cast("binary")


def key_draws(texts: pa.Array, n: int) -> np.ndarray:
    """``key_draw`` of each ``draw_text`` and a last key 1, 2 ... n, one row for each text; in numpy, for all texts of a length at once."""
    out = np.zeros((len(texts), n), np.int64)
    tails = [b"|%d" % k for k in range(1, n + 1)]
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)) if len(texts) else np.zeros(0, int)
    for size in np.unique(sizes).tolist() if n else []:
        rows = np.flatnonzero(sizes == size)
        step = max(1, _AT_ONCE // n)
        for a in range(0, len(rows), step):
            some = rows[a : a + step]
            keys = texts.take(pa.array(some)).to_pylist()
            if size + len(tails[-1]) > 55:
                out[some] = [[int.from_bytes(hashlib.md5(key + tail, usedforsecurity=False).digest()[:4]) for tail in tails] for key in keys]
            else:
                out[some] = _md5_heads(b"".join(keys), len(keys), size, tails)
    return out


def _md5_heads(keys: bytes, many: int, size: int, tails: list[bytes]) -> np.ndarray:
    """First four bytes of the MD5 of each key of ``size`` bytes with each tail, as a number; no text fills its 64 bytes."""
    head, ends = np.zeros((many, 64), np.uint8), np.zeros((len(tails), 64), np.uint8)
    head[:, :size] = np.frombuffer(keys, np.uint8).reshape(many, size)
    for row, tail in zip(ends, tails):
        row[size : size + len(tail) + 1] = np.frombuffer(tail + b"\x80", np.uint8)
        row[56:58] = np.frombuffer((8 * (size + len(tail))).to_bytes(2, "little"), np.uint8)
    first, last = np.ascontiguousarray(head.view("<u4").T), np.ascontiguousarray(ends.view("<u4").T)
    a, b, c, d = (np.full((many, len(tails)), x, np.uint32) for x in _START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        # Key and tail share no byte, so a word is their sum.
        f += last[g] + np.uint32(_ADDED[i])
        if 4 * g < size:
            f += first[g][:, None]
        turned = f << np.uint32(_TURNS[i])
        f >>= np.uint32(32 - _TURNS[i])
        turned |= f
        turned += b
        a, d, c, b = d, c, b, turned
    return (a + np.uint32(_START[0])).byteswap().astype(np.int64)


def draw_chunk(draw: Column, bits: int = 12) -> Column:
    """Leading bits of a draw: equal slices of the hash order."""
    return F.shiftright(draw, HASH_BITS - bits)


def row_id(*keys) -> Column:
    """Stable id of a row from its key alone: a 128-bit digest, so that different keys keep different ids.

    Each part is entered with its length and nulls with a mark of their own, so ('a', 'bc'), ('ab', 'c')
    and ('a', null) differ.
    """
    parts = []
    for k in keys:
        text = (F.col(k) if isinstance(k, str) else k).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.md5(F.concat_ws("|", *parts))
