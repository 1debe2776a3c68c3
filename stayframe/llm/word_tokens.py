"""Token ids of whole texts by the ``tokenizers`` library, one encoding per distinct word.

The pre-tokenizers of byte-level and word vocabularies never let a token cross certain places: before
a space that a visible character follows; around a line end with visible characters on both sides;
before a comma or full stop that follows a letter or digit. A text may be encoded piece by piece
between such places. Pieces repeat, so each worker remembers theirs: their bytes and ids lie in flat
arrays, found by a hash and compared in full, so that a batch of texts is looked up at once. A text for
which some rule is in doubt is cut at spaces only, or encoded in one go.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from stayframe.llm.polynomials import ragged, runs, unlike
from stayframe.llm.shingles import mix

# Bytes a worker spends on pieces it remembers; beyond that, those not met lately go.
REMEMBERED = 36_000_000
# Marks a piece that no space stands before.
_BARE = "\0"
# Each begins with what is searched for, so that the search is fast.
_UNSURE_SPACE = re.compile(r" \s")
_UNSURE_LINE = re.compile(r"\n(?:(?=\s)|(?<=\s\n))")
_UNSURE_STOP = re.compile(r"[.,](?<![^\W_][.,])")
_AT_ONCE = 400
# Random values, not a table to match.
_VALUE = np.random.default_rng(31).integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15


def cut(text: str) -> str | None:
    """The text with its pieces parted by spaces: each follows a space unless it bears the mark. None if it must stay whole."""
    if text[-1:] == " " or _BARE in text or _UNSURE_SPACE.search(text):
        return None
    if "\n" not in (text[:1], text[-1:]) and not _UNSURE_LINE.search(text):
        text = text.replace("\n", " \0\n \0")
    if not _UNSURE_STOP.search(text):
        text = text.replace(",", " \0,").replace(".", " \0.")
    return _BARE + text


class _Flat:
    """Values of many pieces, one piece after another."""

    def __init__(self, kind: str):
        self.values, self.begins, self.lengths = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        ends = np.cumsum(lengths) + len(self.values)
        self.begins = np.append(self.begins, ends - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.values = np.append(self.values, values.astype(self.values.dtype))

    def of(self, pieces: np.ndarray) -> np.ndarray:
        return self.values[ragged(self.begins[pieces], self.lengths[pieces])]

    def keep(self, pieces: np.ndarray) -> None:
        values, lengths = self.of(pieces), self.lengths[pieces]
        self.__init__(self.values.dtype.str)
        self.add(values, lengths)


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids; equal to encoding each text whole."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self._limit = remembered
        self._line = len(self.whole(["\n"])[0]) // 4
        self._hashes, self._piece = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._bytes, self._ids, self._met = _Flat("u1"), _Flat("<u4"), np.zeros(0, bool)

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        marked = [cut(t) for t in texts]
        counts = np.array([0 if m is None else m.count(" ") + 1 for m in marked])
        raw = " ".join(m for m in marked if m is not None).encode()
        pieces, doubtful = self._pieces(raw) if raw else (np.zeros(0, np.int64), np.zeros(0, bool))
        owner = np.repeat(np.arange(len(texts)), counts)
        odd = np.array([m is None for m in marked])
        odd[owner[doubtful]] = True
        whole = iter(self.whole([texts[i] for i in np.flatnonzero(odd).tolist()]))
        sizes = np.bincount(owner, weights=self._ids.lengths[pieces], minlength=len(texts)).astype(np.int64)
        ids, ends = self._ids.of(pieces).tobytes(), (4 * np.cumsum(sizes)).tolist()
        out = [next(whole) if o else ids[a:b] for o, a, b in zip(odd.tolist(), [0, *ends], ends)]
        self._forget()
        return out

    def _pieces(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The remembered piece of each piece of a marked text, and those that another one's hash hides."""
        data = np.frombuffer(raw, np.uint8)
        ends = np.append(np.flatnonzero(data == 32), len(data))
        begins = np.append(0, ends[:-1] + 1)
        lengths = ends - begins
        hashes = mix(runs(_VALUE[data], begins, ends, _BASE) + lengths.astype(np.uint64))
        found, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self._hashes, found)
        known = np.zeros(len(found), bool)
        inside = at < len(self._hashes)
        known[inside] = self._hashes[at[inside]] == found[inside]
        new = np.flatnonzero(~known)
        names = [raw[a:b].decode() for a, b in zip(begins[first[new]].tolist(), ends[first[new]].tolist())]
        number = np.empty(len(found), np.int64)
        number[known] = self._piece[at[known]]
        number[new] = len(self._bytes.lengths) + np.arange(len(new))
        self._learn(names)
        self._bytes.add(data[ragged(begins[first[new]], lengths[first[new]])], lengths[first[new]])
        self._hashes = np.insert(self._hashes, at[new], found[new])
        self._piece = np.insert(self._piece, at[new], number[new])
        self._met = np.append(self._met, np.ones(len(new), bool))
        self._met[number[known]] = True
        pieces = number[which]
        doubtful = self._bytes.lengths[pieces] != lengths
        same = np.flatnonzero(~doubtful)
        doubtful[same] = unlike(data, begins[same], self._bytes.values, self._bytes.begins[pieces[same]], lengths[same])
        return pieces, doubtful

    def _forget(self) -> None:
        """Beyond the limit, keep what was met since the last time, or every other piece of it if that is nearly all."""
        if self._bytes.values.nbytes + self._ids.values.nbytes + 50 * len(self._met) <= self._limit:
            return
        stay = np.flatnonzero(self._met)
        if len(stay) > 3 * len(self._met) // 4:
            stay = stay[::2]
        place = np.full(len(self._met), -1)
        place[stay] = np.arange(len(stay))
        left = place[self._piece] >= 0
        self._hashes, self._piece = self._hashes[left], place[self._piece[left]]
        self._bytes.keep(stay)
        self._ids.keep(stay)
        self._met = np.zeros(len(stay), bool)

    def _learn(self, names: list[str]) -> None:
        """Ids of new pieces, in their order."""
        spaced, bare, apart = [], [], []
        for i, word in enumerate(names):
            if word[:1] != _BARE:
                spaced.append(i)
            elif len(word) > 1 and not word[1].isspace():
                bare.append(i)
            else:
                apart.append(i)
        # After a line end, which is a token by itself or none at all, a piece is as at a text's start.
        made = [self._encode_joined([" " + names[i] for i in spaced], 0), self._encode_joined(["\n" + names[i][1:] for i in bare], self._line)]
        alone = [np.frombuffer(x, "<u4") for x in self.whole([names[i][1:] for i in apart])]
        made.append((np.concatenate([np.zeros(0, "<u4"), *alone]), np.array([len(x) for x in alone], np.int64)))
        values, lengths = (np.concatenate([m[c] for m in made]) for c in range(2))
        order = np.argsort(np.array([*spaced, *bare, *apart], np.int64))
        begins = np.cumsum(lengths) - lengths
        self._ids.add(values[ragged(begins[order], lengths[order])], lengths[order])

    def _encode_joined(self, pieces: list[str], skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and how many of each, from many pieces in one text; a token's place tells whose it is.

        ``skip`` ids of each are left out.
        """
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for a in range(0, len(pieces), _AT_ONCE):
            some = pieces[a : a + _AT_ONCE]
            encoding = self._tokenizer.encode("".join(some), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))
            # A token of white space alone is reported as an empty span at its end.
            at = np.array(encoding.offsets, np.int64).reshape(-1, 2)
            at = at[:, 0] - (at[:, 0] == at[:, 1])
            ids.append(np.array(encoding.ids, "<u4"))
            sizes.append(np.diff(np.searchsorted(at, ends), prepend=0))
        values, lengths = np.concatenate(ids), np.concatenate(sizes)
        begins = np.cumsum(lengths) - lengths
        return values[ragged(begins + skip, lengths - skip)] if skip else values, lengths - skip


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encode_column(path: str, column: pa.Array, most_chars: int = 750_000) -> Iterator[tuple[int, bytes]]:
    """(row, ids) of each text of a column without nulls, in parts so that memory follows ``most_chars``."""
    texts, held, begin = [], 0, 0
    for i, text in enumerate(column):
        texts.append(text.as_py())
        held += len(texts[-1])
        if held >= most_chars or i + 1 == len(column):
            yield from zip(range(begin, i + 1), encoder(path).encode(texts), strict=True)
            texts, held, begin = [], 0, i + 1
