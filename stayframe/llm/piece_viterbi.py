"""Encoding into scored pieces and back: an Aho-Corasick automaton drives a one-pass Viterbi search.

The automaton reads a text once. At each place it follows the output links of its state, which name
all pieces that end there, longest first, and relaxes the best score up to that place. A character that
no piece covers costs more than any piece and becomes its UTF-8 bytes' pieces, so every text can be
encoded and comes back exactly.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stayframe.llm.spread import text_or_empty

SPACE = "▁"  # how pieces write a space
# A character without a piece costs this much more than the worst piece.
PENALTY = 10.0
# Words a worker remembers in each of two generations, and transitions it has worked out.
REMEMBERED = 400_000
TRANSITIONS = 1_500_000
_BARE = "\0"  # before a part that no space stands before
_NONE = -1


class Automaton:
    """Pieces as a trie with failure and output links; transitions are worked out when first needed."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.fail, self.out, self.link = [0], [_NONE], [_NONE]
        self.size: list[int] = []
        self.score: list[float] = []
        self.ids: list[int] = []
        children: list[dict[str, int]] = [{}]
        for text, score, number in pieces:
            node = 0
            for c in text:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    self.fail.append(0)
                    self.out.append(_NONE)
                    self.link.append(_NONE)
                node = children[node][c]
            self.out[node] = len(self.ids)
            self.size.append(len(text))
            self.score.append(score)
            self.ids.append(number)
        self._tree = {(node << 21) | ord(c): child for node, row in enumerate(children) for c, child in row.items()}
        self._known: dict[int, int] = {}
        waiting = deque(children[0].values())
        while waiting:
            node = waiting.popleft()
            # ``link`` is the nearest state down the failure links where a piece ends.
            up = self.fail[node]
            self.link[node] = up if self.out[up] != _NONE else self.link[up]
            for c, child in children[node].items():
                self.fail[child] = self._move(up, ord(c)) if node else 0
                if self.fail[child] == child:
                    self.fail[child] = 0
                waiting.append(child)

    def _move(self, state: int, point: int) -> int:
        """Next state: along the trie, or from the nearest suffix that can go on."""
        found = self._tree.get((state << 21) | point)
        while found is None and state:
            state = self.fail[state]
            found = self._tree.get((state << 21) | point)
        return found or 0

    def best(self, text: str, covered: frozenset[str], unknown: float) -> list[tuple[int, int]]:
        """(piece, or -1 for a character without one; where it ends) along the best way through ``text``.

        Of equally good ways the one whose last piece is longer is taken, at every place.
        """
        known, out, link, size, score = self._known, self.out, self.link, self.size, self.score
        if len(known) > TRANSITIONS:
            known.clear()
        total = [0.0]
        came: list[int] = []
        state = 0
        for end, c in enumerate(text, 1):
            key = (state << 21) | ord(c)
            following = known.get(key)
            if following is None:
                following = known[key] = self._move(state, ord(c))
            state = following
            top, by = float("-inf"), _NONE
            at = state if out[state] != _NONE else link[state]
            while at != _NONE and out[at] != _NONE:
                piece = out[at]
                value = total[end - size[piece]] + score[piece]
                if value > top:
                    top, by = value, piece
                at = link[at]
            if c not in covered:
                value = total[end - 1] + unknown
                if value > top:
                    top, by = value, _NONE
            total.append(top)
            came.append(by)
        path, end = [], len(text)
        while end:
            piece = came[end - 1]
            path.append((piece, end))
            end -= size[piece] if piece != _NONE else 1
        return path[::-1]


class PieceEncoder:
    """Texts to piece ids and back, for one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: list[int], remembered: int = REMEMBERED):
        """``pieces``: text, score and id of each; ``byte_ids``: the piece of each byte value."""
        self._automaton = Automaton(pieces)
        self._covered = frozenset(p for p, _, _ in pieces if len(p) == 1)
        self._unknown = min((s for _, s, _ in pieces), default=0.0) - PENALTY
        self._bytes = byte_ids
        self._text = {number: p.replace(SPACE, " ").encode() for p, _, number in pieces}
        self._text |= {number: bytes([b]) for b, number in enumerate(byte_ids)}
        letters = frozenset(chain.from_iterable(p for p, _, _ in pieces))
        # Words part where no piece can cross: before a space after another character, and at line ends.
        self._by_word = not any(SPACE in p.lstrip(SPACE) for p, _, _ in pieces)
        self._by_line = "\n" not in letters
        self._limit = remembered
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Ids of a part in which spaces are already written as in pieces."""
        ids, begin = [], 0
        for piece, end in self._automaton.best(word, self._covered, self._unknown):
            if piece == _NONE:
                ids += [self._bytes[b] for b in word[begin:end].encode("utf-8", "replace")]
            else:
                ids.append(self._automaton.ids[piece])
            begin = end
        return np.array(ids, "<u4").tobytes()

    def _escaped(self, text: str) -> bytes:
        """Ids of a text as a whole. A character that looks like a written space goes as bytes."""
        parts, out = text.split(SPACE), []
        for i, part in enumerate(parts):
            if i:
                out.append(np.array([self._bytes[b] for b in SPACE.encode()], "<u4").tobytes())
            out.append(self._word(part.replace(" ", SPACE)))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids. A space is put before a text that is not empty."""
        if not text:
            return b""
        if not self._by_word or _BARE in text or SPACE in text:
            return self._escaped(" " + text)
        if self._by_line:
            text = text.replace("\n", " \0\n \0")
        parts = text.split(" ")
        if "" in parts:
            parts = _with_runs(parts)
        young, out = self._young, []
        for part in parts:
            ids = young.get(part)
            if ids is None:
                ids = self._old.get(part)
                if ids is None:
                    ids = self._word(part[1:] if part[:1] == _BARE else SPACE + part.replace(" ", SPACE))
                young[part] = ids
            out.append(ids)
        if len(young) > self._limit:
            self._old, self._young = {k: v for k, v in young.items() if len(k) < 48}, {}
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text that ``encode`` was given."""
        text = b"".join(map(self._text.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:]


def _with_runs(parts: list[str]) -> list[str]:
    """Parts of a text with spaces in a row: the spaces of a run belong to the part that follows it."""
    out, spaces = [], 0
    for part in parts:
        if not part:
            spaces += 1
        elif part[0] == _BARE and spaces:
            out += [" " * (spaces - 1), part]
            spaces = 0
        else:
            out.append(" " * spaces + part)
            spaces = 0
    return [*out, " " * (spaces - 1)] if spaces else out


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a ``sentencepiece`` model file with byte pieces."""
    if path not in _ENCODERS:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids = [], [0] * 256
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                byte_ids[int(model.id_to_piece(i)[3:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces.append((model.id_to_piece(i), model.get_score(i), i))
        _ENCODERS[path] = PieceEncoder(pieces, byte_ids)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, model: str, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, ids`` (array of int) of every row; a null or empty text has no ids. Extra columns are ignored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            coded = [own.encode(t.as_py()) for t in batch.column(1)]
            flat = pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32))
            ends = pa.array(np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "ids"])

    return _rows(docs, text, doc_id).mapInArrow(work, "doc_id bigint, ids array<int>")


def decode_documents(coded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``; null ids count as none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            texts = [own.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(work, "doc_id bigint, text string")


def round_trips(docs: DataFrame, model: str, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, decoded_sha256``: each text encoded, and the digest of what comes back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            sizes, sums, digests = [], [], []
            for value in batch.column(1):
                ids = own.encode(value.as_py())
                sizes.append(len(ids) // 4)
                sums.append(zlib.crc32(ids))
                digests.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            made = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256"])

    kind = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string"
    return _rows(docs, text, doc_id).mapInArrow(work, kind)


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), text_or_empty(docs, text).alias("text"))
