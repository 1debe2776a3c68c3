import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from common import ODD, empty, frame
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stayframe.llm import packing, piece_viterbi, simple8b, token_files, word_tokens
from stayframe.llm.word_tokens import WordEncoder
from stayframe.session import scratch_path

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "The", "B", "'s", " ", "  ", "\n", "\t", ",", ".", "1", "é", "́", "　", "<|endoftext|>", "中", "\x1c", "%", "_", "\0", "▁", "🙂"]
TEXT = st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join)


@pytest.fixture(scope="module", params=[BYTES, WORDS])
def words(request):
    return WordEncoder(request.param, remembered=2000)


def whole_ids(path, text, end):
    ids = np.frombuffer(WordEncoder(path).whole([text or ""])[0], "<u4")
    return np.append(ids, end).astype("<u4")


def test_words_equal_whole_texts(words):
    @settings(max_examples=300, deadline=None)
    @given(st.lists(TEXT, min_size=1, max_size=4))
    def check(texts):
        assert words.encode(texts) == words.whole(texts)

    check()
    texts = [t or "" for _, t, *_ in ODD]
    assert words.encode(texts) == words.whole(texts) == words.encode(texts)


def test_pieces_that_share_a_hash_are_not_mixed_up(monkeypatch):
    monkeypatch.setattr(word_tokens, "mix", lambda hashes: hashes % np.uint64(3))
    words = WordEncoder(WORDS)
    texts = ["some words, that differ.", "", "other words that differ", "a", "some more words"]
    for _ in range(2):
        assert words.encode(texts) == words.whole(texts)
        texts = texts[::-1]


def test_what_is_remembered_is_bounded():
    words = WordEncoder(WORDS, remembered=20_000)
    for n in range(40):
        texts = [" ".join(f"w{n * 50 + i}" for i in range(200))]
        assert words.encode(texts) == words.whole(texts)
        assert len(words._met) < 800


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 70))
def test_word_aligned_coding(values, unit):
    values = np.array(values, np.uint64)
    words, offsets, escapes = simple8b.encode(values, unit)
    assert (simple8b.decode(words, escapes) == values).all()
    for u in range(len(offsets) - 1):
        assert (simple8b.decode(words[offsets[u] : offsets[u + 1]], escapes) == values[u * unit : (u + 1) * unit]).all()


def test_words_take_as_many_as_fit():
    assert len(simple8b.encode(np.ones(600, np.uint64))[0]) == 10
    assert len(simple8b.encode(np.full(600, 2**20 - 1, np.uint64))[0]) == 200
    assert len(simple8b.encode(np.zeros(0, np.uint64))[0]) == 0


def test_token_files_of_odd_rows(spark):
    for partitions, block_ids in ((1, 10**6), (4, 7)):
        place = scratch_path(spark, "tokens")
        token_files.write_tokens(frame(spark), place, BYTES, 2, partitions=partitions, block_ids=block_ids)
        found = token_files.read_tokens(spark, place).orderBy("start").collect()
        assert [r["doc_id"] for r in found] == sorted((r[0] for r in ODD), key=lambda i: (i is not None, i))
        texts = {r[0]: r[1] for r in ODD}
        start = 0
        for r in found:
            ids = whole_ids(BYTES, texts[r["doc_id"]], 2)
            assert (r["start"], r["n_tokens"], r["ids"]) == (start, len(ids), ids.tolist())
            assert r["ids_crc32"] == zlib.crc32(ids.tobytes())
            start += len(ids)
    place = scratch_path(spark, "tokens")
    token_files.write_tokens(empty(spark), place, BYTES, 2)
    assert token_files.read_tokens(spark, place).collect() == []
    with pytest.raises(ValueError):
        list(token_files.read_blocks(b"\1" * 200))


def test_best_fit_takes_the_tightest_window():
    fit = packing.TightestFit(100)
    for capacity, window in ((50, 1), (30, 2), (100, 3), (30, 4)):
        fit.put(capacity, window)
    assert fit.take(31) == (1, 50) and fit.take(30)[1] == 30 and fit.take(1)[1] == 30
    assert fit.take(2) == (3, 100) and fit.take(1) is None
    rng = random.Random(5)
    lengths = [rng.randint(1, 64) for _ in range(400)]
    where, offset = packing.best_fit_decreasing(np.array(lengths), 64)
    free, expected = [], []
    for length in sorted(lengths, reverse=True):  # the same by looking at all windows
        fits = [c for c in free if c >= length]
        free.append(min(fits) - length if fits else 64 - length)
        if fits:
            free.remove(min(fits))
        else:
            expected.append(1)
    assert where.max() + 1 == len(expected)
    for w in range(where.max() + 1):
        at = np.flatnonzero(where == w)
        at = at[np.argsort(offset[at])]
        assert offset[at].tolist() == np.cumsum([0, *np.array(lengths)[at]])[:-1].tolist()
        assert np.array(lengths)[at].sum() <= 64


def test_packing_of_odd_rows(spark):
    place = scratch_path(spark, "pieces")
    packing.pieces(frame(spark), WORDS, 1, window=64, with_ids=True).write.parquet(place)
    packed = packing.pack(spark.read.parquet(place), window=64, group=5)
    rows = packed.collect()
    texts = {r[0]: r[1] for r in ODD}
    for i, text in texts.items():
        ids = whole_ids(WORDS, text, 1)
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        copies = 2 if i == 7 else 1
        assert sum(r["length"] for r in own) == copies * len(ids)
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids"] == part.tolist() and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids)
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    for r in packing.sequences(packed, 0, window=64).collect():
        used = sum(n for _, n in windows[r["sequence_id"]])
        assert r["used"] == used and len(r["ids"]) == (used if used & (used - 1) == 0 else 64)
    assert packing.pack_documents(empty(spark), WORDS, 1).collect() == []


def brute_pieces(text, scores, unknown):
    """Best way by trying all pieces at all places; longer last pieces first."""
    best = [(0.0, None)]
    for end in range(1, len(text) + 1):
        top = (float("-inf"), None)
        for begin in range(max(0, end - 20), end):
            if text[begin:end] in scores and best[begin][0] + scores[text[begin:end]] > top[0]:
                top = (best[begin][0] + scores[text[begin:end]], begin)
        if text[end - 1] not in scores and best[end - 1][0] + unknown > top[0]:
            top = (best[end - 1][0] + unknown, end - 1)
        best.append(top)
    return best[-1][0]


def test_viterbi_finds_the_best_way():
    rng = random.Random(6)
    pieces = {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 5))): -rng.random() * 9 for _ in range(80)}
    automaton = piece_viterbi.Automaton([(p, s, n) for n, (p, s) in enumerate(pieces.items())])
    single = frozenset(p for p in pieces if len(p) == 1)
    for _ in range(300):
        text = "".join(rng.choice("abc▁d") for _ in range(rng.randint(0, 30)))
        way, total, begin = automaton.best(text, single, -50.0), 0.0, 0
        for piece, end in way:
            total += automaton.score[piece] if piece >= 0 else -50.0
            assert piece < 0 or text[begin:end] in pieces
            begin = end
        assert begin == len(text) and total == pytest.approx(brute_pieces(text, pieces, -50.0) if text else 0.0)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_pieces_come_back(text):
    own = piece_viterbi.encoder(PIECES)
    ids = own.encode(text)
    assert own.decode(ids) == text
    assert ids == (own._escaped(" " + text) if text else b"")


def test_pieces_of_odd_rows(spark):
    coded = piece_viterbi.encode_documents(frame(spark), PIECES)
    texts = sorted(((r["doc_id"], r["text"]) for r in piece_viterbi.decode_documents(coded, PIECES).collect()), key=str)
    assert texts == sorted(((r[0], r[1] or "") for r in ODD), key=str)
    assert piece_viterbi.round_trips(empty(spark), PIECES).collect() == []
    assert piece_viterbi.round_trips(frame(spark), PIECES).where(F.col("doc_id") == 5).first()["n_tokens"] == 0
