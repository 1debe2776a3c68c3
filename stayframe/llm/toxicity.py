"""Toxicity: a two-way gated recurrent network with attention pooling, over character and word inputs.

Texts are cut into overlapping windows of words, every window is scored, and a text's score is its
worst window's. All of it is numpy: fitting on a bounded sample of labelled rows on the driver,
scoring inside Spark tasks.

A word enters as a hashed word vector plus the mean of its hashed character-gram vectors, beside three
numbers taken from the sample: how much likelier toxic texts have the word, and the most and the mean
of that over its character grams. A longer run than ``MOST_BYTES``, as in writing without spaces, enters
as overlapping pieces, each a word of its own, so grams and windows go over all of its characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stayframe.llm.labelled import sample_texts, with_scores
from stayframe.llm.shingles import mix, text_parts, word_spans

WINDOW = 32
STRIDE = 16
HIDDEN = 8
VECTOR = 8
ATTEND = 8
# Hash slots of vectors, and of the sample's word and gram counts.
SLOTS = 1 << 12
COUNT_SLOTS = 1 << 18
GRAM = 4
# A run of word bytes over this is cut into pieces of PIECE bytes and up to three more, one every STEP bytes.
MOST_BYTES = 40
PIECE = 24
STEP = 12
# Words of a text that are read at once in scoring.
WORDS_AT_ONCE = 1 << 15
# The sample that the network is fitted on.
MOST_TOXIC = 1_500
MOST_CLEAN = 2_500
LONGEST = 12_000
FOLDS = 5
EPOCHS = 14

_PARTS_WORDS = np.ones(256, bool)  # all but letters, digits and the bytes of longer characters
_PARTS_WORDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


@dataclass
class Words:
    """Distinct words of some texts and each text's words in order."""

    hashes: np.ndarray  # of each distinct word
    gram_word: np.ndarray  # distinct word that owns each gram
    grams: np.ndarray  # hash of each gram
    order: np.ndarray  # distinct word at each place
    first: np.ndarray  # each text's first place, and the end


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    data, offsets = _cut_long_runs(data, offsets)
    hashes, begins, first = word_spans(data, offsets, True, _PARTS_WORDS)
    distinct, at, order = np.unique(hashes, return_index=True, return_inverse=True)
    begin = begins[at]
    end = _word_ends(data, begin, offsets)
    # Letters of the distinct words, each word after a mark of its own.
    lengths = end - begin + 1
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(distinct)), lengths)
    place = np.arange(int(lengths.sum())) - starts[owner]
    letters = np.full(len(owner), 1, np.uint64)
    inside = place > 0
    letters[inside] = _LOWER[data[(begin[owner] + place - 1)[inside]]]
    size = np.minimum(lengths, GRAM)
    counts = lengths - size + 1
    gram_word = np.repeat(np.arange(len(distinct)), counts)
    at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + starts[gram_word]
    grams = np.zeros(len(at), np.uint64)
    for j in range(GRAM):
        use = size[gram_word] > j
        grams[use] = grams[use] * np.uint64(257) + letters[at[use] + j]
    return Words(distinct, gram_word, mix(grams), order, first)


def _word_ends(data: np.ndarray, begin: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First parting byte or text end after each begin."""
    parts = np.flatnonzero(_PARTS_WORDS[data[offsets[0] : offsets[-1]]]) + offsets[0]
    parts = np.append(parts, offsets[-1])
    return np.minimum(parts[np.searchsorted(parts, begin)], offsets[np.searchsorted(offsets, begin, "right")])


def _cut_long_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with each run of over ``MOST_BYTES`` word bytes as pieces, a space between them.

    A piece begins and ends where a character does, and the next one begins before its end.
    """
    low, high = int(offsets[0]), int(offsets[-1])
    mark = _PARTS_WORDS[data[low:high]]
    mark[offsets[offsets < high] - low] = True
    edges = np.append(np.flatnonzero(mark) + low, high)
    # A run lies between edges; the edge before it is its parting byte, or its own first one at a text's begin.
    begin, end = edges[:-1] + _PARTS_WORDS[data[edges[:-1]]], edges[1:]
    long = end - begin > MOST_BYTES
    if not long.any():
        return data, offsets
    begin, end = begin[long], end[long]
    many = 1 + np.maximum(0, -(-(end - begin - PIECE) // STEP))
    owner = np.repeat(np.arange(len(begin)), many)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    piece = begin[owner] + step * STEP
    stop = np.minimum(piece + PIECE, end[owner])
    for _ in range(3):
        piece = piece + ((piece < end[owner]) & (step > 0) & (data[np.minimum(piece, high - 1)] >> 6 == 2))
        stop = stop + ((stop < end[owner]) & (data[np.minimum(stop, high - 1)] >> 6 == 2))
    # Stretches of the old bytes in their order, pieces among them, each piece but a run's last with a space after it.
    from_ = np.concatenate([piece, [low], end])
    to = np.concatenate([stop, begin, [high]])
    rank = np.concatenate([owner * 2 + 1, np.arange(len(begin) + 1) * 2])
    order = np.argsort(rank, kind="stable")
    space = np.concatenate([step + 1 < many[owner], np.zeros(len(begin) + 1, bool)])[order]
    lengths = (to - from_)[order]
    sizes = lengths + space
    starts = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) - np.repeat(starts - from_[order], sizes)
    out = data[np.minimum(at, high - 1)]
    out[(starts + lengths)[space]] = 32
    # No run crosses a text's end: what lies before an offset has grown by its runs' growth.
    pieces = np.bincount(owner, stop - piece + (step + 1 < many[owner]), len(begin)).astype(np.int64)
    grown = np.append(0, np.cumsum(pieces - (end - begin)))
    return out, offsets - low + grown[np.searchsorted(end, offsets, "right")]


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first place and length of each window; a text without words has one empty window."""
    counts = np.diff(first)
    many = 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE))
    owner = np.repeat(np.arange(len(counts)), many)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    begin = first[owner] + step * STRIDE
    return owner, begin, np.minimum(WINDOW, first[owner + 1] - begin)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters by name, scoring of windows, and the gradient of the loss."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        width, g = VECTOR + 3, 3 * HIDDEN

        def normal(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {
            "word": 0.1 * rng.standard_normal((SLOTS, VECTOR)).astype(np.float32),
            "gram": 0.1 * rng.standard_normal((SLOTS, VECTOR)).astype(np.float32),
            "in0": normal(width, g), "in1": normal(width, g), "b0": np.zeros(g, np.float32), "b1": np.zeros(g, np.float32),
            "re0": normal(HIDDEN, g), "re1": normal(HIDDEN, g),
            "att": normal(2 * HIDDEN, ATTEND), "att_b": np.zeros(ATTEND, np.float32), "att_v": normal(ATTEND),
            "out": normal(2 * HIDDEN), "out_b": np.full(1, -1, np.float32),
        }
        self.odds = {"word": np.zeros(COUNT_SLOTS, np.float32), "gram": np.zeros(COUNT_SLOTS, np.float32)}

    def inputs(self, words: Words, odds: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """One row per distinct word."""
        odds = odds or self.odds
        n, slot = len(words.hashes), _slots(words.hashes, SLOTS)
        grams = np.bincount(words.gram_word, minlength=n).astype(np.float32)
        out = np.zeros((max(n, 1), VECTOR + 3), np.float32)  # one row that padding may point at
        if n:
            begins = np.searchsorted(words.gram_word, np.arange(n))
            sums = np.add.reduceat(self.p["gram"][_slots(words.grams, SLOTS)], begins, axis=0)
            by_gram = odds["gram"][_slots(words.grams, COUNT_SLOTS)]
            out[:, :VECTOR] = self.p["word"][slot] + sums / grams[:, None]
            out[:, VECTOR] = odds["word"][_slots(words.hashes, COUNT_SLOTS)]
            out[:, VECTOR + 1] = np.maximum.reduceat(by_gram, begins)
            out[:, VECTOR + 2] = np.add.reduceat(by_gram, begins) / grams
        return out

    def forward(self, x: np.ndarray, places: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logit of each window. ``places`` index rows of ``x``; ``mask`` is 1 for real words."""
        p, (n, steps) = self.p, places.shape
        states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        cache = []
        full = bool(mask.all())
        for way in (0, 1):
            drive = x @ p[f"in{way}"] + p[f"b{way}"]
            back, h = p[f"re{way}"], np.zeros((n, HIDDEN), np.float32)
            part = slice(way * HIDDEN, (way + 1) * HIDDEN)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                a, u = drive[places[:, t]], h @ back
                gates = _sigmoid(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
                new = np.tanh(a[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                if keep:
                    cache.append((way, t, h, z, r, new, u[:, 2 * HIDDEN :]))
                h = new + z * (h - new)
                if not full:
                    h = h * mask[:, t : t + 1]
                states[t, :, part] = h
        hidden = np.tanh(states @ p["att"] + p["att_b"])
        score = hidden @ p["att_v"]
        score = np.where(mask.T > 0, score, np.float32(-1e9))
        weight = np.exp(score - score.max(0))
        weight *= mask.T
        weight /= np.maximum(weight.sum(0), np.float32(1e-9))
        pooled = (weight[:, :, None] * states).sum(0)
        logit = pooled @ p["out"] + p["out_b"][0]
        return (logit, (states, hidden, weight, pooled, cache)) if keep else logit

    def gradient(self, words: Words, places: np.ndarray, mask: np.ndarray, target: np.ndarray, each: np.ndarray, odds=None):
        """Weighted log loss and its gradient by every parameter."""
        p, x = self.p, self.inputs(words, odds)
        logit, (states, hidden, weight, pooled, cache) = self.forward(x, places, mask, keep=True)
        chance = _sigmoid(logit)
        loss = float(np.sum(each * (np.logaddexp(0, logit) - target * logit)))
        d_logit = each * (chance - target)
        g = {"out": pooled.T @ d_logit, "out_b": np.array([d_logit.sum()])}
        d_pooled = d_logit[:, None] * p["out"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = (states * d_pooled).sum(2)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        g["att_v"] = np.einsum("tn,tna->a", d_score, hidden)
        d_hidden = d_score[:, :, None] * p["att_v"] * (1 - hidden**2)
        g["att"] = np.einsum("tnh,tna->ha", states, d_hidden)
        g["att_b"] = d_hidden.sum((0, 1))
        d_states = d_states + d_hidden @ p["att"].T
        d_x = np.zeros_like(x)
        d_h = None
        for way in (0, 1):
            g[f"in{way}"], g[f"b{way}"], g[f"re{way}"] = (np.zeros_like(p[f"{k}{way}"]) for k in ("in", "b", "re"))
        last = None
        for way, t, h, z, r, new, u in reversed(cache):
            if way != last:
                d_h, last = np.zeros_like(h), way
            d = (d_h + d_states[t, :, way * HIDDEN : (way + 1) * HIDDEN]) * mask[:, t : t + 1]
            d_new = d * (1 - z) * (1 - new**2)
            d_z = d * (h - new) * z * (1 - z)
            d_r = d_new * u * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_new], axis=1)
            d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
            d_h = d * z + d_u @ p[f"re{way}"].T
            g[f"re{way}"] += h.T @ d_u
            g[f"in{way}"] += x[places[:, t]].T @ d_a
            g[f"b{way}"] += d_a.sum(0)
            np.add.at(d_x, places[:, t], d_a @ p[f"in{way}"].T)
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], _slots(words.hashes, SLOTS), d_x[:, :VECTOR])
        grams = np.bincount(words.gram_word, minlength=len(x)).astype(np.float32)
        share = (d_x[:, :VECTOR] / np.maximum(grams, 1)[:, None])[words.gram_word]
        np.add.at(g["gram"], _slots(words.grams, SLOTS), share)
        return loss, g

    def score_windows(self, x: np.ndarray, order: np.ndarray, begin: np.ndarray, length: np.ndarray, batch: int = 2048):
        """Logit of every window."""
        out = np.zeros(len(begin), np.float32)
        for a in range(0, len(begin), batch):
            places, mask = _places(order, begin[a : a + batch], length[a : a + batch])
            out[a : a + batch] = self.forward(x, places, mask)
        return out


def _places(order: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(WINDOW)
    mask = step < length[:, None]
    if not len(order):
        return np.zeros(mask.shape, np.int64), mask.astype(np.float32)
    return order[np.minimum(begin[:, None] + step, len(order) - 1)], mask.astype(np.float32)


class _Counts:
    """How many toxic and clean texts have each slot, for words and for grams."""

    def __init__(self):
        self.seen = {k: np.zeros((2, COUNT_SLOTS), np.int64) for k in ("word", "gram")}
        self.texts = np.zeros(2, np.int64)

    def add(self, words: Words, toxic: np.ndarray) -> None:
        n = max(1, len(words.hashes))
        owner = np.repeat(np.arange(len(toxic)), np.diff(words.first))
        pairs = np.unique(owner * n + words.order)
        text, word = pairs // n, pairs % n
        counts = np.bincount(words.gram_word, minlength=n)
        begins, each = np.cumsum(counts) - counts, counts[word]
        at = np.arange(int(each.sum())) + np.repeat(begins[word] - (np.cumsum(each) - each), each)
        slots = {
            "word": (text, _slots(words.hashes, COUNT_SLOTS)[word]),
            "gram": (np.repeat(text, each), _slots(words.grams, COUNT_SLOTS)[at]),
        }
        for kind, (text_of, slot) in slots.items():
            pairs = np.unique(text_of * COUNT_SLOTS + slot)
            for c in (0, 1):
                hit = pairs[toxic[pairs // COUNT_SLOTS] == bool(c)] % COUNT_SLOTS
                self.seen[kind][c] += np.bincount(hit, minlength=COUNT_SLOTS)
        self.texts += [int((~toxic).sum()), int(toxic.sum())]

    def odds(self, without: _Counts | None = None) -> dict[str, np.ndarray]:
        """Log ratio of how often toxic and clean texts have a slot, drawn towards 0 where there are few."""
        clean, toxic = self.texts - (without.texts if without else 0)
        ratio, out = max(1, clean) / max(1, toxic), {}
        for kind, seen in self.seen.items():
            rest, hits = seen - (without.seen[kind] if without else 0)
            out[kind] = np.log((hits + 1.5) * ratio / (rest + 1.5 * ratio)).astype(np.float32)
        return out


def _slots(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes % np.uint64(slots)).astype(np.int64)


@dataclass
class _Fold:
    """Texts whose odds are counted on the other folds, as they will be for texts outside the sample."""

    words: Words
    label: np.ndarray
    odds: dict[str, np.ndarray]
    owner: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    first_window: np.ndarray
    worst_by: np.ndarray


def _folds(texts: list[str], label: np.ndarray, net: Network) -> list[_Fold]:
    read, whole = [], _Counts()
    for f in range(min(FOLDS, len(texts))):
        raw = [t.encode() for t in texts[f::FOLDS]]
        words = read_words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        counts = _Counts()
        counts.add(words, label[f::FOLDS])
        for kind in whole.seen:
            whole.seen[kind] += counts.seen[kind]
        whole.texts += counts.texts
        read.append((words, label[f::FOLDS], counts))
    net.odds = whole.odds()
    out = []
    for words, own, counts in read:
        odds = whole.odds(counts)
        owner, begin, length = windows(words.first)
        top = net.inputs(words, odds)[words.order, VECTOR : VECTOR + 2].max(1)
        strength = np.append(0, np.cumsum(np.exp(np.minimum(2 * top, 8))))
        first = np.searchsorted(owner, np.arange(len(own) + 1))
        out.append(_Fold(words, own, odds, owner, begin, length, first, strength[begin + length] - strength[begin]))
    return out


def fit(toxic: list[str], clean: list[str], *, epochs: int = EPOCHS, seed: int = 3) -> Network:
    """Fit on whole texts of two classes; only a text's worst window and one other carry its label.

    The worst window is where the inputs' odds are highest at first, and later the one that the network
    finds worst. Without toxic texts every score is low; without clean ones every score is high.
    """
    net = Network(seed)
    if not toxic or not clean:
        net.p["out"][:] = 0
        net.p["out_b"][:] = 4 if toxic else -4
        return net
    rng = np.random.default_rng(seed)
    shuffled = rng.permutation(len(toxic) + len(clean))
    both = [*toxic, *clean]
    label = shuffled < len(toxic)
    folds = _folds([both[i] for i in shuffled], label, net)
    share = {True: len(both) / (2 * len(toxic)), False: len(both) / (2 * len(clean))}
    moments, step = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}, 0
    for epoch in range(epochs):
        batches = []
        for f in folds:
            if epoch >= 4 and epoch % 2 == 0:
                f.worst_by = net.score_windows(net.inputs(f.words, f.odds), f.words.order, f.begin, f.length)
            edges = list(zip(f.first_window[:-1].tolist(), f.first_window[1:].tolist(), strict=True))
            best = np.array([a + int(np.argmax(f.worst_by[a:b])) for a, b in edges])
            other = rng.integers(f.first_window[:-1], f.first_window[1:])
            chosen = np.concatenate([best, other[~f.label]])  # another window of a toxic text may be clean
            rng.shuffle(chosen)
            batches += [(f, chosen[a : a + 64]) for a in range(0, len(chosen), 64)]
        for b in rng.permutation(len(batches)).tolist():
            f, some = batches[b]
            places, mask = _places(f.words.order, f.begin[some], f.length[some])
            used, places = np.unique(places, return_inverse=True)
            target = f.label[f.owner[some]]
            weight = np.where(target, share[True], share[False]).astype(np.float32) / len(some)
            _, grads = net.gradient(
                _only(f.words, used), places.reshape(mask.shape), mask, target.astype(np.float32), weight, f.odds
            )
            step += 1
            now = 0.01 * (1 - epoch / epochs) + 1e-4
            for k, v in net.p.items():
                m, s = moments[k]
                grads[k] += 1e-4 * v
                m += 0.1 * (grads[k] - m)
                s += 0.001 * (grads[k] ** 2 - s)
                # Vectors of rare words learn slowly, or they would remember the sample.
                pace = now * (0.1 if k in ("word", "gram") else 1)
                v -= pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)
    return net


def _only(words: Words, used: np.ndarray) -> Words:
    """The distinct words that a batch uses, renumbered."""
    begins = np.searchsorted(words.gram_word, used)
    counts = np.searchsorted(words.gram_word, used, "right") - begins
    owner = np.repeat(np.arange(len(used)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owner]
    return Words(words.hashes[used], owner, words.grams[at], np.zeros(0, np.int64), np.zeros(1, np.int64))


def _stretches(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """First text and offsets of what is read at once: all texts, or stretches of a single long one.

    A stretch begins at a whole number of steps and ends where its last window does, so all windows
    of the text are those of its stretches.
    """
    if len(offsets) > 2 or offsets[-1] - offsets[0] <= WORDS_AT_ONCE:
        yield 0, offsets
        return
    inside = ~_PARTS_WORDS[data[offsets[0] : offsets[-1]]]
    begins = np.flatnonzero(inside & ~np.append(False, inside[:-1])) + offsets[0]
    for a in range(0, max(1, len(begins) - WINDOW + STRIDE), WORDS_AT_ONCE):
        b = a + WORDS_AT_ONCE + WINDOW - STRIDE
        yield 0, np.array([begins[a] if a else offsets[0], begins[b] if b < len(begins) else offsets[-1]])


def score_batch(net: Network, column: pa.Array) -> np.ndarray:
    """Score of each text of a column: the chance that its worst window is toxic."""
    out = np.zeros(len(column))
    for begin, end, data, offsets in text_parts(column, 500_000):
        data, offsets = _cut_long_runs(data, offsets)
        top = np.full(end - begin, -np.inf)
        for owner, part in _stretches(data, offsets):
            words = read_words(data, part)
            at_text, at, length = windows(words.first)
            logit = net.score_windows(net.inputs(words), words.order, at, length)
            found = np.maximum.reduceat(logit, np.searchsorted(at_text, np.arange(len(part) - 1)))
            top[owner : owner + len(found)] = np.maximum(top[owner : owner + len(found)], found)
        out[begin:end] = _sigmoid(top)
    return out


def fit_labelled(
    docs: DataFrame, labels: DataFrame, usable, *, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN,
    longest: int = LONGEST, epochs: int = EPOCHS,
) -> Network:
    """Fit on a bounded sample of ``docs`` that ``labels.toxic`` marks and the condition ``usable`` admits."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = labels.where(F.col("toxic").isNotNull() & usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic = sample_texts(rows, marked.where("toxic = 1"), most_toxic, longest)
    return fit(toxic, sample_texts(rows, marked.where("toxic = 0"), most_clean, longest), epochs=epochs)


def score(docs: DataFrame, net: Network, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a score ``out`` between 0 and 1 for every row, null and empty texts too.

    The network travels to the tasks once as a broadcast of fixed size. A column of that name is
    replaced; all other columns stay, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast((net.p, net.odds))

    def work(column: pa.Array) -> np.ndarray:
        own = Network()
        own.p, own.odds = shared.value
        return score_batch(own, column)

    return with_scores(docs, text, out, work)
