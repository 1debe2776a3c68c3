"""Text quality by positive-unlabelled learning.

Trusted good texts and unlabelled web texts are all that is learnt from. The share of good texts among
the unlabelled is estimated first: where a first classifier is surest, unlabelled texts are all good, so
the ratio of both kinds' shares there is the prior. Then a small network minimises the non-negative
unbiased risk ``prior * R(good as good) + max(0, R(unlabelled as bad) - prior * R(good as bad))``. All
of it is numpy: fitting on a bounded sample on the driver, scoring inside Spark tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stayframe.llm.labelled import sample_texts, with_scores
from stayframe.llm.shingles import text_parts, word_spans

MOST_GOOD = 3_000
MOST_UNLABELLED = 6_000
LONGEST = 20_000
HIDDEN = 24
EPOCHS = 40
# Bytes above 127 are counted in this many groups.
_HIGH = 16
FEATURES = 128 + _HIGH + 8

_GROUP = np.concatenate([np.arange(128), 128 + np.arange(128) * _HIGH // 128])
_UPPER = slice(65, 91)
_LETTER = [*range(65, 91), *range(97, 123), *range(128, 128 + _HIGH)]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text: root shares of bytes, and how its words repeat. An empty text has zeros."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    out = np.zeros((n, FEATURES), np.float32)
    width = 128 + _HIGH
    counts = np.zeros((n, width))
    for a in range(0, n, 256):  # some texts at a time, to bound the index
        lo, hi = int(offsets[a]), int(offsets[min(n, a + 256)])
        owner = np.repeat(np.arange(min(256, n - a)), sizes[a : a + 256])
        some = np.bincount(owner * width + _GROUP[data[lo:hi]], minlength=min(256, n - a) * width)
        counts[a : a + 256] = some.reshape(-1, width)
    share = counts / np.maximum(sizes, 1)[:, None]
    out[:, :width] = np.sqrt(share)
    words, begins, first = word_spans(data, offsets, True)
    many = np.diff(first)
    if len(words):
        owner = np.repeat(np.arange(n), many)
        some = np.maximum(many, 1)
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        ends = np.zeros(len(words), bool)  # ends with the same two bytes as the word before
        tail = np.minimum(np.append(begins[1:], offsets[-1]), offsets[owner + 1]) - 2
        tail = np.maximum(tail, begins)
        mark = data[tail].astype(np.int64) * 256 + data[np.minimum(tail + 1, len(data) - 1)]
        ends[1:] = (mark[1:] == mark[:-1]) & (owner[1:] == owner[:-1])
        order = np.lexsort((words, owner))
        fresh = np.ones(len(words), bool)
        fresh[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = np.bincount(owner[order][fresh], minlength=n)
        out[:, width] = np.bincount(owner, same, n) / some
        out[:, width + 1] = np.bincount(owner, ends, n) / some
        out[:, width + 2] = distinct / some
        out[:, width + 3] = np.log1p(many) / 10
        out[:, width + 4] = sizes / some / 10
    letters = counts[:, _LETTER].sum(1)
    out[:, width + 5] = letters / np.maximum(sizes, 1)
    out[:, width + 6] = counts[:, _UPPER].sum(1) / np.maximum(letters, 1)
    out[:, width + 7] = counts[:, 10] / np.maximum(many, 1)
    return out


def text_features(column: pa.Array) -> np.ndarray:
    out = np.zeros((len(column), FEATURES), np.float32)
    for begin, end, data, offsets in text_parts(column, 1_000_000):
        out[begin:end] = features(data, offsets)
    return out


@dataclass
class Model:
    """Scaling of the features, the network's weights, and the estimated prior."""

    centre: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(np.clip((x - self.centre) / self.spread, -8, 8) @ a + b) @ c + d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * self.margin(x).astype(np.float64)))


def _train(model: Model, good: np.ndarray, rest: np.ndarray, slope, epochs: int, seed: int, batch: int = 256) -> Model:
    """Adam steps; ``slope(m_good, m_rest)`` is the risk's derivative by the margins of a batch."""
    rng = np.random.default_rng(seed)
    moments, step = [(np.zeros_like(w), np.zeros_like(w)) for w in model.weights], 0

    def ready(x):
        return np.clip((x - model.centre) / model.spread, -8, 8)

    good, rest = ready(good), ready(rest)
    per = max(1, min(len(rest) // batch, 40))
    for epoch in range(epochs):
        for _ in range(per):
            g = good[rng.integers(0, len(good), batch)]
            u = rest[rng.integers(0, len(rest), batch)]
            x = np.concatenate([g, u])
            a, b, c, d = model.weights
            h = np.tanh(x @ a + b)
            m = h @ c + d[0]
            d_m = np.concatenate(slope(m[: len(g)], m[len(g) :]))
            d_h = d_m[:, None] * c * (1 - h**2)
            grads = [x.T @ d_h, d_h.sum(0), h.T @ d_m, np.array([d_m.sum()])]
            step += 1
            for w, grad, (one, two) in zip(model.weights, grads, moments, strict=True):
                grad = grad + 1e-4 * w
                one += 0.1 * (grad - one)
                two += 0.001 * (grad**2 - two)
                w -= 0.005 * (1 - epoch / epochs) * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    return model


def _new(x: np.ndarray, seed: int, prior: float = 0.5) -> Model:
    rng = np.random.default_rng(seed)
    weights = [rng.standard_normal((FEATURES, HIDDEN)) / np.sqrt(FEATURES), np.zeros(HIDDEN)]
    weights += [rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
    return Model(x.mean(0).astype(np.float64), x.std(0) + 1e-3, weights, prior)


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * m))


def estimate_prior(good: np.ndarray, rest: np.ndarray, seed: int = 1) -> float:
    """Share of good texts among the unlabelled, from features.

    A classifier of good against unlabelled is fitted on half of each. On the other half, the prior is
    the least ratio of shares above a threshold, unlabelled to good, with a margin for chance.
    """

    def slope(g, u):
        return -_sigmoid(-g) / len(g), _sigmoid(u) / len(u)

    model = _train(_new(np.concatenate([good, rest]), seed), good[::2], rest[::2], slope, 15, seed)
    g, u = np.sort(model.margin(good[1::2])), np.sort(model.margin(rest[1::2]))
    if not len(g) or not len(u):
        return 0.5
    cuts = g[: max(1, int(0.9 * len(g)))]  # at least a tenth of the good texts above
    above_g = 1 - np.searchsorted(g, cuts) / len(g)
    above_u = 1 - np.searchsorted(u, cuts) / len(u)
    chance = np.sqrt(0.25 / len(u)) + np.sqrt(0.25 / len(g))
    at = int(np.argmin((above_u + chance) / above_g))
    return float(np.clip(above_u[at] / above_g[at], 0.05, 0.98))


def fit(good: list[str], rest: list[str], *, prior: float | None = None, epochs: int = EPOCHS, seed: int = 1) -> Model:
    """Fit on trusted good texts and unlabelled ones; the prior is estimated unless given.

    Without any good texts every score is 0, without unlabelled ones every score is 1.
    """
    x, y = text_features(pa.array(good, pa.string())), text_features(pa.array(rest, pa.string()))
    if not len(x) or not len(y):
        model = _new(np.zeros((1, FEATURES)), seed)
        model.weights[2][:] = 0
        model.weights[3][:] = 40 if len(x) else -40
        return model
    prior = estimate_prior(x, y, seed) if prior is None else prior

    def slope(g, u):
        # Sigmoid loss: s(-m) for good, s(m) for bad; its derivative is -+ s(m) s(-m).
        bend_g, bend_u = _sigmoid(g) * _sigmoid(-g), _sigmoid(u) * _sigmoid(-u)
        bad = _sigmoid(u).mean() - prior * _sigmoid(g).mean()
        as_bad_g, as_bad_u = -prior * bend_g / len(g), bend_u / len(u)
        if bad < 0:  # more unlabelled texts called good than there are: step back
            return -as_bad_g, -as_bad_u
        return -prior * bend_g / len(g) + as_bad_g, as_bad_u

    return _train(_new(np.concatenate([x, y]), seed, prior), x, y, slope, epochs, seed)


def fit_labelled(
    docs: DataFrame, labels: DataFrame, usable: Column, *, most_good: int = MOST_GOOD,
    most_unlabelled: int = MOST_UNLABELLED, longest: int = LONGEST,
) -> Model:
    """Fit on bounded samples: texts that ``labels.quality`` calls good, and texts without regard to labels.

    Only rows that the condition ``usable`` admits are used, as good and as unlabelled ones.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(usable)
    good = sample_texts(rows, labels.where((F.col("quality") == 1) & usable), most_good, longest)
    return fit(good, sample_texts(rows, rows, most_unlabelled, longest))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with a score ``out`` between 0 and 1 for every row, null and empty texts too.

    A column of that name is replaced; all others stay, whatever their names.
    """
    return with_scores(docs, text, out, lambda column: model.score(text_features(column)))
