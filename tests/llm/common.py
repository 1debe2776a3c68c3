"""Small odd tables that every operator must take."""

import re

from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word salad with some more words, each line the same\n" * 4000
# Null and empty texts, a null id, white space, ties, repeated rows, a very long text, odd characters.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a", 72),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a", 72),
    (3, "The quick brown fox  jumps over the lazy dog near the old river bank today", None, "b", 73),
    (4, None, None, None, None),
    (5, "", "en", "b", 0),
    (6, " \t\n ", "en", "b", 4),
    (7, "two words", "en", None, 9),
    (7, "two words", "en", None, 9),
    (8, LONG, "en", "c", len(LONG)),
    (9, "naïve café — 日本語 ▁ \u0000 🙂 <|endoftext|>  end ", "fr", "c", 40),
    (None, "a text without a number of its own", "en", "c", 34),
    (10, "x" * 5000, "en", "c", 5000),
]


def frame(spark, rows=ODD):
    """``documents`` rows with more columns whose names operators might use themselves."""
    docs = spark.createDataFrame(rows, KIND)
    names = ["rep", "key", "size", "row", "score", "toxicity", "quality_score", "keep_id", "_hot", "first", "ids", "twin", "a.b"]
    return docs.withColumns({n: F.lit(1) for n in names})


def empty(spark):
    return frame(spark, ODD[:1]).where("doc_id < 0")


def shingles(text, size, lower=True):
    if lower:
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORD.findall(text or "")
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def components_of(texts, size, num, den):
    """Smallest linked id of each (id, text), by comparing all pairs."""
    sets, label = {i: shingles(t, size) for i, t in texts}, {i: i for i, _ in texts}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label
