"""Phrase collocations: Rabin-Karp fingerprints of all runs of words, counted level by level.

Texts are read once into streams of word symbols. Prefix polynomials over a stream give the fingerprint of
every run of words in a few vector operations. Level by level (one word, two, ...) tasks count fingerprints,
a shuffle sums them, and those seen often enough go on: a longer run is counted only if both runs of one
word less passed. What passed reaches the tasks as a bit set of bounded size. It may let other runs
through, never hold a frequent one back.

Equal fingerprints are only a guess that words are equal. In a last reading of the texts, tasks point to the
first occurrence of every fingerprint that passed, compare all others with the text there, and write a
phrase out once for each text it really has. Counts and pointers are then merged by phrase, so all counts
are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from stayframe.llm.polynomials import runs, unlike
from stayframe.llm.shingles import mix, text_parts
from stayframe.llm.spread import spread_lookup
from stayframe.operators.topn import first_rows
from stayframe.session import scratch_path

MOST_WORDS = 5
LEAST = 100
TOP = 2_000
NO_LANG = "und"

_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_PARTS = _BREAKS.copy()
_PARTS[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DRAW = np.random.default_rng(4_711)
# Random values, not a table to match: any will do as long as all workers agree.
_VALUE = _DRAW.integers(0, 2**64, 256, np.uint64)[_LOWER]
_BYTE_BASE, _WORD_BASE, _SIZE = (int(x) | 1 for x in _DRAW.integers(0, 2**63, 3))

# Bytes of text worked on at once, and fingerprints counted at once.
_AT_ONCE = 1_000_000
_COUNTED = 2_000_000
# Bits of a filter: so many for each key, rounded up to a power of two, 16 megabytes at most.
_BITS_A_KEY = 32
_LEAST_BITS, MOST_BITS = 16, 27

@dataclass
class Words:
    """Words of some texts in order; the first ``seen`` were given out before and only lead up to the others."""

    hashes: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    piece: np.ndarray
    seen: int = 0

    def last(self, n: int) -> Words:
        return Words(*(x[len(x) - n :] for x in (self.hashes, self.begins, self.ends, self.text, self.piece)), n)

    def after(self, other: Words) -> Words:
        """These words, led up to by the last words of a piece that goes on here."""
        pairs = [(other.hashes, self.hashes), (other.begins, self.begins), (other.ends, self.ends), (other.text, self.text)]
        goes_on = np.full(other.seen, self.piece[0] if len(self.piece) else 0)
        return Words(*map(np.concatenate, pairs), np.append(goes_on, self.piece), other.seen)


def words_of(data: np.ndarray, offsets: np.ndarray, most_words: int = MOST_WORDS, at_once: int = _AT_ONCE) -> Iterator[Words]:
    """The words of the texts ``data[offsets[i]:offsets[i + 1]]``, about a megabyte of them at a time.

    Begins and ends are places in ``data``. A word ends with its text. Where a piece goes on from one
    part to the next, its last ``most_words - 1`` words are there again.
    """
    a, stop, carried = int(offsets[0]), int(offsets[-1]), None
    while a < stop:
        b = min(a + at_once, stop)
        while b < stop and not _PARTS[data[b - 1]]:
            gaps = np.flatnonzero(_PARTS[data[b : b + at_once]])
            b = b + int(gaps[0]) + 1 if len(gaps) else min(b + at_once, stop)
        part, inside = data[a:b], np.zeros(b - a + 2, bool)
        np.logical_not(_PARTS[part], out=inside[1:-1])
        begins = np.flatnonzero(inside[1:-1] & ~inside[:-2])
        ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        lo, hi = np.searchsorted(offsets, [a, b])
        starts = np.unique(offsets[lo:hi] - a)
        starts = starts[starts > 0]
        glued = starts[inside[starts] & inside[starts + 1]]
        if len(glued):
            begins, ends = np.sort(np.append(begins, glued)), np.sort(np.append(ends, glued))
        hashes = mix(runs(_VALUE[part], begins, ends, _BYTE_BASE) + (ends - begins).astype(np.uint64))
        # Places that a piece does not go over.
        places = np.sort(np.append(np.flatnonzero(_BREAKS[part]) + 1, starts))
        piece = np.searchsorted(places, begins, "right")
        found = Words(hashes, begins + a, ends + a, np.searchsorted(offsets, begins + a, "right") - 1, piece)
        own = len(begins)
        if carried is not None:
            fresh = own and piece[0] > 0
            found = found if fresh else found.after(carried)
        begins_text = offsets[min(int(np.searchsorted(offsets, b)), len(offsets) - 1)] == b
        open_ = bool(len(found.piece)) and found.piece[-1] == len(places) and not begins_text
        if open_:
            same = int(np.count_nonzero(found.piece == found.piece[-1]))
            carried = found.last(min(same, most_words - 1))
        else:
            carried = None
        if own:
            yield found
        a = b


def seeds(langs: list[str]) -> np.ndarray:
    """A number for each language, part of all its fingerprints."""
    raw = [lang.encode("utf-8", "surrogatepass") for lang in langs]
    ends = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    return mix(runs(mix(data.astype(np.uint64) + np.uint64(1)), ends[:-1], ends[1:], _WORD_BASE) + np.diff(ends).astype(np.uint64))


def by_lang(words: Words, langs: list[str]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """``lang, seen, symbols, words``: 32 bits of the hash of each of a language's words, and a 0 before each piece.

    ``words`` has the word of each symbol, -1 for a 0.
    """
    symbols = (words.hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    codes = {lang: c for c, lang in enumerate(dict.fromkeys(langs))}
    code = np.array([codes[lang] for lang in langs])[words.text]
    new = np.append(True, (words.piece[1:] != words.piece[:-1]) | (words.text[1:] != words.text[:-1]))
    for lang, c in codes.items():
        own = np.flatnonzero(code == c)
        if len(own):
            at = np.arange(len(own)) + np.cumsum(new[own])
            out, which = np.zeros(int(at[-1]) + 1, np.uint32), np.full(int(at[-1]) + 1, -1)
            out[at], which[at] = symbols[own], own
            # What leads up is at the very front, after the first 0.
            yield lang, words.seen + 1 if words.seen and own[0] == 0 else 0, out, which


def _batches_of_words(batch: pa.RecordBatch, most_words: int) -> Iterator[tuple[int, np.ndarray, list[str], Words]]:
    """First row, bytes, languages and words of runs of rows of ``lang, text``."""
    langs = batch.column(0).to_pylist()
    for begin, end, data, offsets in text_parts(batch.column(1)):
        for words in words_of(data, offsets, most_words):
            yield begin, data, langs[begin:end], words


def streams(docs: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """``lang, words, seen, symbols`` of ``lang, text``: see ``by_lang``; ``words`` counts those not seen before."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for _, _, langs, words in _batches_of_words(batch, most_words):
                for lang, seen, symbols, which in by_lang(words, langs):
                    rows.append((lang, int(np.count_nonzero(which >= words.seen)), seen, symbols.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []

    names, kinds = ["lang", "words", "seen", "symbols"], [pa.string(), pa.int64(), pa.int32(), pa.binary()]
    return docs.select("lang", "text").mapInArrow(work, "lang string, words bigint, seen int, symbols binary")


class Passed:
    """A set of fingerprints as bits: ``holds`` is true for all of them, and for few others while it is sparse."""

    def __init__(self, width: int, bits: np.ndarray):
        self._shift, self._bits = np.uint64(64 - width), bits

    @classmethod
    def of(cls, prints: DataFrame, column: str, most_bits: int = MOST_BITS) -> Passed:
        """Set in Spark; the driver gathers ``2 ** most_bits`` bits at most, whatever the number of fingerprints."""
        width = min(most_bits, max(_LEAST_BITS, (prints.count() * _BITS_A_KEY).bit_length()))
        place = F.shiftrightunsigned(column, 64 - width) + 1
        sets = prints.select(place.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("bits")
        )
        out = np.zeros(max(1, (1 << width) // 32_768) * 4096, np.uint8)
        for row in sets.toLocalIterator():
            at = (row["bucket"] - 1) * 4096
            out[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
        return cls(width, out)

    def holds(self, prints: np.ndarray) -> np.ndarray:
        at = prints >> self._shift
        return (self._bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def fingerprints(symbols: np.ndarray, size: int, seed: np.uint64) -> np.ndarray:
    """Of each run of ``size`` symbols; those with a 0 among them mean nothing."""
    values = mix(symbols * np.uint64(0x9E3779B97F4A7C15))
    begins = np.arange(max(0, len(symbols) - size + 1))
    return mix(runs(values, begins, begins + size, _WORD_BASE) + seed + np.uint64(size) * np.uint64(_SIZE))


def _solid(symbols: np.ndarray, size: int) -> np.ndarray:
    """Runs of ``size`` symbols without a 0."""
    zeros = np.cumsum(np.append(0, symbols == 0))
    return zeros[size:] == zeros[: max(0, len(zeros) - size)]


def _grown(valid: np.ndarray) -> np.ndarray:
    """Runs whose both parts of one word less are valid."""
    return valid[:-1] & valid[1:]


def pack_run(prints: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising fingerprints with counts in few bytes: differences in as many bytes as the largest needs, counts in one.

    A count of 255 or more stands at the end in full.
    """
    steps = np.diff(prints, prepend=np.uint64(0))
    steps[:1] = 0  # the first one is in the head
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    great = np.flatnonzero(counts >= 255)
    head = np.array([len(prints), width, len(great), prints[0]], "<u8")
    low = np.ascontiguousarray(steps.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return b"".join([head.tobytes(), low.tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[great].astype("<u8").tobytes()])


def unpack_run(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width, great, first = (int(x) for x in np.frombuffer(raw, "<u8", 4))
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = np.frombuffer(raw, np.uint8, n * width, 32).reshape(n, width)
    prints = np.cumsum(steps.view("<u8")[:, 0]) + np.uint64(first)
    counts = np.frombuffer(raw, np.uint8, n, 32 + n * width).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<u8", great, 32 + n * width + n)
    return prints, counts


def _counted(rows: DataFrame, size: int, shorter: Passed | None, least: int) -> DataFrame:
    """``print`` of the runs of ``size`` words that occur ``least`` times or more, by fingerprint alone.

    Only runs are counted whose shorter parts may be frequent. A task counts its own fingerprints, sorts them and
    sends each range of them on as one packed row, in about half the bytes that rows of their own would take;
    the task of a range adds the counts up. Fingerprints are spread evenly, so ranges are alike, and a fingerprint
    of very many occurrences is one entry of a row.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        many = 0

        def flush() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            number = (found >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            there, begins = np.unique(number, return_index=True)
            ends = np.append(begins[1:], len(found))
            packed = [pack_run(found[a:b], counts[a:b]) for a, b in zip(begins, ends)]
            return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(packed, pa.binary())], ["range", "run"])

        for batch in batches:
            own = seeds(batch.column(0).to_pylist())
            for i, (seen, raw) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                symbols = np.frombuffer(raw.as_buffer(), "<u4").astype(np.uint64)
                valid = _solid(symbols, size)
                if shorter is not None:
                    valid &= _grown(shorter.holds(fingerprints(symbols, size - 1, own[i])))[: len(valid)]
                valid[: max(0, seen - size + 1)] = False
                held.append(fingerprints(symbols, size, own[i])[valid])
                many += len(held[-1])
                if many >= _COUNTED:
                    yield flush()
                    held, many = [], 0
        if many:
            yield flush()

    def frequent(parts: list[bytes]) -> pa.RecordBatch:
        prints, counts = (np.concatenate(x) for x in zip(*map(unpack_run, parts)))
        order = np.argsort(prints, kind="stable")
        prints, counts = prints[order], counts[order]
        begins = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
        found = prints[begins[np.add.reduceat(counts, begins) >= least]]
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["print"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts = None, []
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if number != here and parts:
                    yield frequent(parts)
                    parts = []
                here = number
                parts.append(raw.as_py())
        if parts:
            yield frequent(parts)

    each = rows.select("lang", "seen", "symbols").mapInArrow(count, "range int, run binary")
    return each.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(add, "print bigint")


def _word_ids(data: np.ndarray, words: Words) -> np.ndarray:
    """Numbers of words, equal exactly where their lower-cased bytes are."""
    _, first, ids = np.unique(words.hashes, return_index=True, return_inverse=True)
    lengths = words.ends - words.begins
    like = first[ids]
    odd = lengths != lengths[like]
    same = np.flatnonzero(~odd)
    begins = words.begins - words.begins[0]
    low = _LOWER[data[words.begins[0] : words.ends[-1]]]
    odd[same] = unlike(low, begins[same], low, begins[like[same]], lengths[same])
    new: dict[bytes, int] = {}
    for w in np.flatnonzero(odd).tolist():
        text = _LOWER[data[words.begins[w] : words.ends[w]]].tobytes()
        ids[w] = new.setdefault(text, len(first) + len(new))
    return ids


def _distinct(ids: np.ndarray, prints: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and count of each distinct run of words ``ids[at:at + size]``, found by print and compared in full."""
    _, first, which, counts = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
    pointed = at[first][which]
    differ = np.zeros(len(at), bool)
    for j in range(size):
        differ |= ids[at + j] != ids[pointed + j]
    if not differ.any():
        return at[first], counts
    counts = counts - np.bincount(which[differ], minlength=len(first))
    lost = at[differ]
    _, own, more = np.unique(np.stack([ids[lost + j] for j in range(size)], 1), axis=0, return_index=True, return_counts=True)
    return np.append(at[first], lost[own]), np.append(counts, more)


def _materialised(docs: DataFrame, passed: list[Passed]) -> DataFrame:
    """``lang, phrase, words, f, doc_id`` of the runs that passed: their text, count, and a pointer to a document."""

    def phrases(texts: pa.Array, ids: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
        parts = texts.take(pa.array(ids[(at[:, None] + np.arange(size)).reshape(-1)]))
        ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * size)
        return pc.binary_join(pa.ListArray.from_arrays(ends, parts), b" ").view(pa.string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, data, langs, words in _batches_of_words(batch, len(passed)):
                _, first, ids = np.unique(_word_ids(data, words), return_index=True, return_inverse=True)
                spans = zip(words.begins[first].tolist(), words.ends[first].tolist(), strict=True)
                texts = pa.array([_LOWER[data[a:b]].tobytes() for a, b in spans], pa.binary())
                for lang, seen, symbols, which in by_lang(words, langs):
                    seed, symbols = seeds([lang])[0], symbols.astype(np.uint64)
                    valid = symbols != 0
                    for size, prints_passed in enumerate(passed, 1):
                        prints = fingerprints(symbols, size, seed)
                        valid = (valid if size == 1 else _grown(valid)[: len(prints)]) & prints_passed.holds(prints)
                        fresh = np.flatnonzero(valid)
                        fresh = fresh[fresh >= seen - size + 1]
                        if not len(fresh):
                            continue
                        at, counts = _distinct(ids, prints[fresh], which[fresh], size)
                        cols = [
                            pa.array([lang] * len(at), pa.string()), phrases(texts, ids, at, size),
                            pa.array(np.full(len(at), size, np.int32)), pa.array(counts, pa.int64()),
                            batch.column(2).take(pa.array(words.text[at] + begin)),
                        ]
                        yield pa.RecordBatch.from_arrays(cols, ["lang", "phrase", "words", "f", "doc_id"])

    return docs.select("lang", "text", "doc_id").mapInArrow(work, "lang string, phrase string, words int, f bigint, doc_id bigint")


def _written(df: DataFrame, name: str) -> DataFrame:
    place = scratch_path(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def frequent_phrases(docs: DataFrame, rows: DataFrame, *, least: int, most_words: int, most_bits: int = MOST_BITS) -> DataFrame:
    """``lang, phrase, words, f, doc_id`` of all runs of 1 to ``most_words`` words that occur ``least`` times or more.

    ``docs`` has ``lang, text, doc_id`` and ``rows`` its streams. ``doc_id`` is the least id of a document with the phrase.
    """
    passed: list[Passed] = []
    for size in range(1, most_words + 1):
        counted = _counted(rows, size, passed[-1] if passed else None, least)
        passed.append(Passed.of(_written(counted, f"prints-{size}"), "print", most_bits))
    merged = _materialised(docs, passed).groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"), F.min("doc_id").alias("doc_id"))
    return _written(merged.where(F.col("f") >= least), "phrases")


def _joined(words: Column, begin: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, begin, size), " ")


def _scored(phrases: DataFrame, all_words: DataFrame) -> DataFrame:
    """Each phrase of two words or more at its lowest-scoring cut: ``lang, phrase, words, a, doc_id, l, r, n, score``."""
    long = phrases.where("words > 1").withColumnRenamed("f", "a")
    split = F.split("phrase", " ")
    cut = long.select("lang", "phrase", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), _joined(split, F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(1).alias("side"), _joined(split, F.col("k") + 1, F.col("words") - F.col("k")).alias("part")),
    )
    asked = cut.select("lang", "phrase", "k", F.inline(sides))
    uses = asked.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("uses"))
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("of")).join(uses, ["lang", "part"])
    found = spread_lookup(asked, _written(parts, "parts"), ["lang", "part"], "uses", asked.count())
    sums = [F.max(F.when(F.col("side") == s, F.col("of"))).alias(name) for s, name in ((0, "l"), (1, "r"))]
    cuts = long.join(found.groupBy("lang", "phrase", "k").agg(*sums), ["lang", "phrase"])
    sized = all_words.join(long.groupBy("lang").agg(F.count(F.lit(1)).alias("phrases")), "lang")
    # Up to four rows for each phrase.
    cuts = spread_lookup(cuts, sized.withColumn("phrases", 4 * F.col("phrases")), ["lang"], "phrases", 4 * long.count())
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    above, below = 1000 * exact["a"] * exact["n"], exact["l"] * exact["r"]
    scored = cuts.withColumn("_above", above.cast("decimal(38,0)")).withColumn("_below", below.cast("decimal(38,0)"))
    scored = scored.withColumn("score", F.expr("_above div _below"))
    lowest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut")
    least = scored.groupBy("lang", "phrase", "words", "a", "doc_id", "n").agg(lowest)
    return least.select("lang", "phrase", "words", "a", "doc_id", "n", "cut.*")


def _covered(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, most``: how often the most frequent longer phrase occurs that has a phrase of two words or more inside."""
    split, size = F.split("phrase", " "), F.col("words")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda begin: _joined(split, begin, k)),
        )
    )
    inside = phrases.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "f")
    return inside.groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(
    docs: DataFrame, *, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, covered: int = 100,
    text: str = "text", lang: str = "lang", doc_id: str = "doc_id", most_bits: int = MOST_BITS,
) -> DataFrame:
    """``lang, rank, phrase, words, a, l, r, n, score, doc_id``: each language's ``top`` phrases whose words belong together.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and pieces into words at spaces and
    tabs. A phrase is a run of 2 to ``most_words`` words that occurs ``least`` times or more, overlaps included.
    It scores ``floor(1000 a n / (l r))`` at its worst cut: ``a`` counts the phrase, ``l`` and ``r`` what stands before and
    after the cut, ``n`` all words of the language. A phrase inside a longer one that occurs ``covered`` percent as
    often or more is left out. Ties go by ``a`` descending, then by the phrase's bytes. ``doc_id`` is the least id
    of a document with the phrase.

    A null language is ``und``; null and empty texts have no words; repeated rows count each; null ids point to
    nothing. No rows give no rows, and other columns are ignored. ``docs`` is read twice.
    """
    plain = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANG)).alias("lang"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
    )
    rows = _written(streams(plain, most_words), "streams")
    phrases = frequent_phrases(plain, rows, least=least, most_words=most_words, most_bits=most_bits)
    all_words = rows.groupBy("lang").agg(F.sum("words").alias("n"))
    scored = _scored(phrases, all_words).join(_covered(phrases), ["lang", "phrase"], "left")
    kept = scored.where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = first_rows(_written(kept, "scored"), ["lang"], order, top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "words", "a", "l", "r", "n", "score", "doc_id")
