"""Ranked lexical search: short lists summed term by term, long lists met document by document.

Tasks turn runs of documents into segments: the documents' term counts and, for every term asked for, its
postings. No postings are shuffled; the tasks need only each term's count over all segments. A segment
answers an item in two steps. The items' short lists are summed into one list of accumulators. That list
and the long lists are then iterators with known upper bounds, walked in document order a block at a time:
a block whose bounds can't reach the ``k``-th best score so far is skipped in all lists at once, and a block
is left as soon as the lists not yet added can't lift its best document that far.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stayframe.llm.shingles import text_parts, word_spans
from stayframe.session import scratch_path

K = 20
# Documents and postings of a segment, and documents of a block.
SEGMENT = 16_384
POSTINGS = 2_000_000
BLOCK = 64
# Short lists together hold at most one posting for so many documents of a segment.
SHORT_SHARE = 2
# Text of the items that one pass over the documents answers.
ITEM_BYTES = 4_000_000

_PARTS = np.ones(256, bool)
_PARTS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_FILTER = 20


def _terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``begin, end, hashes, first`` of runs of rows; a term is known by 64 bits of its lower-cased bytes."""
    for begin, end, data, offsets in text_parts(texts):
        hashes, _, first = word_spans(data, offsets, True, _PARTS)
        yield begin, end, hashes, first


@dataclass
class Items:
    """Items of one pass, and their distinct terms in order: term places and repeats by item."""

    ids: list[int | None]
    terms: np.ndarray
    asked: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list[int | None], texts: list[str | None]) -> Items:
        hashes = [np.zeros(0, np.uint64)] * len(ids)
        for begin, end, found, first in _terms(pa.array(texts, pa.string())):
            for i in range(begin, end):
                hashes[i] = found[first[i - begin] : first[i - begin + 1]]
        terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        counted = [np.unique(h, return_counts=True) for h in hashes]
        return cls(ids, terms, [(np.searchsorted(terms, h), n) for h, n in counted])


_SEGMENT = "doc_ids array<bigint>, sizes array<bigint>, terms array<int>, counts array<int>, docs binary, repeats binary"


def segments(docs: DataFrame, terms: np.ndarray, *, segment: int = SEGMENT, postings: int = POSTINGS) -> DataFrame:
    """One row per segment of ``doc_id, text``: ids, term counts, and postings of the terms asked for.

    ``terms`` are sorted; ``docs`` and ``repeats`` hold the lists of ``terms`` one after another, ``counts`` long, as
    places in ``doc_ids``, ascending, and occurrences. Documents stand in ascending id, null ids last; equal
    ids as they come. A null text has no terms. ``postings`` closes a segment early; a text is in one whole.
    """
    likely = np.zeros(1 << _FILTER, bool)
    likely[terms >> np.uint64(64 - _FILTER)] = True

    def made(ids: list, sizes: list, held: list) -> pa.RecordBatch:
        ids, sizes = pa.concat_arrays(ids), np.concatenate(sizes)
        order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        term, doc, n = (np.concatenate([h[c] for h in held]) for c in range(3))
        code = term * len(ids) + place[doc]
        by = np.argsort(code, kind="stable")
        found, counts = np.unique(term, return_counts=True)
        row = [ids.take(pa.array(order)), pa.array(sizes[order]), pa.array(found, pa.int32()), pa.array(counts, pa.int32())]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in row]
        raw = [place[doc][by].astype("<i4").tobytes(), n[by].astype("<i4").tobytes()]
        return pa.RecordBatch.from_arrays(
            [*lists, *(pa.array([r], pa.binary()) for r in raw)], ["doc_ids", "sizes", "terms", "counts", "docs", "repeats"]
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, held, rows, many = [], [], [], 0, 0
        for batch in batches:
            for begin, end, hashes, first in _terms(batch.column(1)):
                maybe = np.flatnonzero(likely[hashes >> np.uint64(64 - _FILTER)])
                at = np.searchsorted(terms, hashes[maybe])
                is_it = terms[np.minimum(at, len(terms) - 1)] == hashes[maybe] if len(terms) else np.zeros(0, bool)
                maybe, at = maybe[is_it], at[is_it]
                doc = np.searchsorted(first, maybe, "right") - 1
                code, n = np.unique(doc * max(1, len(terms)) + at, return_counts=True)
                doc, at = np.divmod(code, max(1, len(terms)))
                ids.append(batch.column(0).slice(begin, end - begin))
                sizes.append(np.diff(first).astype(np.int64))
                held.append((at, doc + rows, n))
                rows, many = rows + end - begin, many + len(code)
                if rows >= segment or many >= postings:
                    yield made(ids, sizes, held)
                    ids, sizes, held, rows, many = [], [], [], 0, 0
        if rows:
            yield made(ids, sizes, held)

    return docs.select("doc_id", "text").mapInArrow(work, _SEGMENT)


class Segment:
    """Postings of one segment with the share of the score that does not depend on the item."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, docs: np.ndarray, repeats: np.ndarray, all_docs: int, all_terms: int):
        self.docs, self.rows = docs, len(sizes)
        self.blocks = -(-self.rows // BLOCK)
        self._where = {t: i for i, t in enumerate(terms.tolist())}
        self._ends = np.append(0, np.cumsum(counts)).tolist()
        long = 25 * all_docs * int(sizes.max(initial=0)) >= 2**63
        m = 75 + (25 * (sizes.astype(object) if long else sizes) * all_docs) // max(1, all_terms)
        self.gains = ((1_000_000_000 * repeats) // (1000 * repeats + 12 * m[docs])).astype(np.int64)
        self._blocked: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def span(self, term: int) -> tuple[int, int]:
        at = self._where.get(term)
        return (0, 0) if at is None else (self._ends[at], self._ends[at + 1])

    def blocked(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each block's postings of a list begin, and the greatest gain in each block."""
        if term not in self._blocked:
            a, b = self.span(term)
            begins = a + np.searchsorted(self.docs[a:b], np.arange(self.blocks + 1) * BLOCK)
            most = np.zeros(self.blocks, np.int64)
            filled = np.flatnonzero(begins[1:] > begins[:-1])
            most[filled] = np.maximum.reduceat(self.gains[:b], begins[filled]) if len(filled) else 0
            self._blocked[term] = begins, most
        return self._blocked[term]

    def top(self, terms: list[int], weights: list[int], k: int) -> list[tuple[int, int]]:
        """Score and place of the ``k`` best documents with a score above 0; ties go to earlier places."""
        lists = sorted(((b - a, t, w) for t, w in zip(terms, weights, strict=True) for a, b in [self.span(t)] if b > a and w > 0))
        sums, room = np.zeros(self.blocks * BLOCK, np.int64), self.rows // SHORT_SHARE
        long = []
        for n, term, weight in lists:
            if n <= room:
                room -= n
                a, b = self.span(term)
                sums[self.docs[a:b]] += weight * self.gains[a:b]
            else:
                room = 0  # all longer lists are long ones
                long.append((term, weight))
        # The accumulators are one list more, and their k-th best sum is a score that k documents reach.
        bounds = sums.reshape(-1, BLOCK).max(1) if self.blocks else sums
        least = int(np.partition(sums, -k)[-k]) if len(sums) >= k else 0
        blocked = [(w, *self.blocked(t)) for t, w in long]
        blocked = sorted(((w * int(most.max()), w, begins, most) for w, begins, most in blocked), key=lambda x: -x[0])
        for _, weight, _, most in blocked:
            bounds = bounds + weight * most
        best: list[tuple[int, int]] = []  # (score, -place), so that of equal scores the latest place goes first
        for block in np.flatnonzero(bounds >= max(1, least)).tolist():
            floor = best[0][0] if len(best) == k else 0
            # A later document needs more than the k-th best has; one with what `least` promises may be it.
            if bounds[block] < max(least, floor + 1):
                continue
            base, rest = block * BLOCK, int(bounds[block])
            total = sums[base : base + BLOCK].copy()
            rest -= int(total.max())
            for _, weight, begins, most in blocked:
                if int(total.max()) + rest < max(least, floor + 1):
                    break
                a, b = begins[block], begins[block + 1]
                total[self.docs[a:b] - base] += weight * self.gains[a:b]
                rest -= weight * int(most[block])
            else:
                for at in np.flatnonzero(total >= max(least, floor + 1)).tolist():
                    entry = (int(total[at]), -(base + at))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
        return [(score, -place) for score, place in best]


def weight(all_docs: int, with_term: int) -> int:
    return math.floor(1000 * math.log((2 * all_docs + 2) / (2 * with_term + 1)))


def _best_of_segments(found: DataFrame, items: Items, all_docs: int, all_terms: int, frequency: dict[int, int], k: int) -> DataFrame:
    asked = []
    for places, repeats in items.asked:
        weights = [weight(all_docs, frequency.get(p, 0)) * int(n) for p, n in zip(places.tolist(), repeats, strict=True)]
        asked.append((places.tolist(), weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                ids, sizes, terms, counts = (batch.column(c)[row].values for c in range(4))
                docs = np.frombuffer(batch.column(4)[row].as_py(), "<i4")
                repeats = np.frombuffer(batch.column(5)[row].as_py(), "<i4").astype(np.int64)
                segment = Segment(sizes.to_numpy(), terms.to_numpy(), counts.to_numpy(), docs, repeats, all_docs, all_terms)
                out = [(i, p, s) for i, (t, w) in enumerate(asked) for s, p in segment.top(t, w, k)]
                item, place, score = (pa.array([x[c] for x in out], pa.int64()) for c in range(3))
                yield pa.RecordBatch.from_arrays([item, ids.take(place), score], ["item", "doc_id", "score"])

    made = found.mapInArrow(work, "item bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = made.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = made.sparkSession.createDataFrame(list(enumerate(items.ids)), "item bigint, item_id bigint")
    return best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _passes(items: DataFrame, item_bytes: int) -> Iterator[Items]:
    """Items in groups of about ``item_bytes`` of text, dealt by hash; the driver holds one group at a time."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-size // item_bytes)
    dealt = items.where("text is not null").withColumn("_pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, groups))))
    for g in range(groups):
        rows = dealt.where(F.col("_pass") == g).orderBy("item_id", "text").collect()
        yield Items.of([r["item_id"] for r in rows], [r["text"] for r in rows])


def search(
    docs: DataFrame, items: DataFrame, *, k: int = K, segment: int = SEGMENT, postings: int = POSTINGS, item_bytes: int = ITEM_BYTES,
    text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item, of equal scores the smaller id first.

    A term is a run of letters, digits and characters beyond ASCII, A-Z lower-cased. Its weight is
    ``floor(1000 ln((2N + 2) / (2 df + 1)))``; in a document of ``n`` terms that holds it ``tf`` times it adds its weight
    times ``10^9 tf div (1000 tf + 12 (75 + 25 n N div L))``, for each time the item holds it. ``N`` counts the
    documents with a term and ``L`` all their terms. Documents without a common term are not ranked. Null and
    empty texts match nothing. Items that repeat an id are items of their own, each with its own ranks, and
    so are documents; null ids come last among equal scores. Empty tables give no rows; other columns are ignored.
    The documents are read once for about ``item_bytes`` of items.
    """
    spark: SparkSession = docs.sparkSession
    plain = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    asked = items.select(F.col(f"`{item_id}`").cast("bigint").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for group in _passes(asked, item_bytes):
        place = scratch_path(spark, "segments")
        segments(plain, group.terms, segment=segment, postings=postings).write.parquet(place)
        found = spark.read.parquet(place)
        sized = F.aggregate("sizes", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("l")), lambda s, x: F.struct(
            (s["n"] + F.when(x > 0, 1).otherwise(0)).alias("n"), (s["l"] + x).alias("l")))
        all_docs, all_terms = found.select(sized.alias("s")).agg(F.sum("s.n"), F.sum("s.l")).first()
        # At most as many rows as the group of items has terms.
        counts = found.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts"))
        frequency = dict(counts.toDF("term", "df").collect())
        if frequency:
            out = out.unionByName(_best_of_segments(found, group, all_docs, all_terms, frequency, k))
    return out
