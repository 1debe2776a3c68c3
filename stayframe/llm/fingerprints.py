"""MinHash fingerprints of whole texts, how alike they are, and links found through their bands.

A fingerprint holds, for each of ``SLOTS`` universal hash functions, 8 bits of the least value over a
text's word shingles. The share of equal slots, less what chance gives, estimates the similarity of
two texts' shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from stayframe.llm.hamming_join import confirm, equal_sets, few_rows_at_once, key_counts, units, with_components, written
from stayframe.llm.shingles import mix, shingles, text_parts, text_shingles, word_hashes
from stayframe.llm.spread import text_or_empty
from stayframe.session import scratch_path

SLOTS = 128
SIZE = 5
# Slots of a band: texts of similarity 0.8 share one of the 25 bands but once in 20,000 times.
BAND = 5
BANDS = SLOTS // BAND
# Characters that a task compares at once.
AT_ONCE = 400_000

_DRAW = np.random.default_rng(4_242)
_FACTOR = _DRAW.integers(0, 2**64, SLOTS, np.uint64) | np.uint64(1)
_SHIFT = _DRAW.integers(0, 2**64, SLOTS, np.uint64)


def text_fingerprints(column: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """One row of 8-bit slots per text, and the number of its shingles; a text without words has zeros."""
    out, counts = np.zeros((len(column), SLOTS), np.uint8), np.zeros(len(column), np.int64)
    for begin, end, data, offsets in text_parts(column, 500_000):
        words, first = word_hashes(data, offsets, True)
        runs, starts = shingles(words, first, size)
        counts[begin:end] = np.diff(starts)
        some = np.flatnonzero(np.diff(starts))
        if not len(some):
            continue
        for k in range(SLOTS):
            least = np.minimum.reduceat(runs * _FACTOR[k] + _SHIFT[k], starts[some])
            out[begin + some, k] = (least >> np.uint64(8) & np.uint64(255)).astype(np.uint8)
    return out, counts


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimated similarity, row by row, 0 to 1. Two texts without words are alike, one is like no other."""
    same = (a == b).mean(1)
    estimate = np.clip((same - 1 / 256) / (1 - 1 / 256), 0, 1)
    return np.where((some_a > 0) & (some_b > 0), estimate, ((some_a == 0) & (some_b == 0)).astype(float))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of another, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_KIND = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
_FIELDS = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(ids: list, texts: list[str], following: list[str], size: int) -> pa.RecordBatch:
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    prints, some = text_fingerprints(pa.array([*texts, *changed, *following], pa.string()), size)
    n = len(texts)
    own, other, after = prints[:n], prints[n : 2 * n], prints[2 * n :]
    made = [
        ids,
        [len(t) for t in texts],
        [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        [x.tobytes().hex() for x in own],
        [x.tobytes().hex() for x in other],
        likeness(own, other, some[:n], some[n : 2 * n]),
        likeness(own, after, some[:n], some[2 * n :]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, _KIND, strict=True)], schema=_KIND)


def compare_neighbours(
    docs: DataFrame, *, size: int = SIZE, partitions: int | None = None, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Fingerprint every whole text, and compare it with its edited form and with the next document.

    The next document has the next smaller id, and the first follows the last; the edited text has its
    last half replaced from the next one. Rows are dealt into ranges of the id and read in order, so a
    text moves once; only the ends of ranges, two texts for each, are joined afterwards. A null text
    counts as empty. Null ids come last, repeated ids follow each other in an order that their texts
    settle. A single row is its own next. No rows give no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), text_or_empty(docs, text).alias("text"))
    down = [F.col("doc_id").desc_nulls_last()]
    ranged = rows.repartitionByRange(partitions, *down).sortWithinPartitions(*down, F.xxhash64("text"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple] = []  # rows to compare; the last one waits for its next
        size_held, start = 0, None

        def ends() -> pa.RecordBatch:
            pair = [start, held[-1]]
            empty = pa.RecordBatch.from_pylist([{"doc_id": x[0]} for x in pair], _KIND)
            more = [pa.array([part, part]), pa.array([x[1] for x in pair], pa.string()), pa.array([True, False])]
            return pa.RecordBatch.from_arrays([*empty.columns, *more], [*_KIND.names, "part", "end_text", "is_start"])

        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                held.append((key.as_py(), value.as_py()))
                size_held += len(held[-1][1])
                if start is None:
                    start = held[0]
                if len(held) > 1 and size_held > AT_ONCE:
                    yield _plain(held, size)
                    held = held[-1:]
                    size_held = len(held[0][1])
        if len(held) > 1:
            yield _plain(held, size)
        if held:
            yield ends()

    kind = _FIELDS + ", part bigint, end_text string, is_start boolean"
    place = scratch_path(spark, "fingerprints")
    ranged.mapInArrow(walk, kind).write.parquet(place)
    found = spark.read.parquet(place)
    bounds = found.where("end_text is not null").select("doc_id", "part", "end_text", "is_start")
    starts = bounds.where("is_start").select("part", F.col("end_text").alias("following"))
    # One row for each range that has rows: its start becomes the next of the range before, in a circle.
    along = Window.orderBy("part")
    order = starts.select("part", F.lead("part").over(along).alias("after"), F.min("part").over(Window.partitionBy(F.lit(0))).alias("least"))
    last = bounds.where("not is_start").join(order, "part").withColumn("after", F.coalesce("after", "least"))
    pairs = last.select("doc_id", "end_text", "after").join(starts.withColumnRenamed("part", "after"), "after")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(len(batch)):
                key, own, after = (c[a].as_py() for c in batch.columns)
                yield _compare([key], [own], [after], size)

    met = pairs.select("doc_id", "end_text", "following").mapInArrow(finish, _FIELDS)
    return found.where("end_text is null").select(*met.columns).unionByName(met)


def _plain(held: list[tuple], size: int) -> pa.RecordBatch:
    """Rows for all but the last of some consecutive documents."""
    made = _compare([x[0] for x in held[:-1]], [x[1] for x in held[:-1]], [x[1] for x in held[1:]], size)
    n = len(made)
    more = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.bool_())]
    return pa.RecordBatch.from_arrays([*made.columns, *more], [*_KIND.names, "part", "end_text", "is_start"])


def linked(
    docs: DataFrame, *, size: int = SIZE, num: int = 80, den: int = 100, block: int = 1024,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: components of links of similarity ``num / den`` or more.

    Texts whose fingerprints share a band are compared on whole shingle sets. What the columns hold for
    texts without words, null and repeated ids is as ``hamming_join.near_duplicates`` says.
    """
    plain = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = batch.column(0).to_pylist(), text_fingerprints(batch.column(1), size)[0]
            counts, keys = [], []
            for i, found in text_shingles(batch.column(1), size, True):
                raw = found.tobytes() if len(found) else f"empty {ids[i]}".encode()
                counts.append(len(found))
                keys.append(hashlib.blake2b(raw, digest_size=16).digest())
            made = [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary())]
            made.append(pa.array([x.tobytes() for x in prints], pa.binary()))
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_shingles", "set_key", "signature"])

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, SLOTS)
            for b in range(BANDS):
                key = np.full(len(batch), b, np.uint64)
                for s in range(b * BAND, b * BAND + BAND):
                    key = mix(key * np.uint64(257) + prints[:, s])
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), batch.column(0), batch.column(2)], ["key", "rep", "n"])

    signed = written(plain.mapInArrow(sign, "doc_id bigint, n_shingles bigint, set_key binary, signature binary"), "signed")
    sets = written(equal_sets(signed), "sets")
    keyed = sets.select("rep", "signature", "n").mapInArrow(bands, "key bigint, rep bigint, n bigint")
    counts = written(key_counts(keyed), "band-sizes")
    members = units(keyed, counts, BANDS * sets.count(), block).select("key", "i", "j", "block", "rep")
    with few_rows_at_once(docs.sparkSession):
        links = written(confirm(members, plain, size, True, num, den).distinct(), "links")
    return with_components(signed, sets, links)
