"""Repeated and nearly repeated lines over all documents, by a deletion-neighbourhood join.

Two lines differ by one edit exactly if they agree after each loses the character at one same place (a
character changed), or if one of them, after losing a character, is the other. So every line enters
under a hash for each character left out, and lines that share a hash meet. Before that, lines that
cannot have a partner are set aside: of two lines within one edit, the longer of length ``t``, either
the first or the last ``(t - 1) // 2`` characters are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stayframe.llm.shingles import mix
from stayframe.llm.spread import keep_likely, spread_lookup, text_or_empty
from stayframe.session import scratch_path

# Shorter lines are dropped only when equal: one edit makes another word of them.
LEAST = 12

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = ["doc_id", "twin", "line_no"]


def one_edit_keys(line: str, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the line without its character at each place from ``begin`` to ``end``: with the place
    and the length (for a changed character), and of the rest alone (for one more); and the line's own.
    """
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(points + np.uint64(7)) * power[:-1], dtype=np.uint64)])
    at = np.arange(begin, end)
    rest = sums[at] + (sums[n] - sums[at + 1]) * _INVERSE
    changed = mix(mix(rest + np.uint64(n)) + at.astype(np.uint64) + np.uint64(1))
    fewer = mix(rest ^ np.uint64(n - 1))
    own = int(mix(sums[n : n + 1] ^ np.uint64(n)).astype(np.int64)[0])
    return changed.astype(np.int64), fewer.astype(np.int64), own


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, twin, line_no, line`` of all lines that are not blank; ``twin`` tells repeated ids apart."""
    numbered = docs.select("doc_id", "twin", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return numbered.where(F.trim("line") != "")


def _written(df: DataFrame, name: str) -> DataFrame:
    place = scratch_path(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def _distinct(docs: DataFrame, least: int) -> DataFrame:
    """Each distinct line once: hashes, first place, number of copies, length, keys of its halves."""
    n = F.length("line")
    halves = []
    for longer in (n, n + 1):
        half = F.floor((longer - 1) / 2).cast("int")
        halves += [F.xxhash64(F.lit(0), longer, F.left("line", half)), F.xxhash64(F.lit(1), longer, F.right("line", half))]
    keys = F.when(n >= least, F.array(*halves))
    lines = _lines(docs).select(
        *_PLACE, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), n.alias("n"), keys.alias("keys")
    )
    grown = lines.groupBy("h1", "h2").agg(
        F.min(F.struct(*_PLACE)).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys")
    )
    return grown.select("h1", "h2", "first", "copies", "n", "keys")


def _hopeful(distinct: DataFrame) -> DataFrame:
    """Lines that share a half with another of fitting length, and where and how they may differ."""
    keyed = distinct.where("keys is not null").select("first", "n", F.posexplode("keys").alias("which", "key"))
    shared = _written(
        keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("lo"), F.max("n").alias("hi")).where("size > 1"),
        "half-keys",
    )
    total = 4 * distinct.count()
    met = spread_lookup(keyed, shared, ["key"], "size", total).where("size > 1")
    back, even = F.pmod("which", F.lit(2)) == 0, F.col("lo") == F.col("hi")
    return met.groupBy("first").agg(
        F.max(back).alias("back"), F.max(~back).alias("front"), F.max(~even).alias("uneven"),
    ).select("first.*", "back", "front", "uneven")


def _variants(docs: DataFrame, hopeful: DataFrame) -> DataFrame:
    """``key, kind, doc_id, twin, line_no, line``: kind 0 a changed character, 1 one left out, 2 the line
    itself, 3 a row that carries the line."""
    wanted = hopeful.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("line_no", "back", "front", "uneven")).alias("wanted"))
    texts = keep_likely(docs, "doc_id", hopeful.select("doc_id"))
    met = texts.join(wanted.hint("merge"), ["doc_id", "twin"]).select("doc_id", "twin", "text", "wanted")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, twin, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = text.split("\n")
                for want in wanted:
                    line, number = lines[want["line_no"]], want["line_no"]
                    half = (len(line) - 1) // 2
                    begin = 0 if want["front"] else half
                    end = len(line) if want["back"] else len(line) - half
                    changed, fewer, own = one_edit_keys(line, begin, end)
                    keys, kinds = [changed, [0]], [np.zeros(len(changed), np.int32), [3]]
                    if want["uneven"]:
                        keys += [fewer, [own]]
                        kinds += [np.ones(len(fewer), np.int32), [2]]
                    kind = np.concatenate(kinds).astype(np.int32)
                    n = len(kind)
                    carried = np.full(n, None, object)
                    carried[kind == 3] = line
                    made = [
                        pa.array(np.concatenate(keys).astype(np.int64)), pa.array(kind), pa.array(np.full(n, doc_id, np.int64)),
                        pa.array(np.full(n, twin, np.int64)), pa.array(np.full(n, number, np.int32)), pa.array(carried, pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(made, ["key", "kind", *_PLACE, "line"])

    return met.mapInArrow(work, "key bigint, kind int, doc_id bigint, twin bigint, line_no int, line string")


def _near(variants: DataFrame) -> DataFrame:
    """First places of lines that an earlier line is within one edit of, with the earliest such line's."""
    entries = variants.where("kind < 3").select("key", "kind", F.struct(*_PLACE).alias("place"))
    firsts = entries.groupBy("key").agg(
        *[F.min(F.when(F.col("kind") == k, F.col("place"))).alias(f"first{k}") for k in range(3)], F.count(F.lit(1)).alias("size")
    ).where("size > 1")
    met = spread_lookup(entries, firsts, ["key"], "size", entries.count()).where("size > 1")
    # A changed character: any line of the key will do. One more or fewer: only one of the other kind.
    witness = F.when(F.col("kind") == 0, F.col("first0")).when(F.col("kind") == 1, F.col("first2")).otherwise(F.col("first1"))
    pairs = met.select("place", witness.alias("witness")).where("witness < place").distinct()
    lines = variants.where("kind = 3").select(F.struct(*_PLACE).alias("place"), "line")
    both = pairs.join(lines, "place").join(lines.select(F.col("place").alias("witness"), F.col("line").alias("earlier")), "witness")
    sure = both.where(F.levenshtein("line", "earlier", 1) >= 0)
    return sure.groupBy("place").agg(F.min("witness").alias("witness"))


def _ready(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    body = text_or_empty(docs, text)
    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.xxhash64(body).alias("twin"), body.alias("text"))


def repeated_lines(docs: DataFrame, *, least: int = LEAST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_lines, dropped_lines`` (numbers from 0, ascending) for every row.

    A line is dropped if the same line stands earlier, by document id and then line number, or if some
    earlier line of ``least`` characters or more is within one edit of it, whether that one is itself
    dropped or not. Blank lines always stay. A null text is one blank line. Rows with a null id take no part and
    lose nothing. Rows that repeat an id are told apart by their text; rows that repeat both are the
    same place and lose the same lines. No rows give no rows; extra columns are ignored.
    """
    rows = _ready(docs, text, doc_id)
    known = rows.where("doc_id is not null")
    distinct = _written(_distinct(known, least), "distinct-lines")
    variants = _written(_variants(known, _written(_hopeful(distinct), "hopeful-lines")), "line-variants")
    near = _near(variants).select(F.col("place").alias("first"), F.lit(True).alias("near"))
    verdicts = _written(
        distinct.join(near, "first", "left").where("copies > 1 or near").select("h1", "h2", "first", "copies", "near"), "line-verdicts"
    )
    places = _lines(known).select(*_PLACE, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))
    total = distinct.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    met = spread_lookup(places, verdicts, ["h1", "h2"], "copies", total).where("first is not null")
    gone = met.where(F.coalesce(F.col("near"), F.lit(False)) | (F.struct(*_PLACE) != F.col("first")))
    by_doc = gone.groupBy("doc_id", "twin").agg(F.array_sort(F.collect_set("line_no")).alias("dropped_lines"))
    sized = rows.select("doc_id", "twin", F.size(F.split("text", "\n", -1)).alias("n_lines"))
    none = F.array().cast("array<int>")
    return sized.join(by_doc, ["doc_id", "twin"], "left").select(
        "doc_id", "n_lines", F.coalesce("dropped_lines", none).alias("dropped_lines"), "twin"
    )


def without_lines(docs: DataFrame, found: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, text`` with the lines that ``repeated_lines`` found left out."""
    lost = found.where(F.size("dropped_lines") > 0).select("doc_id", "twin", "dropped_lines").distinct()
    met = _ready(docs, text, doc_id).join(lost, ["doc_id", "twin"], "left")
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("dropped_lines", i))
    return met.select("doc_id", F.when(F.col("dropped_lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
