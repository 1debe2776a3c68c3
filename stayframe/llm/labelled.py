"""Labelled samples for the classifiers, and the rows that their labels must not come from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids have none."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(remainder(doc_id, parts) == part, F.lit(False))


def sample_texts(docs: DataFrame, ids: DataFrame, most: int, longest: int) -> list[str]:
    """At most ``most`` texts of up to ``longest`` characters, the same ones in every run.

    Twice as many ids are drawn from the narrow table ``ids`` (column ``doc_id``), to make up for texts
    that are empty, too long or not there, and only theirs are fetched. Bounded by both parameters, so
    the ids may be broadcast and the driver may hold the texts.
    """
    drawn = ids.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(2 * most)
    fit = docs.where((F.length("text") > 0) & (F.length("text") <= longest)).select("doc_id", "text")
    found = fit.join(F.broadcast(drawn), "doc_id").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "text").limit(most)
    return [r["text"] for r in found.collect()]


def with_scores(docs: DataFrame, text: str, out: str, work: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """``docs`` with a number for each row that ``work`` makes from a batch of its texts, nulls included.

    A column named ``out`` is replaced; all others stay, whatever their names.
    """
    rest = docs.drop(out)
    # The text travels once, within its row.
    packed = rest.select(F.struct(*[rest[f"`{c}`"] for c in rest.columns]).alias("row"))
    at = rest.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            found = pa.array(work(rows.field(at).cast(pa.string())), pa.float64())
            yield pa.RecordBatch.from_arrays([rows, found], ["row", "score"])

    kind = packed.select("row", F.lit(0.0).alias("score")).schema
    made = packed.mapInArrow(score, kind)
    return made.select("row.*", F.col("score").alias(out))
