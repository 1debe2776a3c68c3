"""The text-corpus pipeline: filters, duplicates and packing, each stage written and read again.

A stage takes ``(spark, docs, sf_dir)`` and returns a frame. All but the last return the columns of
``documents``; labels are read from ``sf_dir``. Texts and ids may be null and ids may repeat: a null text
counts as empty wherever an operator says so, and the duplicate stages tell rows apart by a key of their own.
Columns of any name stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stayframe.llm import digest_index, hamming_join, packing, quality, toxicity
from stayframe.llm.labelled import held_out
from stayframe.llm.queries import vocabulary
from stayframe.llm.row_keys import free_name, with_row_key, without
from stayframe.session import scratch_path

TOXIC_FROM = 0.3
GOOD_FROM = 0.5


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity is 0.3 or more go. Labels of every fourth id, by crc32, are never looked at."""
    net, out = toxicity.fit_labelled(docs, _labels(spark, sf_dir), ~held_out(F.col("doc_id"), 4, 2)), free_name(docs, "toxicity")
    return toxicity.score(docs, net, out=out).where(F.col(out) < TOXIC_FROM).drop(out)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality is below 0.5 go. Labels of every third id, by crc32, are never looked at."""
    model, out = quality.fit_labelled(docs, _labels(spark, sf_dir), ~held_out(F.col("doc_id"), 3, 1)), free_name(docs, "quality_score")
    return quality.score(docs, model, out=out).where(F.col(out) >= GOOD_FROM).drop(out)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, white space aside: the longest original, then the smallest id.

    Rows with a null or repeated id are rows of their own and come after all others.
    """
    rows, key = with_row_key(docs)
    return without(rows, key, digest_index.exact_dedup(rows, doc_id=key).where("not kept").select("doc_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id stays of documents that links of similarity 0.8 on five-word shingles join.

    Rows with a null or repeated id are documents of their own and come after all others.
    """
    rows, key = with_row_key(docs)
    return without(rows, key, hamming_join.near_duplicates(rows, size=5, num=80, den=100, doc_id=key).where("not kept").select("doc_id"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with the sequence of 2,048 tokens each lies in, and their place there."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

# Trained scores and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        place = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return STAGES[-1][1](spark, docs, sf_dir)
