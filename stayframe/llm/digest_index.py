"""Exact duplicates through a persistent index of digests, in DataFrame functions alone.

The index is a table bucketed and sorted by digest: one row per distinct text, ever. A batch of new
documents is reduced to digests, joined to the index by sort-merge (the index side is not shuffled),
and what the index lacks is appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stayframe.llm.spread import spread_lookup, text_or_empty
from stayframe.session import scratch_path

BUCKETS = 64
_SCHEMA = "text_sha256 string, keep_id bigint, n_points bigint, group_size bigint"
WHITE_SPACE = " \t\n\v\f\r"


def normal_digest(text: Column) -> Column:
    """SHA-256 of the text without spaces, tabs and line ends, as lower-case hex."""
    for space in WHITE_SPACE:  # on bytes, without a decoded copy of the text
        text = F.replace(text, F.lit(space))
    return F.sha2(text.cast("binary"), 256)


class DigestIndex:
    """A digest table of its own: ``path`` holds the files, ``table`` the name in this session.

    A later session opens the same index with the same ``path`` and ``buckets``; the bucket number is
    part of each file name, so no rewriting is needed. Batches must come one after another.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"create table {self.table} ({_SCHEMA}) using parquet options (path '{path}') "
            f"clustered by (text_sha256) sorted by (text_sha256) into {buckets} buckets"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Groups whose digest the index does not hold: a sort-merge anti-join on the buckets."""
        known = self.rows().select("text_sha256").hint("merge")
        return groups.join(known, "text_sha256", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Add groups (one row per digest, none of them in the index yet)."""
        made = groups.select("text_sha256", "keep_id", "n_points", "group_size")
        (
            made.repartition(self.buckets, "text_sha256")
            .write.mode("append")
            .option("path", self.path)
            .bucketBy(self.buckets, "text_sha256")
            .sortBy("text_sha256")
            .saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)

    def close(self) -> None:
        """Forget the name in this session; the files stay."""
        self.spark.sql(f"drop table if exists {self.table}")


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One narrow row per document: id, code points of the original text, digest."""
    body = text_or_empty(docs, text)
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.length(body).cast("bigint").alias("n_points"),
        normal_digest(body).alias("text_sha256"),
    )


def by_digest(rows: DataFrame) -> DataFrame:
    """The row that stays per digest, most code points first, then smallest id; and the group's size.

    Null ids come after all others. Partial sums run before the shuffle, so a hot digest costs one
    row per task.
    """
    place = F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id"))
    return rows.groupBy("text_sha256").agg(
        F.min_by(F.struct("doc_id", "n_points"), place).alias("_first"),
        F.count(F.lit(1)).alias("group_size"),
    ).select(
        "text_sha256", F.col("_first.doc_id").alias("keep_id"), F.col("_first.n_points").alias("n_points"), "group_size"
    )


def add_batch(index: DigestIndex, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Put a batch into the index and tell, for each of its rows, which row of its digest stays.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``; one row per input row, dropped ones
    too. Within a batch the longest original stays (then the smallest id); a text that an earlier
    batch brought keeps that batch's row, and none of the new rows is kept. ``group_size`` counts the
    rows of the batch that first brought the text. Null text counts as empty, all empty texts are
    equal, an empty batch gives no rows, and repeated ids are rows of their own of which ``kept`` is
    true for each that has the kept id. Extra columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    # Digests are read three times; written once, a lost executor costs no second pass over the texts.
    place = scratch_path(spark, "digests")
    digests(docs, text, doc_id).write.parquet(place)
    rows = spark.read.parquet(place)
    total = rows.count()
    groups_at = scratch_path(spark, "digest-groups")
    by_digest(rows).write.parquet(groups_at)
    groups = spark.read.parquet(groups_at)
    fresh_at = scratch_path(spark, "digest-fresh")
    index.unseen(groups).write.parquet(fresh_at)
    fresh = spark.read.parquet(fresh_at)
    index.append(fresh)
    here = groups.select("text_sha256", F.col("group_size").alias("_here"))
    stay = index.rows().select("text_sha256", "keep_id", "group_size")
    stay = stay.join(here, "text_sha256").join(
        fresh.select("text_sha256", F.lit(True).alias("_new")), "text_sha256", "left"
    )
    met = spread_lookup(rows, stay, ["text_sha256"], "_here", total)
    kept = F.coalesce(F.col("_new"), F.lit(False)) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return met.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``add_batch`` of one frame into a new index in the session's shared folder.

    The index gets as many buckets as the session has shuffle partitions, so it follows what the
    session was set up for.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = DigestIndex(spark, scratch_path(spark, "digest-index"), buckets)
    return add_batch(index, docs, text, doc_id)
