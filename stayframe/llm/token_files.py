"""Token ids of documents in binary files of word-aligned blocks, in ascending id of the document.

A file is a run of blocks. Everything in a block is a little-endian 64-bit word:

    magic, partition, block, documents, ids, units, words, escapes, ids before it in its partition
    document ids | 1 where the document id is null | ids per document
    first word of each unit, and the end | words | escapes

and an 8-byte end mark follows. The words are those of ``simple8b``, which start anew at every unit,
so any run of ids can be decoded without what stands before it. Files are made by Spark's text
writer, as raw bytes, with the end mark as its line separator: tasks commit or leave nothing, and any
file system that Spark can write to will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stayframe.llm import simple8b
from stayframe.llm.spread import text_or_empty
from stayframe.llm.word_tokens import encode_column

MAGIC = int.from_bytes(b"TOKENS01", "little")
END_MARK = "\r\nEND8\r\n"
HEADER = 9
# A block is closed when it has this many ids; a longer document makes a longer block.
BLOCK_IDS = 250_000
# A file ends after so many blocks, so that a reader's task has a bounded file to hold.
FILE_BLOCKS = 96


def pack_block(partition: int, block: int, before: int, keys: list, counts: list[int], ids: np.ndarray) -> bytes:
    words, offsets, escapes = simple8b.encode(ids)
    head = [MAGIC, partition, block, len(keys), len(ids), len(offsets) - 1, len(words), len(escapes), before]
    parts = [
        np.array(head, "<u8"),
        np.array([k or 0 for k in keys], "<i8"),
        np.array([k is None for k in keys], "<i8"),
        np.array(counts, "<i8"),
        offsets.astype("<i8"),
        words.astype("<u8"),
        escapes.astype("<u8"),
    ]
    return b"".join(p.tobytes() for p in parts)


def read_blocks(content: bytes) -> Iterator[tuple[np.ndarray, list, np.ndarray, np.ndarray]]:
    """Header, document ids (null as None), ids per document and all ids of each block of a file."""
    at = 0
    while at < len(content):
        head = np.frombuffer(content, "<i8", HEADER, at)
        _, _, _, docs, _, units, words, escapes, _ = head.tolist()
        if int(head[0]) != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += 8 * HEADER
        fields = []
        for kind, size in (("<i8", docs), ("<i8", docs), ("<i8", docs), ("<i8", units + 1), ("<u8", words), ("<u8", escapes)):
            fields.append(np.frombuffer(content, kind, size, at))
            at += 8 * size
        if content[at : at + len(END_MARK)] != END_MARK.encode():
            raise ValueError(f"no end mark at byte {at}")
        at += len(END_MARK)
        keys, missing, counts, _, packed, wide = fields
        named = [None if m else k for k, m in zip(keys.tolist(), missing.tolist(), strict=True)]
        yield head, named, counts, simple8b.decode(packed, wide)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, *, partitions: int | None = None,
    block_ids: int = BLOCK_IDS, text: str = "text", doc_id: str = "doc_id",
) -> None:
    """Encode whole texts, append ``end_id`` to each, and write them in ascending document id.

    Partitions are ranges of the id, the session's shuffle partitions unless said otherwise. A null
    text counts as empty (its end id alone), null ids come first, repeated ids follow each other,
    and no rows make no blocks. Extra columns are ignored.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), text_or_empty(docs, text).alias("text"))
    # The text settles the order of repeated ids, so that a second run of a task writes the same.
    ranged = rows.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        keys, counts, parts, held, block, before = [], [], [], 0, 0, 0

        def close():
            ids = np.frombuffer(b"".join(parts), "<u4").astype(np.uint64)
            packed = pack_block(partition, block, before, keys, counts, ids)
            return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["value"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, ids in encode_column(tokenizer, batch.column(1)):
                keys.append(names[i])
                counts.append(len(ids) // 4 + 1)
                parts += [ids, end]
                held += counts[-1]
                if held >= block_ids:
                    yield close()
                    block, before = block + 1, before + held
                    keys, counts, parts, held = [], [], [], 0
        if keys:
            yield close()

    made = ranged.mapInArrow(blocks, "value binary").select(F.col("value").cast("string").alias("value"))
    made.write.option("lineSep", END_MARK).option("maxRecordsPerFile", FILE_BLOCKS).text(path)


_DOCUMENTS = "doc_id bigint, partition bigint, before bigint, n_tokens bigint"


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """What the files hold: ``doc_id, start, n_tokens, ids_crc32``, and ``ids`` unless left out.

    ``start`` counts the ids of all documents before this one over all files. Only the partitions'
    totals, one number for each, meet in one task.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for head, keys, counts, ids in read_blocks(content.as_py()):
                    raw = ids.astype("<u4")
                    ends = np.cumsum(counts)
                    crc = [zlib.crc32(raw[e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                    made = [
                        pa.array(keys, pa.int64()),
                        pa.array(np.full(len(keys), head[1])),
                        pa.array(head[8] + ends - counts),
                        pa.array(counts),
                        pa.array(crc, pa.int64()),
                    ]
                    names = ["doc_id", "partition", "before", "n_tokens", "ids_crc32"]
                    if with_ids:
                        places = pa.array(np.append(0, ends).astype(np.int32))
                        made.append(pa.ListArray.from_arrays(places, pa.array(raw.astype(np.int64))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(made, names)

    kind = _DOCUMENTS + ", ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    found = files.mapInArrow(unpack, kind)
    # A block tells what stands before it in its partition, so the last one's end is the total.
    narrow = _headers(spark, path)
    totals = narrow.groupBy("partition").agg(F.max(F.col("before") + F.col("n_ids")).alias("total"))
    along = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("partition", F.coalesce(F.sum("total").over(along), F.lit(0)).alias("base"))
    joined = found.join(F.broadcast(bases), "partition")
    return joined.withColumn("start", F.col("base") + F.col("before")).drop("partition", "base", "before")


def _headers(spark: SparkSession, path: str) -> DataFrame:
    """``partition, before, n_ids`` of each block, without decoding."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw, at, found = content.as_buffer(), 0, []
                while at < len(raw):
                    head = np.frombuffer(raw, "<i8", HEADER, at)
                    found.append(head[[1, 8, 4]])
                    size = HEADER + 3 * head[3] + head[5] + 1 + head[6] + head[7]
                    at += 8 * int(size) + len(END_MARK)
                cols = np.array(found, np.int64).reshape(-1, 3).T
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["partition", "before", "n_ids"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(heads, "partition bigint, before bigint, n_ids bigint")
