"""Documents packed into training windows by best-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stayframe.llm.spread import text_or_empty
from stayframe.llm.word_tokens import encode_column
from stayframe.session import scratch_path

WINDOW = 2048
# Pieces that one task packs together; the loss is about one open window per group.
GROUP = 50_000


class TightestFit:
    """Open windows by remaining capacity, under a segment tree that finds the tightest one that fits."""

    def __init__(self, window: int):
        self._leaves = 1
        while self._leaves <= window:
            self._leaves *= 2
        self._tree = [0] * (2 * self._leaves)
        self._open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = self._leaves + capacity
        while node:
            self._tree[node] += by
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        self._open[capacity].append(window)
        self._add(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The open window with the least capacity of at least ``length``, and that capacity."""
        tree, node = self._tree, self._leaves + length
        if not tree[node]:
            # Up to the first subtree further right that holds a window, then down its left edge.
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self._leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        capacity = node - self._leaves
        self._add(capacity, -1)
        return self._open[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; pieces are taken longest first, ties as they come."""
    where = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    fit, made = TightestFit(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = fit.take(length)
        if found is None:
            found, made = (made, window), made + 1
        where[i], capacity = found
        offset[i] = window - capacity
        if capacity > length:
            fit.put(capacity - length, int(where[i]))
    return where, offset


_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    *,
    window: int = WINDOW,
    with_ids: bool = False,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Each document's ids with the end id, cut into full windows and a rest of 1 to ``window`` ids.

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens``, with ``ids`` if asked for.
    A null or empty text is its end id alone. Repeated rows are documents of their own, null ids stay
    null, no rows give no rows. Extra columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            cols: list[list] = [[], [], [], [], [], []]
            for i, ids in encode_column(tokenizer, batch.column(1)):
                ids += end
                for a in range(0, len(ids), 4 * window):
                    part = ids[a : a + 4 * window]
                    row = (keys[i], a // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part)
                    for col, value in zip(cols, row, strict=True):
                        col.append(value)
            made = [pa.array(c, pa.int64()) for c in cols[:5]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                flat = pa.array(np.frombuffer(b"".join(cols[5]), "<u4").astype(np.int32))
                ends = np.cumsum([0, *cols[2]]).astype(np.int32)
                made.append(pa.ListArray.from_arrays(pa.array(ends), flat))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(made, names)

    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), text_or_empty(docs, text).alias("text"))
    return rows.mapInArrow(cut, _PIECES + (", ids array<int>" if with_ids else ""))


def pack(made: DataFrame, *, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Give every piece a ``sequence_id`` and its ``offset`` there.

    A full piece is a sequence by itself. The rests are dealt at random into groups of about ``group``
    pieces and packed group by group, so a task never holds more, whatever the table's size. Ids are
    unique, not consecutive. ``made`` is read twice: hand in something written.
    """
    full = made.where(F.col("length") >= window)
    rest = made.where(F.col("length") < window)
    groups = max(1, -(-rest.count() // group))
    alone = full.withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("bigint"))
    # Row numbers of written rows: the same after a lost task, different for repeated rows.
    number = F.monotonically_increasing_id()
    dealt = rest.withColumn("_group", F.pmod(F.xxhash64(number, "doc_id"), F.lit(groups)).cast("bigint"))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        where, offset = best_fit_decreasing(table.column("length").to_numpy(), window)
        number = 2 * (where * groups + table.column("_group").to_numpy())
        table = table.append_column("sequence_id", pa.array(number))
        return table.append_column("offset", pa.array(offset)).drop_columns(["_group"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
    packed = dealt.groupBy("_group").applyInArrow(fill, f"{schema}, sequence_id bigint, offset bigint")
    return alone.unionByName(packed)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, *, window: int = WINDOW, **names) -> DataFrame:
    """``pieces`` written once to the shared folder, then packed; see both for what odd input gives."""
    place = scratch_path(docs.sparkSession, "pieces")
    pieces(docs, tokenizer, end_id, window=window, **names).write.parquet(place)
    return pack(docs.sparkSession.read.parquet(place), window=window)


def sequences(packed: DataFrame, pad_id: int, *, window: int = WINDOW) -> DataFrame:
    """The windows themselves: ``sequence_id, ids, used``, padded unless ``used`` is a power of two.

    ``packed`` must carry ``ids``; a window is at most ``window`` pieces of one id or more.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grown = packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    used = F.size("ids")
    missing = F.when(F.bit_count(used) == 1, 0).otherwise(window - used)
    return grown.select(
        "sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), missing)).alias("ids"), used.alias("used")
    )
