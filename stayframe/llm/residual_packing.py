"""Documents packed into as few windows as possible: best fit in tasks, residues merged up a tree.

Every task packs its pieces by best fit and closes the windows that are full or nearly so. The windows
left with room are items of the next round, in which a task takes those of several earlier tasks and
joins whole windows, again by best fit, until one task holds all of them or nothing joins any more. A
round moves window numbers and fill levels only, and what is left shrinks from round to round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stayframe.llm.packing import pieces
from stayframe.session import scratch_path

WINDOW = 4096
# Items that a task packs at once; a task with more packs them in several goes.
GROUP = 100_000
# A window is nearly full when one part in so many is free, or less.
SLACK = 256


class Residues:
    """Open windows by free space; a bit set of the sizes there are finds the tightest that fits."""

    def __init__(self, window: int):
        self._open: list[list[int]] = [[] for _ in range(window + 1)]
        self._sizes = 0

    def put(self, free: int, number: int) -> None:
        self._open[free].append(number)
        self._sizes |= 1 << free

    def take(self, length: int) -> tuple[int, int] | None:
        """A window with the least free space of at least ``length``, and that space."""
        fitting = self._sizes >> length
        if not fitting:
            return None
        free = length + (fitting & -fitting).bit_length() - 1
        number = self._open[free].pop()
        if not self._open[free]:
            self._sizes ^= 1 << free
        return number, free


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number, from 0, and place there of each item of 1 to ``window``; longest items first."""
    number, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    residues, made = Residues(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = residues.take(length)
        if found is None:
            found, made = (made, window), made + 1
        number[i], free = found
        place[i] = window - free
        if free > length:
            residues.put(free - length, int(number[i]))
    return number, place


def _goes(batches: Iterator[pa.RecordBatch], group: int) -> Iterator[pa.Table]:
    """A task's rows, about ``group`` at a time."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= group:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _with(table: pa.Table, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for name, values in columns.items():
        table = table.append_column(name, pa.array(values, pa.int64()))
    return iter(table.to_batches())


def _first_round(made: DataFrame, length: str, window: int, group: int, tasks: int) -> DataFrame:
    """All pieces in windows numbered over all tasks: ``_bin, _place, _used, _node``."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId()
        begin = node << 36
        for table in _goes(batches, group):
            lengths = table.column(length).to_numpy()
            number, place = best_fit(lengths, window)
            used = np.bincount(number, weights=lengths).astype(np.int64)
            yield from _with(table, _bin=begin + number, _place=place, _used=used[number], _node=np.full(len(number), node))
            begin += len(used)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema)
    dealt = made.repartition(tasks)  # evenly and without a key, so no id and no length is hot
    return dealt.mapInArrow(fill, f"{schema}, _bin bigint, _place bigint, _used bigint, _node bigint")


def _next_round(left: DataFrame, window: int, group: int, nodes: int, tasks: int) -> DataFrame:
    """Windows ``_bin, _used, _node`` joined into others: ``_root, _shift, _sum``; a root is one of them."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _goes(batches, group):
            used = table.column("_used").to_numpy()
            number, shift = best_fit(used, window)
            root, total = np.zeros(len(used), np.int64), np.bincount(number, weights=used).astype(np.int64)
            first = shift == 0
            root[number[first]] = table.column("_bin").to_numpy()[first]
            yield from _with(table, _root=root[number], _shift=shift, _sum=total[number])

    parent = F.floor(F.col("_node") * tasks / nodes).cast("bigint").alias("_node")
    dealt = left.select("_bin", "_used", parent).repartition(tasks, "_node")
    return dealt.mapInArrow(fill, "_bin bigint, _used bigint, _node bigint, _root bigint, _shift bigint, _sum bigint")


def pack(made: DataFrame, *, window: int = WINDOW, group: int = GROUP, slack: int = SLACK) -> DataFrame:
    """Every row of ``made`` with the ``sequence_id`` it goes to and its ``offset`` there.

    ``made.length`` is from 1 to ``window``; rows are never cut, and repeated rows are rows of their own. Sequences
    are numbered with gaps and filled without any. ``made`` is read twice, so hand in something written. No rows
    give no rows; other columns stay, whatever their names.
    """
    spark = made.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        place = scratch_path(spark, name)
        df.write.parquet(place)
        return spark.read.parquet(place)

    def tasks_for(rows: int) -> int:
        return max(1, -(-rows // group))

    nodes = tasks_for(made.count())
    plain = made.toDF(*[f"_c{i}" for i in range(len(made.columns))])
    first = written(_first_round(plain, plain.columns[made.columns.index("length")], window, group, nodes), "packed")
    least = window - window // slack  # fuller windows are closed
    left = first.where((F.col("_place") == 0) & (F.col("_used") < least)).select("_bin", "_used", "_node")
    moves = None
    while nodes > 1:
        # At least two nodes meet in one, so this ends.
        tasks = max(1, min(tasks_for(left.count()), nodes // 2))
        joined = written(_next_round(left, window, group, nodes, tasks), "residues")
        moved = joined.where("_shift > 0").select("_bin", "_root", "_shift")
        if moves is None:
            moves = moved
        else:
            later = moved.toDF("_root", "_later", "_more")
            moves = moves.join(later, "_root", "left").select(
                "_bin", F.coalesce("_later", "_root").alias("_root"), (F.col("_shift") + F.coalesce("_more", F.lit(0))).alias("_shift")
            ).unionByName(moved)
        moves = written(moves, "moves")
        left = joined.where((F.col("_shift") == 0) & (F.col("_sum") < least)).select("_bin", F.col("_sum").alias("_used"), "_node")
        nodes = tasks
    named = [F.col(c).alias(name) for c, name in zip(plain.columns, made.columns, strict=True)]
    closed = first if moves is None else first.where(F.col("_used") >= least)
    out = closed.select(*named, F.col("_bin").alias("sequence_id"), F.col("_place").alias("offset"))
    if moves is None:
        return out
    met = first.where(F.col("_used") < least).join(moves, "_bin", "left")
    place = F.col("_place") + F.coalesce("_shift", F.lit(0))
    return out.unionByName(met.select(*named, F.coalesce("_root", "_bin").alias("sequence_id"), place.alias("offset")))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, *, window: int = WINDOW, group: int = GROUP, **names) -> DataFrame:
    """Pieces of all documents: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, with ``ids`` if asked for.

    A document's ids and its end id are one piece, or, if longer than ``window``, whole windows and a rest. A null
    or empty text is its end id alone; null ids stay null; repeated rows are documents of their own; no rows give
    no rows; extra columns are ignored.
    """
    place = scratch_path(docs.sparkSession, "pieces")
    pieces(docs, tokenizer, end_id, window=window, **names).write.parquet(place)
    made = docs.sparkSession.read.parquet(place)
    number = F.floor(F.col("start") / window).cast("int").alias("piece")
    rest = [c for c in made.columns if c not in ("doc_id", "doc_tokens")]
    return pack(made.select("doc_id", number, *rest), window=window, group=group)
