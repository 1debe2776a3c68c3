"""Folds, splits, interleaving and batches, all from key hashes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from stayframe.functions.hashing import HASH_BITS, draw_chunk, key_draw
from stayframe.operators.ordered import CHUNK, scan

# Which of the ten folds serves what.
TRAIN_FOLDS = list(range(8))
VALIDATION_FOLDS = [8]
TEST_FOLDS = [9]
# Order of rows in the exported table.
ORDER_SEED = 1


def assign_fold(df: DataFrame, key: str = "pat_key", n: int = 10, seed: int = 42) -> DataFrame:
    """Add ``fold`` in 0..n-1 from the key; a stay is always in the same fold."""
    return df.withColumn("fold", F.pmod(key_draw(seed, key), F.lit(n)).cast("int"))


def with_role(df: DataFrame) -> DataFrame:
    """Add ``role``: train, validation or test."""
    fold = F.col("fold")
    role = F.when(fold.isin(TRAIN_FOLDS), "train").when(fold.isin(VALIDATION_FOLDS), "validation")
    return df.withColumn("role", role.when(fold.isin(TEST_FOLDS), "test"))


def split(df: DataFrame) -> dict[str, DataFrame]:
    """The three parts of a table with a ``fold`` column."""
    parts = {"train": TRAIN_FOLDS, "validation": VALIDATION_FOLDS, "test": TEST_FOLDS}
    return {role: df.where(F.col("fold").isin(folds)) for role, folds in parts.items()}


def shuffle_rows(
    df: DataFrame, key: str = "pat_key", seed: int = ORDER_SEED, files: int | None = None, folds: int = 10
) -> DataFrame:
    """Rows of each fold in random but repeatable order, in partitions of even size.

    Draws are uniform, so equal slices of their range are equal shares of a fold. Each slice is one
    partition: a write by fold makes one file per task, and file names follow the random order.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = files or max(1, math.ceil(partitions / folds))
    drawn = df.withColumn("_draw", key_draw(seed, key))
    slot = F.shiftright(F.col("_draw") * F.lit(files), HASH_BITS)
    place = F.pmod(F.col("fold") * F.lit(files) + slot, F.lit(folds * files)).cast("int")
    return drawn.repartitionById(folds * files, place).sortWithinPartitions("fold", "_draw", key).drop("_draw")


def number_by_draw(df: DataFrame, by: Sequence[str], key: str, seed: int, out: str) -> DataFrame:
    """1, 2, 3 … in random order within each ``by``; a group is never in one task.

    The draws are uniform, so slices of the draw range are chunks of even size.
    """
    drawn = df.withColumn("_draw", key_draw(seed, *by, key))
    chunked = drawn.withColumn(CHUNK, draw_chunk(F.col("_draw")))
    return scan(chunked, by, ["_draw", key], sums={out: F.lit(1).cast("bigint")}).drop("_draw")


def mix(dfs: Sequence[DataFrame], key: str = "pat_key", seed: int = 1) -> DataFrame:
    """Interleave datasets so that each gives one row per turn while it lasts.

    Adds ``source`` and ``turn``; rows come out by turn. Every row appears once.
    """
    tagged = [df.withColumn("source", F.lit(i)) for i, df in enumerate(dfs)]
    return interleave(reduce(DataFrame.unionByName, tagged), "source", key, seed)


def interleave(df: DataFrame, source: str, key: str = "pat_key", seed: int = 1) -> DataFrame:
    """``mix`` for sources that are already one frame."""
    numbered = number_by_draw(df, [source], key, seed, "turn")
    return numbered.orderBy("turn", key_draw(seed, source, key), source)


def with_batch_id(
    df: DataFrame, size: int, by: Sequence[str] = ("fold",), key: str = "pat_key", seed: int = 1
) -> DataFrame:
    """Add ``batch``: 0, 1, 2 … of ``size`` rows each, in random order within ``by``."""
    numbered = number_by_draw(df, list(by), key, seed, "_n")
    return numbered.withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("bigint")).drop("_n")
