"""The first n rows of every group, also where n is large and a group is huge."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stayframe.operators.skew import HOT_ROWS, hot_keys, is_hot

# Up to this many, Spark itself keeps no more than n rows of a group on both sides of the shuffle.
PLAIN_N = 1_000
ROWS_PER_SLICE = 250_000


def _numbered(df: DataFrame, by: Sequence[str | Column], order: Sequence[Column], n: int, out: str) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= n)


def first_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column | str],
    n: int,
    out: str = "rank",
    *,
    plain_n: int = PLAIN_N,
    min_rows: int = HOT_ROWS,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Rows numbered 1 .. n in ``out``, per ``by`` along ``order``, which must be total within a group.

    For larger n than Spark prunes by itself, huge groups are dealt by a hash of their rows into slices;
    each slice keeps its first n, slices merge as long as they are more than one task should hold,
    and the last numbering sees what they kept. ``order`` holds columns of ``df``, ascending, or their ``desc`` forms.
    """
    by, order = list(by), [F.col(c) if isinstance(c, str) else c for c in order]
    if n > plain_n:
        hot = hot_keys(df, by, min_rows)
        if hot:
            busy = is_hot(by, hot)
            crowd = df.where(busy)
            df = df.where(~busy).unionByName(_thinned(crowd, by, order, n, crowd.count(), rows_per_slice))
    return _numbered(df, by, order, n, out)


def _thinned(df: DataFrame, by: list[str], order: list[Column], n: int, most: int, rows_per_slice: int) -> DataFrame:
    """All rows that can be among the first n, and of each group a bounded number of others; ``most`` bounds a group."""
    plain = [c for c in df.columns if c not in by]
    slices = math.ceil(most / rows_per_slice)
    while slices > 1:
        slice_ = F.pmod(F.xxhash64(*plain), F.lit(slices))
        df = _numbered(df.withColumn("_slice", slice_), [*by, "_slice"], order, n, "_n").drop("_slice", "_n")
        # Halving at least: slices that keep all they have must still meet.
        slices = min(math.ceil(slices * n / rows_per_slice), slices // 2)
    return df
