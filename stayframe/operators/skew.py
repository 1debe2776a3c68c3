"""Joins that hold when a few keys own a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DecimalType, FractionalType, IntegralType, NumericType, StringType

# A group of this many rows is split, in a table of any size up to the bound below.
HOT_ROWS = 1_000_000
# Keys that a sketch tracks, and the most that are called hot. A key with more than rows / (0.75 * TRACKED_KEYS)
# rows is surely among them, so in a table of over 12 billion rows that share takes the place of HOT_ROWS.
TRACKED_KEYS = 16_384
MOST_HOT = 4_096
# Shares of the tasks whose sketches are merged.
_MERGES = 64
# A broadcast table must also be smaller than this, as measured.
BROADCAST_BYTES = 64 * 1024 * 1024


def key_hash(cols: Sequence[str]) -> Column:
    return F.xxhash64(*cols)


def hot_keys(df: DataFrame, cols: Sequence[str], min_rows: int = HOT_ROWS) -> list[int]:
    """Hashes of the keys of at least ``min_rows`` rows, ``MOST_HOT`` at most.

    One pass over the key columns: every task keeps a sketch of its most frequent keys, of bounded size, the
    sketches of a share of the tasks are merged, and what the shares find frequent is added up. The answer only
    decides which rows take the split path; both paths give the same result, so an estimate that is off costs
    time, not rows.
    """
    keyed = df.select(key_hash(cols).alias("h"), F.pmod(F.spark_partition_id(), F.lit(_MERGES)).alias("part"))
    top = keyed.groupBy("part").agg(F.expr(f"approx_top_k(h, {MOST_HOT}, {TRACKED_KEYS})").alias("top"))
    added = top.select(F.inline("top")).groupBy("item").agg(F.sum("count").alias("n")).where(F.col("n") >= min_rows)
    return [r["item"] for r in added.orderBy(F.desc("n"), "item").limit(MOST_HOT).collect()]


def is_hot(cols: Sequence[str], hot: Sequence[int]) -> Column:
    return key_hash(cols).isin(list(hot))


def lookup(
    many: DataFrame,
    one: DataFrame,
    on: Sequence[str],
    how: str = "left",
    *,
    null_safe: bool = False,
    broadcast_rows: int = 0,
    probe: DataFrame | None = None,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join rows to a table that has one row per key (any number for a semi join).

    A table of at most ``broadcast_rows`` rows and 64 MB (measured, not assumed) is broadcast.
    Otherwise rows of hot keys meet a broadcast of only those keys, ``MOST_HOT`` rows since keys are unique
    (measured too: if they are not, the join shuffles), and all others take the ordinary shuffle join.
    ``probe`` names a cheaper frame with the same key columns to look for hot keys in.
    Keys of different types are compared as Spark's own join compares them; a text that is no value of the other type
    is like null instead of an error.
    """
    on = list(on)
    apart = [c for c in on if one.schema[c].dataType != many.schema[c].dataType]
    if apart:
        wide = {c: _compared(many.sparkSession, many.schema[c].dataType, one.schema[c].dataType) for c in apart}
        own = {f"_wide_{c}": F.col(c).try_cast(t) for c, t in wide.items()}
        many, one = many.withColumns(own), one.withColumns(own).drop(*apart)
        probe = None if probe is None else probe.withColumns(own)
        keys = [f"_wide_{c}" if c in wide else c for c in on]
        met = lookup(
            many, one, keys, how, null_safe=null_safe, broadcast_rows=broadcast_rows, probe=probe, min_rows=min_rows
        )
        return met.drop(*own)
    if broadcast_rows and is_small(one, broadcast_rows):
        return _join(many, F.broadcast(one), on, how, null_safe)
    hot = hot_keys(probe if probe is not None else many, on, min_rows)
    if not hot:
        return _join(many, one, on, how, null_safe)
    busy = is_hot(on, hot)
    few = one.where(busy)
    if how == "left_semi":
        few = few.select(*on).distinct()
    if is_small(few, HOT_BROADCAST_ROWS):
        few = F.broadcast(few)
    return _join(many.where(~busy), one.where(~busy), on, how, null_safe).unionByName(
        _join(many.where(busy), few, on, how, null_safe)
    )


# Rows of hot keys that may be broadcast.
HOT_BROADCAST_ROWS = 4 * MOST_HOT


def _compared(spark: SparkSession, a: DataType, b: DataType) -> str:
    """The type in which Spark compares values of two types for equality."""
    if isinstance(a, StringType) != isinstance(b, StringType):
        other = b if isinstance(a, StringType) else a
        # A text meets a whole number as BIGINT, another number as DOUBLE, and a date or time as such.
        return "bigint" if isinstance(other, IntegralType) else "double" if isinstance(other, NumericType) else other.simpleString()
    if isinstance(a, NumericType) and isinstance(b, NumericType) and (isinstance(a, FractionalType) and not isinstance(a, DecimalType)) != (
        isinstance(b, FractionalType) and not isinstance(b, DecimalType)
    ):
        return "double"
    both = spark.range(0).select(F.coalesce(F.lit(None).cast(a), F.lit(None).cast(b)).alias("both"))
    return both.schema["both"].dataType.simpleString()


def row_bytes(df: DataFrame) -> Column:
    """About the bytes that a row takes in memory."""
    width = F.lit(0).cast("bigint")
    for field in df.schema:
        kind = field.dataType
        if isinstance(kind, ArrayType):
            width = width + 8 * F.greatest(F.size(field.name), F.lit(0))
        elif isinstance(kind, (StringType, BinaryType)):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
        width = width + 16
    return width


def is_small(df: DataFrame, max_rows: int) -> bool:
    """Measure rows and bytes; a table with too many rows is not read to its end."""
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    return rows <= max_rows and size <= BROADCAST_BYTES


def fan_out(one: DataFrame, many: DataFrame, on: Sequence[str], min_rows: int = HOT_ROWS) -> DataFrame:
    """Left join of a table with one row per key to one with any number, even very many for a key.

    The one row of a hot key is broadcast to the many: ``MOST_HOT`` rows since keys are unique, and measured.
    """
    on = list(on)
    hot = hot_keys(many, on, min_rows)
    if not hot:
        return one.join(many, on, "left")
    busy = is_hot(on, hot)
    few, crowd = one.where(busy), many.where(busy)
    met = crowd.join(F.broadcast(few) if is_small(few, HOT_BROADCAST_ROWS) else few, on).select(*on, *[c for c in one.columns + many.columns if c not in on])
    alone = few.join(crowd.select(*on).distinct(), on, "left_anti")
    usual = one.where(~busy).join(many.where(~busy), on, "left")
    return usual.unionByName(met).unionByName(alone, allowMissingColumns=True)


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str, null_safe: bool) -> DataFrame:
    if not null_safe:
        return left.join(right, on, how)
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    match = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on]
    joined = left.join(renamed, match, how)
    return joined.drop(*[f"_right_{c}" for c in on])
