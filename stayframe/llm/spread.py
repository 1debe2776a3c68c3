"""Joins to a table with one row per key that hold when a few keys own most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# More than 1 / HOT_KEYS of the rows makes a key hot, so there are fewer than HOT_KEYS of them.
HOT_KEYS = 1_000


def hot_sizes(sizes: DataFrame, size: str, total: int) -> DataFrame:
    """Rows of a key-size table whose key owns more than 1 / HOT_KEYS of ``total`` rows.

    Fewer than ``HOT_KEYS`` keys can, whatever the data, so this table may be broadcast, and a key
    that stays out of it has at most ``total / HOT_KEYS`` rows for one task.
    """
    return sizes.where(F.col(size) * HOT_KEYS > F.lit(total))


def spread_lookup(many: DataFrame, one: DataFrame, on: Sequence[str], size: str, total: int) -> DataFrame:
    """Left join of rows to a table with one row per key that also says how many rows each key has.

    ``one[size]`` counts the rows of ``many`` per key and ``total`` all of them. Hot keys (fewer
    than ``HOT_KEYS`` by arithmetic) meet their row in a broadcast, all others in a shuffle. Keys
    must not be null. A key without a row in ``one`` gets nulls. ``many`` is read twice, so hand in
    something written, or cheap to read.
    """
    on = list(on)
    hot = hot_sizes(one, size, total)
    marked = many.join(F.broadcast(hot.select(*on, F.lit(True).alias("_hot"))), on, "left")
    busy = marked.where("_hot").drop("_hot").join(F.broadcast(hot), on, "left")
    rest = marked.where("_hot is null").drop("_hot").join(one, on, "left")
    return busy.unionByName(rest)


def text_or_empty(df: DataFrame, column: str) -> Column:
    """The column as text, null as the empty text; a column of any other type is cast."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


# Bits of the filter below, as one megabyte.
FILTER_BITS = 1 << 23


def keep_likely(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key may be among ``wanted[key]``: all that are, and some that are not.

    A filter of hashed keys, one megabyte whatever the data, thins wide rows before a join moves them.
    With very many wanted keys it lets most rows through, and the join that follows is still right.
    """
    def place(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)) + 1

    bits = wanted.select(place(key).alias("_at"))
    filters = bits.groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits")
    )
    met = df.withColumn("_at", place(key)).withColumn("_bucket", F.bitmap_bucket_number("_at"))
    met = met.join(F.broadcast(filters), "_bucket")
    bit = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    return met.where(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1).select(*df.columns)
