"""A number of its own for every row of a table whose ids may be null or repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stayframe.llm.spread import spread_lookup
from stayframe.session import scratch_path


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or with as many underscores more as it takes to clash with no column, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def with_row_key(docs: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` with a key column, and its name: the id where no other row has it, and else a number of the row's own.

    These numbers lie above all ids, so the rows rank behind those whose id is theirs alone. Rows without one
    are written out with their numbers, so the keys are the same whenever the frame is read. Usually there
    are none, and the key costs a count of the ids.
    """
    spark, key = docs.sparkSession, free_name(docs, "row_key")
    number = F.col(f"`{doc_id}`").cast("bigint")
    ids = docs.select(number.alias("id"))
    counted = ids.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    place = scratch_path(spark, "repeated-ids")
    counted.write.parquet(place)
    repeated = spark.read.parquet(place)
    alone = docs.withColumn(key, number)
    nulls = docs.where(number.isNull())
    if repeated.isEmpty():
        if nulls.isEmpty():
            return alone, key
        odd, alone = nulls, alone.where(F.col(key).isNotNull())
    else:
        # Within a struct, so that columns of any name go through the join.
        whole = docs.select(number.alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        known = spread_lookup(whole.where("id is not null"), repeated, ["id"], "n", docs.count())
        odd = known.where("n is not null").select("row.*").unionByName(nulls)
        alone = known.where("n is null").select("row.*", F.col("id").alias(key))
    above = ids.agg(F.max("id")).first()[0] or 0
    at = scratch_path(spark, "odd-rows")
    odd.withColumn(key, F.lit(above + 1) + F.monotonically_increasing_id()).write.parquet(at)
    return alone.unionByName(spark.read.parquet(at)), key


def without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose key is in the first column of ``gone``, and without the key."""
    other = gone.toDF(free_name(docs, f"{key}_gone"))
    left = docs.join(other, F.col(f"`{key}`") == F.col(f"`{other.columns[0]}`"), "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns if c != key])
