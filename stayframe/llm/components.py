"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stayframe.llm.spread import spread_lookup
from stayframe.session import scratch_path


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest reachable node) for every node of an edge table ``a, b``.

    Alternates two rewritings that keep components: each node's larger neighbours move to its
    smallest neighbour, then its smaller neighbours and itself do. It ends as stars after a number of
    rounds that grows with the logarithm of the size. A node of very high degree meets its smallest
    neighbour in a broadcast. Each round is written, so a lost executor repeats one round at most.
    Loops are ignored, null ends dropped, repeated edges harmless; no edges give no rows.
    """
    spark = edges.sparkSession

    def written(df: DataFrame) -> DataFrame:
        place = scratch_path(spark, "edges")
        df.write.parquet(place)
        return spark.read.parquet(place)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), "a", "b")
    now = written(ends.where("a <> b").select("u", "v").distinct())
    seen = mark(now)
    while seen[0]:
        both = written(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = _to_smallest(both, 2 * seen[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct())
        met = _to_smallest(large, large.count())
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = large.groupBy("u").agg(F.min("v").alias("v"))
        now = written(small.union(own.select("u", "v")).distinct())
        before, seen = seen, mark(now)
        if seen == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _to_smallest(pairs: DataFrame, total: int) -> DataFrame:
    """Each pair with ``m``, the smallest of ``u`` and all its ``v``."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
    return spread_lookup(pairs, least, ["u"], "degree", total).select("u", "v", "m")
