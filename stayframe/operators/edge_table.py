"""A persistent edge table that takes in new quarters without moving the old edges."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

KEY = ["id1", "id2"]


class EdgeTable:
    """Edge weights bucketed and sorted by (id1, id2), in numbered versions of a catalog table.

    A merge reads the newest version bucket by bucket, meets the new edges by a sort-merge join and writes the
    next version in the same buckets: only the new edges are shuffled. A reader keeps the version it began
    with; one that a failed merge left half written is never read, as it gets no place in the list.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"not a table name: {name}")
        self.spark, self.name = spark, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    @property
    def _list(self) -> str:
        return f"{self.name}_versions"

    def versions(self) -> list[str]:
        """Tables of all whole versions, oldest first."""
        if not self.spark.catalog.tableExists(self._list):
            return []
        return [r["table"] for r in self.spark.table(self._list).orderBy("number").collect()]

    def edges(self, version: int = -1) -> DataFrame:
        """(id1, id2, weight) of a version, the newest by default; nothing before the first merge."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], "id1 bigint, id2 bigint, weight bigint")
        return self.spark.table(known[version])

    def merged(self, new: DataFrame) -> DataFrame:
        """The newest edges and ``new`` ones added up; an edge missing on a side counts 0 there."""
        added = new.groupBy(*KEY).agg(F.sum("weight").alias("_added"))
        if not self.versions():
            return added.withColumnRenamed("_added", "weight")
        # Dealt as the table is, so the join finds both sides in place.
        met = self.edges().join(added.repartition(self.buckets, *KEY), KEY, "full")
        weight = F.coalesce("weight", F.lit(0)) + F.coalesce("_added", F.lit(0))
        return met.select(*KEY, weight.cast("bigint").alias("weight"))

    def merge(self, new: DataFrame) -> DataFrame:
        """Take in the edges of a new quarter (id1, id2, weight; repeated edges add up) and return all edges."""
        known = self.versions()
        table = f"{self.name}_{uuid.uuid4().hex[:12]}"
        out = self.merged(new)
        if not known:
            out = out.repartition(self.buckets, *KEY)
        out.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(table)
        entry = self.spark.createDataFrame([(len(known), table)], "number int, table string")
        entry.coalesce(1).write.mode("append").saveAsTable(self._list)
        return self.edges()
