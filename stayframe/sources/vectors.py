"""The code-vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stayframe.functions.arrays import zero_vector
from stayframe.operators.ordered import number_rows
from stayframe.operators.sequence import PAD_CODE


def embedding_table(vectors: DataFrame, dim: int = 10, pad_code: int = PAD_CODE) -> DataFrame:
    """(code, position, v): vectors in code order from position 0, the zero pad row last."""
    real = vectors.select(F.col("code").cast("bigint").alias("code"), F.col("v").cast("array<float>").alias("v"))
    numbered = number_rows(real, ["code"], "_n").select("code", (F.col("_n") - 1).alias("position"), "v")
    pad = real.agg(F.count(F.lit(1)).alias("position")).select(
        F.lit(pad_code).cast("bigint").alias("code"), "position", zero_vector(dim).alias("v")
    )
    return numbered.unionByName(pad)
