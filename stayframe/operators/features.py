"""Stay attributes as index, one-hot and assembled feature vectors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

# What is known of the patient, and what is known at admission.
DEMOGRAPHICS = ["age", "gender", "race", "hispanic_ind", "mart_status"]
ADMISSION = [
    "adm_mon", "adm_source", "point_of_origin", "adm_type", "std_payor", "prov_id",
    "admphy_spec", "adm_phy", "attphy_spec", "att_phy",
]
TIERS = {
    "demographics": DEMOGRAPHICS,
    "admission": DEMOGRAPHICS + ADMISSION,
    "first_day": DEMOGRAPHICS + ADMISSION + ["embedding"],
}
CATEGORIES = ["gender", "race", "hispanic_ind", "mart_status", "adm_source", "point_of_origin", "adm_type", "std_payor"]
NUMBERS = ["age"]


def feature_tier(df: DataFrame, tier: str, key: str = "pat_key") -> DataFrame:
    """The columns a model of the tier may see: each tier adds to the one before."""
    return df.select(key, *TIERS[tier])


def category_index(df: DataFrame, cats: Sequence[str]) -> DataFrame:
    """(name, value, idx, n): categories of each column by frequency, ties by value.

    The window runs over distinct categories, of which a feature vector can hold but few.
    """
    named = [F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in cats]
    long = df.select(F.explode(F.array(*named)).alias("c")).select("c.name", "c.value")
    counted = long.where(F.col("value").isNotNull()).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    window = Window.partitionBy("name").orderBy(F.desc("n"), "value")
    return counted.withColumn("idx", (F.row_number().over(window) - 1).cast("bigint"))


def fit_features(df: DataFrame, cats: Sequence[str] = CATEGORIES, nums: Sequence[str] = NUMBERS) -> PipelineModel:
    """Fit index, one-hot and assembly of ``features``; unseen values get no one."""
    texts = as_text(df, cats)
    indexer = StringIndexer(
        inputCols=list(cats), outputCols=[f"_{c}_index" for c in cats], handleInvalid="keep"
    )
    encoder = OneHotEncoder(inputCols=indexer.getOutputCols(), outputCols=[f"_{c}_hot" for c in cats])
    assembler = VectorAssembler(
        inputCols=[*encoder.getOutputCols(), *nums], outputCol="features", handleInvalid="keep"
    )
    return Pipeline(stages=[indexer, encoder, assembler]).fit(texts)


def apply_features(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``features`` to the stays."""
    cats = model.stages[0].getInputCols()
    made = model.transform(as_text(df, cats))
    return made.drop(*model.stages[0].getOutputCols(), *model.stages[1].getOutputCols())


def as_text(df: DataFrame, cats: Sequence[str]) -> DataFrame:
    return reduce(lambda d, c: d.withColumn(c, F.col(c).cast("string")), cats, df)
