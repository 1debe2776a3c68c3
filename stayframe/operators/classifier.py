"""Binary outcome classifiers on stay features and the pooled event sequence."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from stayframe.functions.arrays import mean_pool

# Sizes of the hidden layers.
HIDDEN = [256, 128]


def model_inputs(df: DataFrame, label: str, n: int = 100, dim: int = 10) -> DataFrame:
    """(pat_key, label, static, pooled) from a stay table; ``fold`` is kept where there is one.

    A ``pooled`` column of the table (the mean over real events) is used as it is; without one the
    flat sequence is averaged over all its slots.
    """
    pooled = F.col("pooled") if "pooled" in df.columns else mean_pool("embedding", n, dim)
    kept = [c for c in ("pat_key", "fold") if c in df.columns]
    return df.select(
        *kept,
        F.col(label).cast("double").alias("label"),
        array_to_vector(F.col("features").cast("array<double>")).alias("static"),
        array_to_vector(pooled).alias("pooled"),
    )


def train(inputs: DataFrame, algo: str = "lr", max_iter: int = 50, hidden: list[int] = HIDDEN, seed: int = 1) -> PipelineModel:
    """Fit on ``model_inputs``: ``lr`` logistic regression or ``mlp`` a dense network."""
    assembler = VectorAssembler(inputCols=["static", "pooled"], outputCol="inputs")
    if algo == "lr":
        learner = LogisticRegression(featuresCol="inputs", labelCol="label", maxIter=max_iter, regParam=1e-4)
    elif algo == "mlp":
        width = sum(len(v) for v in inputs.select("static", "pooled").first())
        learner = MultilayerPerceptronClassifier(
            featuresCol="inputs", labelCol="label", layers=[width, *hidden, 2], maxIter=max_iter, seed=seed
        )
    else:
        raise ValueError(f"no such algorithm: {algo}")
    return Pipeline(stages=[assembler, learner]).fit(inputs)


def score(model: PipelineModel, inputs: DataFrame) -> DataFrame:
    """(pat_key, label, score0, score1) of each row."""
    kept = [c for c in ("pat_key", "fold") if c in inputs.columns]
    chance = vector_to_array("probability")
    return model.transform(inputs).select(
        *kept, F.col("label").cast("int").alias("label"), chance[0].alias("score0"), chance[1].alias("score1")
    )
