"""The whole way from admissions and charges to the modelling table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from stayframe.functions.arrays import dense_u8, zero_vector
from stayframe.operators.cohort import (
    STAY_COLUMNS,
    admission_columns,
    attach_readmit,
    bill_window,
    cohort,
    days_to_next,
    with_labels,
)
from stayframe.operators.features import apply_features, fit_features
from stayframe.operators.folds import TRAIN_FOLDS, assign_fold
from stayframe.operators.sequence import event_sequence, pooled_events

OUTPUT = ["pat_key", "embedding", "features", "mortality_label", "los_label", "cost_label", "readmit_label", "fold"]


def labelled_stays(adm: DataFrame, readmit: DataFrame, min_los: int = 1, limit: int | None = None) -> DataFrame:
    """The cohort with readmission horizon, the four labels and the fold."""
    stays = admission_columns(cohort(adm, min_los, limit), STAY_COLUMNS)
    return assign_fold(with_labels(attach_readmit(stays, days_to_next(readmit))))


def build_stays(
    adm: DataFrame,
    bill: DataFrame,
    readmit: DataFrame,
    emb: DataFrame,
    n: int = 100,
    dim: int = 10,
    days: Sequence[int] = (0, 1),
    model: PipelineModel | None = None,
    keep_empty: bool = False,
    min_los: int = 1,
    limit: int | None = None,
    pooled: bool = False,
) -> DataFrame:
    """One row per stay: flat event sequence, feature array, labels and fold.

    With ``pooled`` the mean vector of the events comes in place of the sequence, from one pass over the events.

    A stay's charges are cut to n events before anything is joined to them, so the join with the
    cohort works on one row per stay. Stays without a charge in the window drop out, or come with
    an empty sequence when ``keep_empty`` is set. Without a ``model`` one is fitted on the training folds.
    """
    stays = labelled_stays(adm, readmit, min_los, limit)
    if model is None:
        model = fit_features(stays.where(F.col("fold").isin(TRAIN_FOLDS)))
    featured = apply_features(model, stays).withColumn("features", dense_u8("features"))
    listed, name, width = (pooled_events, "pooled", dim) if pooled else (event_sequence, "embedding", n * dim)
    joined = featured.join(listed(bill_window(bill, days), emb, n, dim), "pat_key", "left" if keep_empty else "inner")
    filled = joined.withColumn(name, F.coalesce(name, zero_vector(width).cast(joined.schema[name].dataType)))
    return filled.select(*[name if c == "embedding" else c for c in OUTPUT])
