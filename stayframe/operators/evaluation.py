"""ROC, AUC, losses and run selection over scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from stayframe.operators.ordered import ROWS_PER_CHUNK, scan, scan_groups, with_quantile_chunks
from stayframe.operators.skew import HOT_ROWS, lookup

CLIP = 1e-7


def _steps(df: DataFrame, by: Sequence[str], label: str, score: str, rows_per_chunk: int, leads: bool) -> DataFrame:
    """Per group and distinct score, best first: positives and negatives there and so far."""
    counted = df.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum((1 - F.col(label)).cast("bigint")).alias("neg")
    )
    falling = counted.withColumn("_place", -F.col("threshold"))
    chunked = with_quantile_chunks(
        falling, F.col("_place"), rows_per_chunk, basis=df.select((-F.col(score)).alias("_place"))
    )
    here = F.struct("pos", "neg")
    return scan(
        chunked,
        by,
        ["_place"],
        sums={"tp": F.col("pos"), "fp": F.col("neg"), "step": F.lit(1).cast("bigint")},
        leads={"after": here} if leads else None,
    ).drop("_place")


def roc_curve(
    df: DataFrame,
    label: str = "label",
    score: str = "score",
    by: Sequence[str] = (),
    drop_intermediate: bool = True,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """(by, fpr, tpr, threshold): one point per distinct score, plus the origin at best score + 1.

    ``drop_intermediate`` leaves out points inside a straight run of equal steps. A rate is null
    where its class is absent.
    """
    by = list(by)
    steps = _steps(df, by, label, score, rows_per_chunk, drop_intermediate)
    if drop_intermediate:
        same = F.col("after").eqNullSafe(F.struct("pos", "neg"))
        steps = steps.where((F.col("step") == 1) | ~same)
    points = steps.select(*by, "fp", "tp", "threshold")
    ends = df.groupBy(*by).agg(
        F.sum(F.col(label).cast("bigint")).alias("_pos"),
        F.sum((1 - F.col(label)).cast("bigint")).alias("_neg"),
        (F.max(score) + 1).alias("threshold"),
    )
    if not by:
        pos, neg, best = ends.first()
        origin = df.sparkSession.range(1).select(
            F.lit(0).alias("fp"), F.lit(0).alias("tp"), F.lit(best).alias("threshold")
        )
        whole = points.unionByName(origin).withColumns({"_pos": F.lit(pos), "_neg": F.lit(neg)})
    else:
        origin = ends.select(*by, F.lit(0).alias("fp"), F.lit(0).alias("tp"), "threshold")
        totals = ends.select(*by, "_pos", "_neg")
        whole = lookup(points.unionByName(origin), totals, by, null_safe=True, probe=df)
    fpr = F.col("fp").cast("double") / F.nullif(F.col("_neg"), F.lit(0))
    tpr = F.col("tp").cast("double") / F.nullif(F.col("_pos"), F.lit(0))
    return whole.select(*by, fpr.alias("fpr"), tpr.alias("tpr"), "threshold")


def auc_by(
    df: DataFrame,
    by: Sequence[str],
    label: str = "label",
    score: str = "score",
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Area under the ROC curve by trapezoids, per group; null where a class is absent."""
    steps = _steps(df, list(by), label, score, rows_per_chunk, False)
    strip = F.col("neg").cast("double") * (F.col("tp").cast("double") - F.col("pos").cast("double") / 2)
    # Totals are the last running sums; asking for both lets the chunk summary share one shuffle.
    summed = steps.groupBy(*by).agg(
        F.sum(strip).alias("_area"),
        F.max("tp").cast("double").alias("_pos"),
        F.max("fp").cast("double").alias("_neg"),
    )
    whole = F.nullif(F.col("_pos") * F.col("_neg"), F.lit(0.0))
    return summed.select(*by, (F.col("_area") / whole).alias("auc"))


def auc(df: DataFrame, label: str = "label", score: str = "score", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    return auc_by(df, [], label, score, rows_per_chunk)


def auc_macro(
    df: DataFrame,
    label: str = "label",
    scores: Sequence[str] = ("score0", "score1"),
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Mean AUC over the classes, each against the rest with its own score column."""
    sides = [
        F.struct(
            F.lit(k).alias("class"), (F.col(label) == k).cast("int").alias("label"), F.col(s).alias("score")
        )
        for k, s in enumerate(scores)
    ]
    long = df.select(F.explode(F.array(*sides)).alias("c")).select("c.*")
    return auc_by(long, ["class"], rows_per_chunk=rows_per_chunk).agg(F.avg("auc").alias("auc"))


def log_loss(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Mean binary cross-entropy, scores kept away from 0 and 1."""
    p = F.least(F.greatest(F.col(score).cast("double"), F.lit(CLIP)), F.lit(1 - CLIP))
    y = F.col(label).cast("double")
    return df.agg(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"))


def accuracy(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    hit = (F.col(score) > 0.5).cast("int") == F.col(label)
    return df.agg(F.avg(hit.cast("double")).alias("accuracy"))


def best_run(metrics: DataFrame, patience: int = 100, min_rows: int = HOT_ROWS, **options) -> DataFrame:
    """Per run: the epoch with the least validation loss, and when training stopped.

    Training stops ``patience`` epochs after the last gain; later epochs do not count. An epoch whose
    loss is null or NaN is no gain; a run of such epochs alone has no best one.
    (run, best_epoch, best_loss, stop_epoch); stop_epoch is null where patience never ran out.
    """
    usable = F.col("val_loss").isNotNull() & ~F.isnan(F.col("val_loss").cast("double"))
    gain = F.when(usable, F.struct("val_loss", "epoch"))
    best_so_far = scan_groups(
        metrics,
        ["run"],
        ["epoch"],
        cut="epoch",
        mins={"best": gain},
        min_rows=min_rows,
        **options,
    )
    waited = F.col("epoch") - F.col("best.epoch") >= patience
    stop = F.min(F.when(waited, F.struct("epoch", "best")))
    picked = best_so_far.groupBy("run").agg(stop.alias("stop"), F.min(gain).alias("overall"))
    best = F.coalesce("stop.best", "overall")
    return picked.select(
        "run", best["epoch"].alias("best_epoch"), best["val_loss"].alias("best_loss"), F.col("stop.epoch").alias("stop_epoch")
    )
