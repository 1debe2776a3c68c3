import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from conftest import rows
from stayframe.operators import classifier, evaluation as e


def scored(spark, n=600):
    rng = random.Random(5)
    data = [(int(rng.random() < 0.4), float(rng.randrange(60)), "abc"[0 if i % 3 else i % 2 + 1]) for i in range(n)]
    return data, spark.createDataFrame(data, "label int, score double, run string").repartition(4)


def brute_auc(pairs):
    pos = [s for y, s in pairs if y]
    neg = [s for y, s in pairs if not y]
    if not pos or not neg:
        return None
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("per_chunk", [10**6, 40, 1])
def test_auc_matches_pair_counting_and_spark(spark, per_chunk):
    data, df = scored(spark)
    got = e.auc(df, rows_per_chunk=per_chunk).first().auc
    assert got == pytest.approx(brute_auc([d[:2] for d in data]), abs=1e-12)
    judge = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    assert got == pytest.approx(judge.evaluate(df), abs=1e-9)
    assert e.auc(df.withColumn("score", F.exp(F.col("score") / 10)), rows_per_chunk=per_chunk).first().auc == pytest.approx(got)
    by = dict(rows(e.auc_by(df, ["run"], rows_per_chunk=per_chunk)))
    for run in by:
        assert by[run] == pytest.approx(brute_auc([d[:2] for d in data if d[2] == run]), abs=1e-12)


def test_auc_edges(spark):
    flat = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5)], "label int, score double")
    assert e.auc(flat).first().auc == 0.5
    assert e.auc(flat.where("label = 1")).first().auc is None
    two = flat.select("label", (1 - F.col("score")).alias("score0"), F.col("score").alias("score1"))
    assert e.auc_macro(two).first().auc == 0.5


@pytest.mark.parametrize("per_chunk", [10**6, 40])
@pytest.mark.parametrize("drop", [True, False])
def test_roc_points(spark, per_chunk, drop):
    data, df = scored(spark)
    pos, neg = sum(d[0] for d in data), sum(1 - d[0] for d in data)
    steps = [(s, sum(d[0] for d in data if d[1] == s), sum(1 - d[0] for d in data if d[1] == s)) for s in sorted({d[1] for d in data}, reverse=True)]
    want, tp, fp = [(0.0, 0.0, steps[0][0] + 1)], 0, 0
    for i, (s, p, n) in enumerate(steps):
        tp, fp = tp + p, fp + n
        straight = 0 < i < len(steps) - 1 and steps[i + 1][1:] == (p, n)
        if not (drop and straight):
            want.append((fp / neg, tp / pos, s))
    got = rows(e.roc_curve(df, drop_intermediate=drop, rows_per_chunk=per_chunk), "fpr", "tpr", "threshold")
    assert got == sorted(want)


def brute_best(losses, patience):
    best, at, stop = None, None, None
    for epoch, loss in losses:
        if best is None or loss < best:
            best, at = loss, epoch
        elif epoch - at >= patience:
            stop = epoch
            break
    return at, best, stop


@pytest.mark.parametrize("options", [{}, {"min_rows": 20, "rows_per_chunk": 6}])
def test_best_run_stops_as_training_would(spark, options):
    rng = random.Random(1)
    runs = {f"r{i}": [(t, round(rng.random() + 5 / (t + 1), 3)) for t in range(1, 25 if i else 90)] for i in range(6)}
    data = [(run, *row) for run, losses in runs.items() for row in losses]
    df = spark.createDataFrame(data, "run string, epoch int, val_loss double").repartition(3)
    got = rows(e.best_run(df, patience=6, **options))
    assert got == sorted((run, *brute_best(losses, 6)) for run, losses in runs.items())


def test_losses(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.0)], "label int, score double")
    assert e.log_loss(df).first().log_loss == pytest.approx((0.105360516 + 0.223143551 + 16.118095651) / 3)
    assert e.accuracy(df).first().accuracy == pytest.approx(2 / 3)


@pytest.mark.parametrize("algo", ["lr", "mlp"])
def test_classifiers_find_a_planted_signal(spark, algo):
    table = spark.range(600).select(
        F.col("id").alias("pat_key"),
        F.array((F.col("id") % 2).cast("smallint"), (F.col("id") % 3).cast("smallint")).alias("features"),
        F.array(*[(F.hash("id", F.lit(j)) % 100 / 100).cast("float") for j in range(4)]).alias("embedding"),
    )
    table = table.withColumn(
        "los_label", (F.col("embedding")[0] + F.col("embedding")[2] + F.col("features")[0] > 0.5).cast("int")
    )
    inputs = classifier.model_inputs(table, "los_label", n=2, dim=2).cache()
    model = classifier.train(inputs.where("pat_key < 450"), algo, max_iter=60, hidden=[8, 4])
    judged = classifier.score(model, inputs.where("pat_key >= 450"))
    assert e.auc(judged, score="score1").first().auc > 0.85
