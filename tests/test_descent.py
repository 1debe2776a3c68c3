import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from stayframe.operators import descent as d, encoder as en
from stayframe.operators.evaluation import auc_by, best_run
from stayframe.session import scratch_path

STAY = "pat_key bigint, city string, ward int, age double, fold int, label int, vec array<float>"


@pytest.fixture(scope="module")
def stays(spark):
    """Outcomes that depend on the city, the age and the vector; wards are noise of very many values."""
    rng = random.Random(7)
    out = []
    for i in range(3000):
        city, age = rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([10.0, 50.0, 90.0, None])
        vec = [rng.uniform(-1, 1), rng.uniform(-1, 1)] if rng.random() < 0.9 else None
        z = (city == "b") * 2.0 + ((age or 40) - 50) / 40 + (vec or [0, 0])[0] * 2
        out.append((i, city, rng.randint(0, 900), age, i % 10, int(rng.random() < 1 / (1 + math.exp(-z))), vec))
    return spark.createDataFrame(out, STAY), out


TIERS = {"who": ["age", "city"], "where": ["ward"]}


def test_encoder_places_every_value(spark, stays):
    df, raw = stays
    for options in ({}, {"min_rows": 10, "rows_per_chunk": 40}):
        made = en.fit_encoder(df, TIERS, {"age": 100.0}, **options)
        counts = {}
        for name, at in (("city", 1), ("ward", 2)):
            for r in raw:
                if r[at] is not None:
                    counts[name, str(r[at])] = counts.get((name, str(r[at])), 0) + 1
        want = []
        for name in ("city", "ward"):
            order = sorted((-n, v) for (c, v), n in counts.items() if c == name)
            want += [(name, v, -n, i) for i, (n, v) in enumerate(order)]
        assert rows(made.index, "name", "value", "n", "idx") == sorted(want)
        wards = sum(c == "ward" for c, _ in counts)
        assert made.places == {"age": (0, 1), "city": (1, 3), "ward": (4, wards)} and made.tiers == {"who": 4, "where": 4 + wards}
    path = scratch_path(spark, "encoder")
    made.write(path)
    again = en.Encoder.read(spark, path)
    assert (again.places, again.tiers, again.units, again.width) == (made.places, made.tiers, made.units, made.width)
    place = {(n, v): made.places[n][0] + i for n, v, _, i in want}
    unseen = df.limit(1).select(F.lit(-1).cast("bigint").alias("pat_key"), F.lit("zz").alias("city"), F.lit(None).cast("int").alias("ward"), F.lit(None).cast("double").alias("age"), "fold", "label", F.lit(None).cast("array<float>").alias("vec"))
    for options in ({}, {"broadcast_values": 0, "min_rows": 5}):
        got = {r[0]: (r[1], r[2]) for r in en.encode(again, df.unionByName(unseen), extra=F.col("vec"), **options).collect()}
        assert len(got) == 3001 and got[-1] == ([], [])
        for i, city, ward, age, _, _, vec in raw:
            entries = [(0, age / 100)] if age is not None else []
            entries += [(place["city", city], 1.0)] if city else []
            entries += [(place["ward", str(ward)], 1.0)]
            entries += [(again.width + j, x) for j, x in enumerate(vec or [])]
            assert got[i][0] == [p for p, _ in entries] and got[i][1] == pytest.approx([x for _, x in entries])


@pytest.mark.parametrize("hidden", [(), (4,), (5, 3)])
def test_gradients_are_slopes_of_the_loss(hidden):
    rng = np.random.default_rng(3)
    model = d.Model("m", 6, hidden)
    w = rng.normal(0, 0.7, len(model.start(1)))
    n, counts = 9, np.array([2, 0, 3, 1, 2, 4, 0, 1, 2])
    here = d.Rows(rng.integers(0, 2, n).astype(float), rng.integers(0, 8, 15), rng.normal(size=15), np.repeat(np.arange(n), counts))
    found, loss = d.gradient(model, w, here)
    assert loss == pytest.approx(d._losses(d.forward(model, w, here), here.label).sum())
    for i in rng.choice(len(w), 12):
        step = np.zeros(len(w))
        step[i] = 1e-6
        up, down = (d._losses(d.forward(model, w + s, here), here.label).sum() for s in (step, -step))
        assert found[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)


@pytest.fixture(scope="module")
def inputs(stays):
    df, _ = stays
    made = en.fit_encoder(df, TIERS, {"age": 100.0})
    coded = en.encode(made, df, extra=F.col("vec"))
    return made, df.select("pat_key", "fold", "label", "city").join(coded, "pat_key")


def test_many_models_in_one_job_follow_the_validation_fold(spark, inputs):
    made, table = inputs
    width = made.width + 2
    models = [d.Model("who", made.tiers["who"]), d.Model("all", width), d.Model("net", width, (8, 4)), d.Model("city b", width)]
    rules = [F.lit(True), F.lit(True), F.lit(True), F.col("city") == "b"]
    ready = d.prepared(table.withColumn("models", d.membership(rules)), batches=2)
    fitted = d.fit(ready, models, epochs=25, batches=2, rate=0.05, patience=6)
    losses = fitted.losses(spark)
    # The history is what best_run reads, and the weights kept are those of its best epoch.
    best = {r["run"]: r for r in best_run(losses.where("val_loss is not null").select("run", "epoch", "val_loss"), patience=6).collect()}
    assert set(best) == {m.name for m in models}
    test = table.where("fold = 9")
    scored = d.score(fitted, test, "pat_key", "label", "city")
    assert scored.count() == 4 * test.count() and scored.columns == ["pat_key", "label", "city", "model", "score"]
    auc = {r["model"]: r["auc"] for r in auc_by(scored, ["model"]).collect()}
    assert auc["all"] > 0.66 and auc["net"] > 0.6 and auc["all"] > auc["who"] > 0.52, auc
    held = table.where("fold = 8")
    for model, weights in zip(models, fitted.weights):
        own = held.where("city = 'b'") if model.name == "city b" else held
        again = d.score(d.Fitted([model], [weights]), own, "label")
        loss = again.select(F.avg(-F.when(F.col("label") == 1, F.ln("score")).otherwise(F.ln(1 - F.col("score"))))).first()[0]
        assert loss == pytest.approx(best[model.name]["best_loss"])
    # Learning wards by heart stops early, and the others go on.
    epochs = {r["run"]: r["n"] for r in losses.groupBy("run").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert epochs["all"] < 25 and epochs["who"] == 25
    # Alone, each learns the same.
    alone = d.fit(d.prepared(table, batches=2), models[1:2], epochs=25, batches=2, rate=0.05, patience=6)
    assert alone.weights[0] == pytest.approx(fitted.weights[1])


def test_weights_come_back_and_go_on(spark, inputs):
    made, table = inputs
    models = [d.Model("all", made.width + 2), d.Model("net", made.tiers["who"], (3,))]
    ready = d.prepared(table)
    first = d.fit(ready, models, epochs=3, adam=False, rate=0.5)
    path = scratch_path(spark, "models")
    first.write(spark, path)
    again = d.Fitted.read(spark, path)
    assert again.models == models and again.history == first.history
    assert all((a == b).all() for a, b in zip(again.weights, first.weights))
    more = d.fit(ready, models, epochs=2, adam=False, rate=0.5, warm=again)
    whole = d.fit(ready, models, epochs=5, adam=False, rate=0.5)
    for a, b in zip(more.weights, whole.weights):
        assert a == pytest.approx(b)
    assert [h[3] for h in more.history] == pytest.approx([h[3] for h in whole.history if h[1] > 3])


def test_training_takes_odd_tables(spark, inputs):
    _, table = inputs
    model = d.Model("m", 4)
    # Nothing to learn from, nothing to validate on, null labels, models nobody belongs to.
    none = d.fit(d.prepared(table.where("fold = 9")), [model], epochs=2)
    assert (none.weights[0] == 0).all() and [h[3] for h in none.history] == [None, None]
    blind = d.fit(d.prepared(table.where("fold < 8")), [model], epochs=2, adam=False)
    assert (blind.weights[0] != 0).any() and blind.history[1][3] is None and blind.history[1][2] < math.log(2)
    nulls = table.withColumn("label", F.when(F.col("pat_key") % 2 == 0, F.col("label"))).withColumn("models", d.membership([F.lit(None).cast("boolean")]))
    unasked = d.fit(d.prepared(nulls), [model], epochs=1)
    assert (unasked.weights[0] == 0).all()
    assert d.score(blind, table.where("fold < 0"), "label").count() == 0


def test_models_share_what_is_made_of_their_rows():
    """Rows are made dense once for models of one width; what lies beyond a model's width does not reach it."""
    rng = np.random.default_rng(5)
    counts = np.array([2, 0, 3, 1, 2, 4, 0, 3])
    place, row = np.concatenate([rng.choice(8, c, replace=False) for c in counts]), np.repeat(np.arange(8), counts)
    value = np.where(place == 7, np.nan, rng.normal(size=15))
    here = d.Rows(rng.integers(0, 2, 8).astype(float), place, value, row)
    assert here.dense(5) is here.dense(5) and here.dense(5).shape == (8, 6) and (here.dense(5)[:, 5] == 1).all()
    assert here.some(np.arange(8)) is here
    for hidden in ((), (4, 3)):
        model = d.Model("m", 6, hidden)
        w = rng.normal(0, 0.7, len(model.start(1)))
        alone = d.Rows(here.label, place[place < 6], value[place < 6], row[place < 6])
        found, loss = d.gradient(model, w, here)
        again, same = d.gradient(model, w, alone)
        assert np.isfinite(found).all() and found == pytest.approx(again) and loss == pytest.approx(same)
        parts = [d.gradient(model, w, here.span(a, a + 3)) for a in range(0, 8, 3)]
        assert found == pytest.approx(sum(p for p, _ in parts)) and loss == pytest.approx(sum(x for _, x in parts))
