"""Value indexes, sparse rows and models trained step by step, beside SQL that takes the same steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import query, with_parts
from stayframe.operators import descent, encoder, evaluation as e, folds
from stayframe.operators.cohort import bill_window
from stayframe.operators.features import ADMISSION, DEMOGRAPHICS
from stayframe.operators.sequence import pooled_events
from stayframe.plans import fixtures as fx
from stayframe.plans.stay_table import labelled_stays
from stayframe.session import cut_lineage, scratch_path

GROUP = "BUILDING"
RATE = 0.5
CATEGORIES = [c for c in DEMOGRAPHICS + ADMISSION if c != "age"]

# Stays with a charge in the window, their categories, and the index made from the training folds.
INDEXED = with_parts("labelled", "evts", "emb") + f""",
kept as (select * from labelled where pat_key in (select pat_key from evts)),
cats as (unpivot (select pat_key, fold, {", ".join(f"cast({c} as varchar) as {c}" for c in CATEGORIES)} from kept)
  on {", ".join(CATEGORIES)} into name name value value),
counted as (select name, value, count(*) as n from cats where fold < 8 group by name, value),
idx as (select name, value, n, row_number() over (partition by name order by n desc, value) - 1 as idx from counted)"""

ORDERED = ", ".join(f"({i}, '{c}')" for i, c in enumerate(DEMOGRAPHICS + ADMISSION))
SPARSE = INDEXED + f""",
widths as (select ord, c.name, case when c.name = 'age' then 1 else count(idx.value) end as width
  from (values {ORDERED}) c(ord, name) left join idx on idx.name = c.name group by ord, c.name),
places as (select name, ord, sum(width) over (order by ord) - width as first_place, sum(width) over () as all_places from widths),
pooled as (select pat_key, unnest(range(64)) as i, unnest(vec) as v from (
  select pat_key, list_transform(range(64), lambda i: list_sum(list_transform(vs, lambda v: coalesce(v[i + 1], 0)::double)) / len(vs)) as vec
  from (select pat_key, list(coalesce(v, []) order by std_chg_code, serv_day desc) as vs
    from evts left join emb on code = std_chg_code group by pat_key))),
x as materialized (
  select pat_key, cast(first_place + idx as bigint) as j, 1.0::double as v
    from cats join idx using (name, value) join places using (name)
  union all select pat_key, cast(first_place as bigint), age / 100.0::double from kept, places where name = 'age' and age is not null
  union all select pat_key, cast(all_places + i as bigint), v
    from pooled, (select any_value(all_places) as all_places from places) where pat_key in (select pat_key from kept))"""

TIERS = [("demographics", "(select first_place from places where name = 'adm_mon')"),
         ("admission", "(select any_value(all_places) from places)"),
         ("first_day", "(select any_value(all_places) + 64 from places)")]
NAMES = [(f"{tier} {who}", width, who) for tier, width in TIERS for who in ("everyone", "group")]


def _steps(steps: int) -> str:
    """SQL of that many whole-table gradient steps of every model: ``z0 ..`` margins and ``w1 ..`` weights."""
    models = " union all ".join(f"select {m} as m, '{n}' as name, {w} as width, '{who}' as who" for m, (n, w, who) in enumerate(NAMES))
    sql = f""",
models as materialized ({models}),
members as materialized (select k.pat_key, k.fold, k.los_label as label, m, width from kept k, models
  where who = 'everyone' or std_payor = '{GROUP}'),
xb as materialized (select pat_key, m, j, v from members join x using (pat_key) where j < width
  union all select pat_key, m, -1, 1.0::double from members),
z0 as (select pat_key, m, fold, label, 0.0::double as z from members)"""
    for t in range(1, steps + 1):
        before = f"coalesce(w{t - 1}.w, 0)" if t > 1 else "0"
        sql += f""",
g{t} as materialized (select m, j, sum((1 / (1 + exp(-z)) - label) * v) as g from z{t - 1} join xb using (pat_key, m)
  where fold < 8 group by m, j),
w{t} as materialized (select g{t}.m, g{t}.j, {before} - {RATE}::double * g / (select count(*) from members c where c.m = g{t}.m and fold < 8) as w
  from g{t}{f" left join w{t - 1} using (m, j)" if t > 1 else ""}),
z{t} as materialized (select pat_key, m, any_value(fold) as fold, any_value(label) as label, sum(w * v) as z
  from members join xb using (pat_key, m) join w{t} using (m, j) group by pat_key, m)"""
    return sql


def _loss(t: int, fold: str) -> str:
    return f"(select avg(ln(1 + exp(z)) - label * z) from z{t} where z{t}.m = models.m and fold {fold})"


def _stays(spark, d):
    """Labelled stays that have charges in the window, with their pooled vector."""
    pooled = pooled_events(bill_window(fx.bill(spark, d)), fx.vectors(spark, d), dim=fx.WIDTH)
    return cut_lineage(labelled_stays(fx.stays(spark, d), fx.readmissions(spark, d)).join(pooled, "pat_key"))


def _encoder(stays):
    return encoder.fit_encoder(stays.where(F.col("fold").isin(folds.TRAIN_FOLDS)))


def _inputs(stays, made, label="los_label"):
    coded = encoder.encode(made, stays, extra=F.col("pooled"))
    named = stays.select("pat_key", "fold", F.col(label).alias("label"), (F.col("std_payor") == GROUP).alias("in_group"))
    return cut_lineage(named.join(coded, "pat_key"))


def _models(made, hidden=()):
    """A model of each tier for everyone and for the group, and who belongs to it."""
    widths = {**made.tiers, "first_day": made.width + fx.WIDTH}
    models = [descent.Model(f"{tier} {who}", widths[tier], hidden) for tier in widths for who in ("everyone", "group")]
    rules = [F.lit(True) if m.name.endswith("everyone") else F.col("in_group") for m in models]
    return models, descent.membership(rules)


def _stepped(spark, d, steps, led=True):
    """Inputs, and models after whole-table steps; without the validation fold the last weights are the ones kept."""
    stays = _stays(spark, d)
    made = _encoder(stays)
    inputs = _inputs(stays, made)
    models, members = _models(made)
    seen = inputs if led else inputs.where(F.col("fold").isin(folds.TRAIN_FOLDS))
    ready = descent.prepared(seen.withColumn("models", members))
    return inputs, descent.fit(ready, models, epochs=steps, rate=RATE, adam=False)


@query("m1_value_index", INDEXED + " select name, value, n, idx from idx")
def value_index(spark, d):
    """Providers, physicians, months and all: every value of every column, numbered by frequency."""
    return _encoder(_stays(spark, d)).index


@query(
    "m1_sparse_rows",
    SPARSE + """ select pat_key, count(*) as entries, cast(sum(j) as bigint) as places, round(sum((j + 1) * v), 6) as weighted
from x group by pat_key""",
)
def sparse_rows(spark, d):
    """Whole rows, age and vector values too; the encoder is written and read again in between."""
    stays = _stays(spark, d)
    path = scratch_path(spark, "encoder")
    _encoder(stays).write(path)
    coded = encoder.encode(encoder.Encoder.read(spark, path), stays, extra=F.col("pooled"))
    whole = F.aggregate("places", F.lit(0).cast("bigint"), lambda t, p: t + p)
    weighted = F.aggregate(F.arrays_zip("places", "values"), F.lit(0.0), lambda t, s: t + (s["places"] + 1) * s["values"])
    return coded.select("pat_key", F.size("places").cast("bigint").alias("entries"), whole.alias("places"), F.round(weighted, 6).alias("weighted"))


@query(
    "e1_gradient_steps",
    SPARSE + _steps(2) + " union all ".join(
        f" select name as run, {t} as epoch, round({_loss(t - 1, '< 8')}, 8) as train_loss, round({_loss(t, '= 8')}, 8) as val_loss from models"
        for t in (1, 2)
    ),
)
def gradient_steps(spark, d):
    """Losses of six models over two whole-table steps, one job a step."""
    losses = _stepped(spark, d, 2)[1].losses(spark)
    return losses.select("run", "epoch", F.round("train_loss", 8).alias("train_loss"), F.round("val_loss", 8).alias("val_loss"))


@query(
    "e1_gradient_weights",
    SPARSE + _steps(2) + """ select name as model, cast(case when j < 0 then width else j end as integer) as place, round(w, 8) as weight
from w2 join models using (m) where abs(w) > 1e-7""",
)
def gradient_weights(spark, d):
    """Every weight after two steps, as the saved table holds them."""
    path = scratch_path(spark, "models")
    _stepped(spark, d, 2, led=False)[1].write(spark, path)
    table = descent.Fitted.read(spark, path).table(spark)
    return table.where(F.abs("weight") > 1e-7).select("model", "place", F.round("weight", 8).alias("weight"))


@query(
    "e8_models_by_tier_and_group",
    SPARSE + _steps(3) + f""",
judged as (select name as model, whom as judged_on, k.los_label as label, round(1 / (1 + exp(-coalesce(s.z, 0))), 9) as score
  from kept k cross join models cross join (values ('everyone'), ('group')) t(whom)
  left join (select pat_key, m, sum(w * v) as z from (
      select pat_key, m, j, v from kept join x using (pat_key) cross join models where j < width
      union all select pat_key, m, -1, 1.0::double from kept cross join models) join w3 using (m, j) group by pat_key, m) s
    on s.pat_key = k.pat_key and s.m = models.m
  where k.fold = 9 and (whom = 'everyone' or std_payor = '{GROUP}')),
by_score as (select model, judged_on, score, sum(label) as pos, sum(1 - label) as neg from judged group by all),
cum as (select *, sum(pos) over (partition by model, judged_on order by score desc) as tp from by_score)
select model, judged_on, round(sum(neg::double * (tp - pos / 2.0::double)) / (sum(pos)::double * sum(neg)), 6) as auc
from cum group by model, judged_on""",
)
def models_by_tier_and_group(spark, d):
    """Six models trained in one job, each judged on everyone and on the group, side by side."""
    inputs, fitted = _stepped(spark, d, 3, led=False)
    test = inputs.where(F.col("fold").isin(folds.TEST_FOLDS))
    scored = descent.score(fitted, test, "label", "in_group").withColumn("score", F.round("score", 9))
    whom = F.explode(F.when(F.col("in_group"), F.array(F.lit("everyone"), F.lit("group"))).otherwise(F.array(F.lit("everyone"))))
    judged = e.auc_by(scored.withColumn("judged_on", whom), ["model", "judged_on"])
    return judged.withColumn("auc", F.round("auc", 6))


def _led(spark, d, label, hidden=(), **options):
    """Train on folds 0-7 led by fold 8, save, load, and score fold 9; the epochs chosen come along."""
    stays = _stays(spark, d)
    made = _encoder(stays)
    inputs = _inputs(stays, made, label)
    models, members = _models(made, hidden)
    fitted = descent.fit(descent.prepared(inputs.withColumn("models", members), batches=2), models, **options)
    path = scratch_path(spark, "models")
    fitted.write(spark, path)
    losses = spark.read.parquet(f"{path}/losses").select("run", "epoch", "val_loss")
    test = inputs.where(F.col("fold").isin(folds.TEST_FOLDS))
    scored = descent.score(descent.Fitted.read(spark, path), test, "pat_key", "label")
    best = e.best_run(losses, patience=options["patience"])
    return e.auc_by(scored, ["model"]).join(best.withColumnRenamed("run", "model"), "model")


@query("e1_validation_led")
def validation_led(spark, d):
    """Logistic models of death in hospital, by tier and group: best epoch, its loss, and AUC on fold 9."""
    return _led(spark, d, "mortality_label", epochs=40, rate=0.05, patience=5)


@query("e1_validation_led_network")
def validation_led_network(spark, d):
    """The two hidden layers in full size, for every tier and group in one job."""
    return _led(spark, d, "los_label", (256, 128), epochs=12, rate=0.002, patience=3)
