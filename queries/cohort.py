"""Projection, filter, cohort, readmission and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import query, with_parts
from stayframe.functions import labels
from stayframe.functions.arrays import default_vector
from stayframe.operators import cohort as c, folds, sequence
from stayframe.plans import fixtures as fx

STAY_LIST = ", ".join(c.STAY_COLUMNS)


@query("p1_admission_columns", with_parts("adm") + f" select {STAY_LIST} from adm")
def admission_columns(spark, d):
    return c.admission_columns(fx.stays(spark, d))


@query("p2_cohort", with_parts("adm") + " select pat_key, los, pat_cost from adm where los > 1")
def cohort(spark, d):
    return c.cohort(fx.stays(spark, d)).select("pat_key", "los", "pat_cost")


@query(
    "p2_cohort_capped",
    with_parts("adm") + " select pat_key, los, pat_cost from adm where los > 1 order by pat_key limit 5000",
)
def cohort_capped(spark, d):
    return c.cohort(fx.stays(spark, d), limit=5000).select("pat_key", "los", "pat_cost")


@query("p3_bill_window", with_parts("windowed") + " select * from windowed")
def bill_window(spark, d):
    return c.bill_window(fx.bill(spark, d))


@query("p4_bill_columns", with_parts("bill") + " select pat_key, std_chg_code, serv_day, std_qty from bill")
def bill_columns(spark, d):
    return fx.bill(spark, d).select(*c.BILL_COLUMNS)


FILLED = """, slots as (select pat_key, cast(s as bigint) as rank
  from (select distinct pat_key from windowed) k, range(1, 4) r(s))
select s.pat_key, s.rank, coalesce(r.std_chg_code, -1) as std_chg_code,
  coalesce(r.serv_day, -1) as serv_day, coalesce(r.std_qty, -1) as std_qty
from slots s left join ranked r on s.pat_key = r.pat_key and s.rank = r.rank"""


@query("p7_fill_slots", with_parts("windowed", "ranked") + FILLED)
def fill_slots(spark, d):
    filled = sequence.fill_slots(sequence.slot_join(c.bill_window(fx.bill(spark, d)), 3))
    return filled.withColumn("rank", F.col("rank").cast("bigint"))


@query("p7_fill_slots_full", with_parts("windowed", "ranked") + FILLED.replace("range(1, 4)", "range(1, 101)"))
def fill_slots_full(spark, d):
    filled = sequence.fill_slots(sequence.slot_join(c.bill_window(fx.bill(spark, d)), 100))
    return filled.withColumn("rank", F.col("rank").cast("bigint"))


@query("p8_readmit_default", with_parts("pats") + " select pat_key, readmit_time from pats")
def readmit_default(spark, d):
    stays = c.attach_readmit(c.cohort(fx.stays(spark, d)), c.days_to_next(fx.readmissions(spark, d)))
    return stays.select("pat_key", F.col("readmit_time").cast("bigint").alias("readmit_time"))


VECTORED = """
select r.pat_key, r.std_chg_code, r.serv_day, cast(64 as bigint) as len,
  round(coalesce(list_sum(list_transform(e.v, lambda x: x::double)), 0), 6) as total
from evts r left join emb e on r.std_chg_code = e.code"""


@query("p9_default_vector", with_parts("evts", "emb") + VECTORED)
def default_vectors(spark, d):
    events = sequence.dedup_events(c.bill_window(fx.bill(spark, d)))
    return sequence.embed_events(events, fx.vectors(spark, d)).withColumn("v", default_vector("v", fx.WIDTH)).select(
        *sequence.EVENT, F.size("v").cast("bigint").alias("len"), total_of("v").alias("total")
    )


def total_of(col):
    return F.round(F.aggregate(col, F.lit(0.0), lambda t, x: t + x.cast("double")), 6)


@query(
    "p10_labels",
    with_parts("labelled")
    + " select pat_key, mortality_label, los_label, readmit_label, round(cost_label, 6) as cost_label from labelled",
)
def label_columns(spark, d):
    stays = c.attach_readmit(c.cohort(fx.stays(spark, d)), c.days_to_next(fx.readmissions(spark, d)))
    return stays.select(
        "pat_key",
        labels.label_mortality().alias("mortality_label"),
        labels.label_los().alias("los_label"),
        labels.label_readmit().alias("readmit_label"),
        F.round(labels.label_cost(), 6).alias("cost_label"),
    )


@query(
    "j1_restrict_to",
    with_parts("adm", "windowed")
    + " select * from windowed where pat_key in (select pat_key from adm where los > 1)",
)
def restrict_to(spark, d):
    return c.restrict_to(c.bill_window(fx.bill(spark, d)), c.cohort(fx.stays(spark, d)))


@query("j2_attach_readmit", with_parts("pats") + " select pat_key, medrec_key, los, readmit_time from pats")
def attach_readmit(spark, d):
    stays = c.attach_readmit(c.cohort(fx.stays(spark, d)), c.days_to_next(fx.readmissions(spark, d)))
    return stays.select("pat_key", "medrec_key", "los", F.col("readmit_time").cast("bigint").alias("readmit_time"))


@query(
    "w1_days_to_next",
    with_parts("times") + " select pat_key, medrec_key, disc_mon, days_from_prior, readmit_time from times",
)
def days_to_next(spark, d):
    whole = c.days_to_next(fx.readmissions(spark, d))
    return whole.select(
        "pat_key",
        "medrec_key",
        "disc_mon",
        F.col("days_from_prior").cast("bigint").alias("days_from_prior"),
        F.col("readmit_time").cast("bigint").alias("readmit_time"),
    )


@query("o1_sort_bill", with_parts("windowed") + " select * from windowed order by pat_key, serv_day")
def sort_bill(spark, d):
    return c.sort_bill(c.bill_window(fx.bill(spark, d)))


@query("x1_assign_fold", with_parts("labelled") + " select pat_key, fold from labelled")
def assign_fold(spark, d):
    return folds.assign_fold(c.cohort(fx.stays(spark, d))).select("pat_key", "fold")


@query("p6_fold_selector", with_parts("labelled") + " select pat_key, fold from labelled where fold = 3")
def fold_selector(spark, d):
    return folds.assign_fold(c.cohort(fx.stays(spark, d))).where(F.col("fold") == 3).select("pat_key", "fold")


ROLES = """ select case when fold < 8 then 'train' when fold = 8 then 'validation' else 'test' end as role,
  count(*) as n, sum(los_label) as positives from labelled group by 1"""


@query("x2_split", with_parts("labelled") + ROLES)
def split(spark, d):
    stays = c.attach_readmit(c.cohort(fx.stays(spark, d)), c.days_to_next(fx.readmissions(spark, d)))
    parts = folds.with_role(folds.assign_fold(c.with_labels(stays)))
    return parts.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("los_label").alias("positives"))
