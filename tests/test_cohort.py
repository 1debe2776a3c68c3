import pytest
from pyspark.sql import functions as F

from conftest import rows
from stayframe.operators import cohort as c


def stays(spark, data):
    return spark.createDataFrame(data, "pat_key bigint, los int, disc_status int, readmit_time int, pat_cost double")


def test_lookup_of_keys_of_different_types(spark):
    from stayframe.operators.skew import lookup

    def met(many, kind, one, other):
        left = spark.createDataFrame([(k,) for k in many], f"k {kind}")
        right = spark.createDataFrame([(k, i) for i, k in enumerate(one)], f"k {other}, i int")
        return [(r.k, r.i) for r in lookup(left, right, ["k"]).orderBy("k").collect()]

    assert met([1, 2], "int", [2, 2_147_483_655], "bigint") == [(1, None), (2, 0)]
    assert met([1, 2], "int", [1.5, 2.0], "double") == [(1, None), (2, 1)]
    assert met([1, 2], "bigint", ["x", "2"], "string") == [(1, None), (2, 1)]
    assert met(["a", "1"], "string", [1], "int") == [("1", 0), ("a", None)]


def test_cohort_is_strictly_longer_and_cap_is_by_key(spark):
    df = stays(spark, [(5, 2, 1, 1, 0.0), (3, 9, 1, 1, 0.0), (1, 1, 1, 1, 0.0), (2, None, 1, 1, 0.0), (9, 3, 1, 1, 0.0)])
    assert rows(c.cohort(df), "pat_key") == [(3,), (5,), (9,)]
    assert rows(c.cohort(df, limit=2), "pat_key") == [(3,), (5,)]


def test_labels(spark):
    df = stays(
        spark,
        [
            (1, 7, 1, 9999, 1.5),  # long stay
            (2, 6, 1, 30, 1.5),  # readmitted in time
            (3, 2, 20, 9999, 1.5),  # died
            (4, 6, None, 31, 1.5),  # no status, late readmission
        ],
    )
    got = rows(c.with_labels(df), "pat_key", "mortality_label", "los_label", "readmit_label", "cost_label")
    assert got == [(1, 0, 1, 0, 1.5), (2, 0, 0, 1, 1.5), (3, 1, 1, 1, 1.5), (4, 0, 0, 0, 1.5)]


def test_days_to_next_breaks_month_ties_by_key_and_splits_hot_patients(spark):
    data = [(1, 11, 201301, None), (1, 13, 201302, 20), (1, 12, 201302, 4), (2, 14, 201301, None)]
    df = spark.createDataFrame(data, "medrec_key bigint, pat_key bigint, disc_mon int, days_from_prior int")
    assert rows(c.days_to_next(df), "pat_key", "readmit_time") == [(11, 4), (12, 20), (13, None), (14, None)]
    many = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("medrec_key"),
        F.col("id").alias("pat_key"),
        (201301 + F.col("id") % 2).cast("int").alias("disc_mon"),
        (F.col("id") % 50).cast("int").alias("days_from_prior"),
    )
    plain = rows(c.days_to_next(many), "pat_key", "readmit_time")
    assert rows(c.days_to_next(many, min_rows=50, rows_per_chunk=9), "pat_key", "readmit_time") == plain


def test_attach_readmit_fans_out_and_defaults(spark):
    df = stays(spark, [(1, 2, 1, 0, 0.0), (2, 2, 1, 0, 0.0), (3, 2, 1, 0, 0.0)]).drop("readmit_time")
    times = spark.createDataFrame([(1, 10), (1, 40), (2, None)], "pat_key bigint, readmit_time int")
    want = [(1, 10), (1, 40), (2, 9999), (3, 9999)]
    assert rows(c.attach_readmit(df, times), "pat_key", "readmit_time") == want
    crowd = times.unionByName(spark.createDataFrame([(2, i) for i in range(50)], "pat_key bigint, readmit_time int"))
    plain = c.attach_readmit(df, crowd)
    split = c.attach_readmit(df, crowd, min_rows=10)
    assert rows(split, *plain.columns) == rows(plain) and split.count() == 54


def test_restrict_to_keeps_lines_of_hot_stays(spark):
    bill = spark.range(90).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("pat_key"), F.col("id").alias("std_chg_code")
    )
    keep = spark.createDataFrame([(1,), (1,), (4,), (500,)], "pat_key bigint")
    plain = rows(c.restrict_to(bill, keep))
    assert len(plain) == 32  # 30 lines of stay 1, its own id 1, and stay 4
    assert rows(c.restrict_to(bill, keep, min_rows=10)) == plain


def test_bill_window_and_first_n(spark):
    bill = spark.createDataFrame(
        [(2, 5, 0, 1.0), (1, 6, 2, 1.0), (1, 7, 1, 1.0), (1, 4, 0, 2.0)],
        "pat_key bigint, std_chg_code bigint, serv_day int, std_qty double",
    )
    assert rows(c.bill_window(bill), "pat_key", "serv_day") == [(1, 0), (1, 1), (2, 0)]
    assert [r.std_chg_code for r in c.first_n(bill, 2).collect()] == [4, 7]
    with pytest.raises(Exception):
        c.admission_columns(bill).collect()
