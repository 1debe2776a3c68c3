import datetime
import decimal
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from stayframe.operators import evaluation as e, folds, ordered, sequence, skew, topn
from stayframe.sinks import writers
from stayframe.sources import readers
from stayframe.session import scratch_path


def test_first_rows_of_huge_groups(spark):
    rng = random.Random(1)
    raw = [(1 if i % 3 else i, rng.randint(0, 10**6), i) for i in range(3000)]
    df = spark.createDataFrame(raw, "g long, x long, i long")
    for n in (1, 40):
        want = []
        for g in {r[0] for r in raw}:
            own = sorted((r for r in raw if r[0] == g), key=lambda r: (-r[1], r[2]))[:n]
            want += [(*r, k) for k, r in enumerate(own, 1)]
        order = [F.desc("x"), F.col("i")]
        for options in ({}, {"plain_n": 0, "min_rows": 100, "rows_per_slice": 60}):
            assert rows(topn.first_rows(df, ["g"], order, n, **options), "g", "x", "i", "rank") == sorted(want)


def test_events_beyond_a_thousand(spark):
    """A stay of 1,500 distinct events among others, cut at 1,001."""
    raw = [(1, c, d, 1.0) for c in range(750) for d in (0, 1)] + [(k, c, 0, 2.0) for k in range(2, 30) for c in range(k)]
    bill = spark.createDataFrame(raw, "pat_key long, std_chg_code long, serv_day int, std_qty double")
    for options in ({}, {"min_rows": 100, "rows_per_slice": 400}):
        got = rows(sequence.first_events(bill, 1001, **options), "pat_key", "rank", "std_chg_code", "serv_day")
        assert [r for r in got if r[0] == 1] == [(1, k + 1, k // 2, 1 - k % 2) for k in range(1001)]
        assert len(got) == 1001 + sum(range(2, 30))
    plan = sequence.first_events(bill, 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # partial and final


def test_hot_keys_are_found_in_one_pass(spark):
    df = spark.range(200_000).selectExpr("case when id % 4 = 0 then 7 when id % 10 = 1 then 8 else id end as k", "id")
    hot = skew.hot_keys(df, ["k"], min_rows=15_000)
    want = [r["h"] for r in spark.createDataFrame([(7,), (8,)], "k long").select(skew.key_hash(["k"]).alias("h")).collect()]
    assert sorted(hot) == sorted(want)
    assert skew.hot_keys(df, ["k"], min_rows=60_000) == [] == skew.hot_keys(df.where("id < 0"), ["k"], min_rows=1)
    nulls = df.select(F.lit(None).cast("long").alias("k"))
    assert len(skew.hot_keys(nulls, ["k"], min_rows=1000)) == 1


DAY = datetime.date(2020, 1, 2)


@pytest.mark.parametrize(
    "many,one,kinds",
    [
        ([1, 2, None], [decimal.Decimal("1.00"), decimal.Decimal("2.50")], ("bigint", "decimal(10,2)")),
        ([1, 2], ["01", "3"], ("bigint", "string")),
        (["01", "3"], [1, 2], ("string", "bigint")),
        ([1, 2], [1.0, 1e35], ("bigint", "double")),
        ([DAY], [datetime.datetime(2020, 1, 2), datetime.datetime(2020, 1, 2, 1)], ("date", "timestamp_ntz")),
        ([1.5, 2.0], ["1.50", "7"], ("double", "string")),
        ([1], [1], ("int", "bigint")),
    ],
)
def test_keys_of_different_types_meet_as_in_a_join(spark, many, one, kinds):
    a = spark.createDataFrame([(x, i) for i, x in enumerate(many)], f"k {kinds[0]}, i int")
    b = spark.createDataFrame([(x, i) for i, x in enumerate(one)], f"k {kinds[1]}, j int")
    want = rows(a.join(b.withColumnRenamed("k", "l"), F.col("k") == F.col("l"), "left").select("i", "j"))
    assert any(j is not None for _, j in want)
    for options in ({}, {"broadcast_rows": 100}, {"min_rows": 1}):
        assert rows(skew.lookup(a, b, ["k"], **options), "i", "j") == want


def test_hot_rows_that_are_not_unique_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_BROADCAST_ROWS", 3)
    many = spark.range(50).selectExpr("id % 2 as k", "id as i")
    one = spark.range(40).selectExpr("id % 2 as k", "id as j")
    assert skew.lookup(many, one, ["k"], min_rows=5).count() == 50 * 20
    assert skew.fan_out(one.groupBy("k").agg(F.max("j").alias("m")), many, ["k"], min_rows=5).count() == 50


@pytest.mark.parametrize("shape", ["even", "ties", "outliers", "tail"])
def test_chunks_hold_about_equally_many(spark, shape):
    value = {
        "even": "double(id)", "ties": "double(id % 7)", "outliers": "case when id = 0 then -1e300 when id = 1 then 1e300 else double(id % 1000) end",
        "tail": "pow(1.01, id % 3000)",
    }[shape]
    df = spark.range(20_000).selectExpr(f"{value} as x", "id")
    cut = ordered.with_quantile_chunks(df, F.col("x"), 500)
    spans = rows(cut.groupBy("_chunk").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")), "lo", "hi", "n", "_chunk")
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))  # ties stay together, chunks follow the order
    assert all(n <= 1500 or lo == hi for lo, hi, n, _ in spans) and sum(s[2] for s in spans) == 20_000
    assert [s[3] for s in spans] == sorted(s[3] for s in spans)


def test_one_odd_text_does_not_gather_all_others(spark):
    df = spark.range(8000).selectExpr("case when id = 0 then 'AAA' when id = 1 then 'zzz' when id = 2 then null else concat('code-000-', lpad(id, 6, '0')) end as t")
    cut = ordered.with_quantile_chunks(df, F.col("t"), 400)
    spans = rows(cut.groupBy("_chunk").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n")), "lo", "hi", "n", "_chunk")
    assert len(spans) > 10 and max(s[2] for s in spans) < 2000
    known = [s for s in spans if s[0] is not None]
    assert all(a[1] < b[0] and a[3] < b[3] for a, b in zip(known, known[1:]))


def test_curves_in_many_chunks(spark):
    df = spark.range(3000).selectExpr("int(xxhash64(id) % 3 = 0) as label", "double(xxhash64(id, 1) % 900) as score")
    whole, cut = (rows(e.roc_curve(df, rows_per_chunk=n), "threshold", "fpr", "tpr") for n in (10**6, 150))
    assert len(cut) == len(whole) > 500 and all(a == pytest.approx(b) for a, b in zip(cut, whole))
    assert e.auc(df, rows_per_chunk=150).first()[0] == pytest.approx(e.auc(df).first()[0])


def test_files_follow_bytes(spark):
    """About the same file size at ten times the rows."""
    sizes = {}
    for n in (4_000, 40_000):
        df = folds.assign_fold(spark.range(n).selectExpr("id as pat_key", "sha2(cast(id as string), 512) as a", "sha2(cast(-id as string), 512) as b"))
        path = scratch_path(spark, "folds")
        files = writers.files_for(df, target_mb=0.05)
        writers.write_folds(df, path, files_per_fold=files)
        found = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size").distinct().collect()
        sizes[n] = sorted(r["file_size"] for r in found)
        assert len(found) == 10 * files
        assert readers.read_folds(spark, path, list(range(10))).count() == n
    assert len(sizes[40_000]) >= 6 * len(sizes[4_000]) > 0
    middle = sizes[40_000][len(sizes[40_000]) // 2]
    assert 0.02 * 2**20 < middle < 0.1 * 2**20
    assert writers.files_for(df.where("pat_key < 0")) == 1


def test_files_follow_values_that_shrink_to_nothing(spark):
    """A long array of one value takes no bytes in a file, but a task's share of the values stays bounded."""
    df = folds.assign_fold(spark.range(2000).select(F.col("id").alias("pat_key"), F.array_repeat(F.lit(0.0).cast("float"), 640).alias("v")))
    files = writers.files_for(df, raw_mb=0.25)
    assert 4 <= files <= 6 and writers.files_for(df) == 1
    path = scratch_path(spark, "folds")
    writers.write_folds(df, path, files_per_fold=files)
    counts = spark.read.parquet(path).groupBy(F.input_file_name()).count()
    assert counts.agg(F.max("count"), F.sum("count"), F.count(F.lit(1))).first()[1:] == (2000, 10 * files)
    assert counts.agg(F.max("count")).first()[0] < 90
