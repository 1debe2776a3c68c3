from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from conftest import rows
from stayframe.operators import cooccurrence as g

BILL = "pat_key bigint, serv_day int, std_chg_code bigint"


def brute(lines):
    groups = {}
    for p, d, c in lines:
        if p is not None and d is not None and c is not None:
            groups.setdefault((p, d), []).append(c)
    weights = Counter()
    for codes in groups.values():
        for a, b in combinations(codes, 2):
            if a != b:
                weights[min(a, b), max(a, b)] += 1
    return sorted((*k, v) for k, v in weights.items())


def test_repeated_lines_multiply(spark):
    lines = [(1, 0, 5), (1, 0, 5), (1, 0, 7), (1, 0, 7), (1, 0, 7), (1, 1, 5), (2, 0, None), (2, 0, 5), (None, 0, 7)]
    assert rows(g.code_pairs(spark.createDataFrame(lines, BILL))) == [(5, 7, 6)] == brute(lines)


def test_wide_groups_in_slices_give_the_same_edges(spark):
    lines = [(i % 9, i % 2, i * 31 % 47) for i in range(500)] + [(99, 0, i % 80) for i in range(300)]
    df = spark.createDataFrame(lines, BILL).repartition(4)
    want = brute(lines)
    assert rows(g.code_pairs(df)) == want
    assert rows(g.code_pairs(df, slice_codes=7)) == want
    assert rows(g.code_pairs(df, slice_codes=1)) == want


def test_pairs_are_dealt_by_the_number_of_lines(spark):
    """Lines and pairs lay in as many partitions as the session names, however many they were; copies are counted first."""
    lines = [(i % 97, i % 3, i * 7 % 31) for i in range(900)] + [(1, 1, 4)] * 300
    df = spark.createDataFrame(lines, BILL)
    few = g.code_pairs(df)
    many = g.code_pairs(df, lines_per_task=100, min_rows=50, slice_codes=7, probe=df.select("pat_key", "std_chg_code"))
    assert rows(few) == rows(many) == brute(lines)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counts = [g.code_pairs(df, lines_per_task=n).rdd.getNumPartitions() for n in (10_000, 100)]
        plan = g.code_pairs(df, lines_per_task=100)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert counts == [4, 12]
    assert "(_part" in plan and "hashpartitioning(id1#" in plan.replace("L,", ",") and ", 12), REPARTITION_BY_NUM" in plan


def test_large_groups_are_looked_for_once(spark, monkeypatch):
    """Every group was counted and sorted three times, to find large ones, whether there were any or not."""
    lines = [(i % 97, i % 3, i * 7 % 31) for i in range(900)] + [(99, 0, i % 40) for i in range(60)] + [(7, 0, 3)] * 90
    lines += [(None, 0, i) for i in range(50)] + [(98, None, i) for i in range(50)] + [(98, 1, None)] * 50
    df = spark.createDataFrame(lines, BILL)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plans = [g.code_pairs(df, slice_codes=n)._jdf.queryExecution().executedPlan().toString() for n in (2_000, 30)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Join" not in plans[0] and plans[0].count("(_part") < plans[1].count("(_part") and "Join" in plans[1]
    want = brute(lines)
    options = [{}, {"slice_codes": 30, "min_rows": 80}, {"slice_codes": 39, "probe": df.select("serv_day", "std_chg_code")}]
    assert all(rows(g.code_pairs(df, **o)) == want for o in options)
    monkeypatch.setattr(g, "MOST_HOT", 0)
    assert rows(g.code_pairs(df, slice_codes=30)) == want
    assert rows(g.code_pairs(df.limit(0), slice_codes=30)) == []


def test_merge_is_the_full_outer_sum_and_threshold_comes_after(spark):
    schema = "id1 bigint, id2 bigint, weight bigint"
    a = spark.createDataFrame([(1, 2, 6), (1, 3, 9)], schema)
    b = spark.createDataFrame([(1, 2, 5), (2, 3, 10)], schema)
    outer = a.join(b.withColumnRenamed("weight", "w"), ["id1", "id2"], "full").select(
        "id1", "id2", (F.coalesce("weight", F.lit(0)) + F.coalesce("w", F.lit(0))).alias("weight")
    )
    merged = g.merge_edges(a, b)
    assert rows(merged) == rows(outer) == [(1, 2, 11), (1, 3, 9), (2, 3, 10)]
    assert rows(g.filter_edges(merged)) == [(1, 2, 11), (2, 3, 10)]
    assert g.edge_total(merged).first().total == 30
    assert [r.weight for r in g.top_edges(merged, 2).collect()] == [11, 10]
    assert rows(g.symmetrize(a)) == [(1, 2, 6), (1, 3, 9), (2, 1, 6), (3, 1, 9)]


def test_histogram_matches_numpy(spark):
    values = [1.0, 2.0, 2.5, 9.0, 10.0, 10.0, 4.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = rows(g.histogram(df, "x", 4), "bin", "low", "high", "n")
    counts, edges = np.histogram(values, 4)
    assert [r[3] for r in got] == counts.tolist()
    assert np.allclose([r[1] for r in got] + [got[-1][2]], edges)
    same = rows(g.histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", 2), "bin", "low", "high", "n")
    assert [r[3] for r in same] == np.histogram([3.0, 3.0], 2)[0].tolist()
