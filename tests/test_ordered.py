import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from stayframe.operators import ordered as o, skew


def sample(spark, n=400):
    """A third of the rows in one group, another share under a null key."""
    rng = random.Random(3)
    data = []
    for i in range(n):
        group = 7 if i % 3 == 0 else (None if i % 7 == 0 else rng.randrange(40))
        data.append((group, rng.randrange(5), i, rng.choice([None, 1, 2, 3, 5])))
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "g bigint, month int, id bigint, x bigint").repartition(5)


def expected(data):
    out = []
    for group in {d[0] for d in data}:
        mine = sorted((d for d in data if d[0] == group), key=lambda d: (d[1], d[2]))
        for i, d in enumerate(mine):
            before = [x[3] for x in mine[: i + 1] if x[3] is not None]
            out.append(
                (
                    *d[:3],
                    sum(before) if before else None,
                    min(before) if before else None,
                    mine[i + 1][3] if i + 1 < len(mine) else None,
                    mine[i - 1][3] if i else None,
                )
            )
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


@pytest.mark.parametrize("min_rows,per_chunk", [(10**6, 10**6), (20, 7), (1, 1)])
def test_scan_groups_matches_brute_force(spark, min_rows, per_chunk):
    data, df = sample(spark)
    done = o.scan_groups(
        df,
        ["g"],
        ["month", "id"],
        exact=["month"],
        cut="id",
        min_rows=min_rows,
        rows_per_chunk=per_chunk,
        sums={"total": F.col("x")},
        mins={"low": F.col("x")},
        leads={"after": F.col("x")},
        lags={"before": F.col("x")},
    )
    assert rows(done, "g", "month", "id", "total", "low", "after", "before") == expected(data)


def test_number_rows_over_chunks(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(6)
    numbered = rows(o.number_rows(df, ["k"], "n", rows_per_chunk=30), "k", "n")
    assert [n for _, n in numbered] == list(range(1, 1001))


def test_quantile_chunks_follow_the_order_and_stay_small(spark):
    df = spark.range(1000).select(F.when(F.col("id") > 5, F.col("id") * F.col("id")).alias("v"))
    chunked = o.with_quantile_chunks(df, F.col("v"), rows_per_chunk=50)
    got = [tuple(r) for r in chunked.select("v", o.CHUNK).collect()]
    ordered = sorted(got, key=lambda r: (r[0] is not None, r[0]))
    chunks = [c for _, c in ordered]
    assert chunks == sorted(chunks)
    assert max(chunks.count(c) for c in set(chunks)) <= 110
    assert len(set(chunks)) >= 18


def test_small_frames_are_not_chunked(spark):
    assert o.CHUNK not in o.with_quantile_chunks(spark.range(50), F.col("id")).columns


def test_hot_keys_finds_the_large_group_only(spark):
    _, df = sample(spark)
    hot = skew.hot_keys(df, ["g"], min_rows=100)
    assert [r.g for r in df.where(skew.is_hot(["g"], hot)).select("g").distinct().collect()] == [7]
    assert skew.hot_keys(df, ["g"]) == []


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
@pytest.mark.parametrize("options", [{}, {"min_rows": 50}, {"broadcast_rows": 1000}, {"min_rows": 50, "broadcast_rows": 3}])
def test_lookup_paths_agree(spark, how, options):
    _, df = sample(spark)
    one = spark.createDataFrame([(g, f"v{g}") for g in range(0, 30)], "g int, v string")
    got = skew.lookup(df, one, ["g"], how, **options)
    assert rows(got, *sorted(got.columns)) == rows(df.join(one, "g", how), *sorted(got.columns))


def test_lookup_null_safe_keeps_null_keys(spark):
    _, df = sample(spark)
    one = spark.createDataFrame([(None, "none"), (7, "seven")], "g bigint, v string")
    for min_rows in (10**6, 30):
        got = skew.lookup(df, one, ["g"], null_safe=True, min_rows=min_rows)
        assert got.where("g is null and v = 'none'").count() == df.where("g is null").count()
        assert got.where("g = 7 and v = 'seven'").count() == df.where("g = 7").count()
        assert got.count() == df.count()


def test_text_keys_are_cut_like_numbers(spark):
    names = [f"key-{i * 37 % 101:03d}é" for i in range(101)] + ["key-", "key-05"]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "k string")
    expected = [(n, i) for i, n in enumerate([None, *sorted(names, key=lambda n: n.encode())], 1)]
    for per_chunk in (1000, 7):
        found = o.number_rows(df, ["k"], "n", rows_per_chunk=per_chunk).orderBy("n").collect()
        assert [(r.k, r.n) for r in found] == expected
    assert "_chunk" in o.with_quantile_chunks(df, F.col("k"), 7).columns
