import pytest
from pyspark.sql import functions as F

from conftest import rows
from stayframe.functions import arrays, sums
from stayframe.operators import sequence as s
from stayframe.operators.cohort import bill_window
from stayframe.plans import fixtures as fx
from stayframe.plans.stay_table import OUTPUT, build_stays
from stayframe.sources.vectors import embedding_table

BILL = "pat_key bigint, std_chg_code bigint, serv_day int, std_qty double"


@pytest.fixture(scope="module")
def emb(spark):
    return spark.createDataFrame([(c, [float(c), c / 2.0]) for c in range(1, 300)], "code bigint, v array<float>")


def test_sequence_order_padding_and_unknown_codes(spark, emb):
    lines = [(1, 5, 0, 1.0), (1, 5, 1, 1.0), (1, 5, 1, 9.0), (1, 900, 0, 1.0), (1, 2, 0, 1.0), (2, None, 0, 1.0)]
    got = dict(rows(s.event_sequence(spark.createDataFrame(lines, BILL), emb, n=5, dim=2)))
    # Rank 1 (code 2) last; code 5 of day 1 before day 0; code 900 has no vector; one empty slot first.
    assert got[1] == [0, 0, 0, 0, 5, 2.5, 5, 2.5, 2, 1]
    assert got[2] == [0.0] * 10


def test_later_ranks_vanish(spark, emb):
    lines = [(1, c, 0, 1.0) for c in range(1, 151)]
    df = spark.createDataFrame(lines, BILL).repartition(7)
    flat = s.event_sequence(df, emb, n=100, dim=2).first().embedding
    assert flat[::2] == [float(c) for c in range(100, 0, -1)]


def test_array_form_equals_scaffold_form(spark, emb):
    bill = spark.range(300).select(
        (F.col("id") % 23).alias("pat_key"),
        (F.col("id") * 13 % 40).alias("std_chg_code"),
        (F.col("id") % 2).cast("int").alias("serv_day"),
        F.lit(1.0).alias("std_qty"),
    )
    placed = s.embed_events(s.fill_slots(s.slot_join(bill, 8)), emb)
    placed = placed.withColumn("v", arrays.default_vector("v", 2))
    listed = placed.groupBy("pat_key").agg(F.sort_array(F.collect_list(F.struct("rank", "v")), asc=False).alias("e"))
    scaffold = listed.select("pat_key", arrays.flatten_seq("e.v").alias("embedding"))
    for codes in (200_000, 0):
        assert rows(s.event_sequence(bill, emb, 8, 2, broadcast_codes=codes)) == rows(scaffold)


def test_rank_events_shares_ranks_and_splits_hot_stays(spark):
    lines = [(1, 5, 0, 1.0), (1, 5, 0, 2.0), (1, 5, 1, 1.0), (1, None, 0, 1.0), (1, 7, 0, 1.0)]
    lines += [(2, c % 60, c % 2, float(c)) for c in range(400)] + [(2, 3, 1, -1.0)] * 200
    lines += [(p, p, 0, 1.0) for p in range(3, 60)]
    df = spark.createDataFrame(lines, BILL).repartition(5)
    plain = rows(s.rank_events(df))
    assert [r[4] for r in plain if r[0] == 1] == [1, 3, 3, 2, 4]
    assert rows(s.rank_events(df, min_rows=40, rows_per_chunk=11), *BILL_COLS, "rank") == rows(s.rank_events(df), *BILL_COLS, "rank")


BILL_COLS = ["pat_key", "std_chg_code", "serv_day", "std_qty"]


def test_embedding_table_ends_with_the_pad_row(spark, emb):
    table = rows(embedding_table(emb, dim=2), "position", "code", "v")
    assert table[0][:2] == (0, 1) and table[-1] == (299, -1, [0.0, 0.0])


def test_arrays(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.sparse(4, {0: 300.7, 2: -1.0, 3: 5.0}),)], ["v"])
    assert df.select(arrays.dense_u8("v").alias("a")).first().a == [44, 0, 255, 5]
    one = spark.range(1)
    flat = F.array(*[F.lit(float(i)) for i in range(7)])
    assert one.select(arrays.last_n_reshape(flat, 3, 2).alias("m")).first().m == [[1, 2], [3, 4], [5, 6]]
    assert one.select(arrays.one_hot(F.lit(1), 3).alias("h")).first().h == [0, 1, 0]
    six = F.array(*[F.lit(float(i)) for i in range(6)])
    assert one.select(arrays.mean_pool(six, 3, 2).alias("p")).first().p == [2.0, 3.0]


def test_stay_table_drops_or_keeps_stays_without_charges(spark):
    d = "/root/testdata/sf0.001"
    parts = (fx.stays(spark, d), fx.bill(spark, d).where("pat_key % 5 <> 0"), fx.readmissions(spark, d), fx.vectors(spark, d))
    usual = build_stays(*parts, n=4)
    everyone = build_stays(*parts, n=4, keep_empty=True)
    assert usual.count() < everyone.count() == fx.stays(spark, d).where("los > 1").count()
    empty = everyone.join(usual, "pat_key", "left_anti").first()
    assert empty.embedding == [0.0] * 40
    assert {len(r.features) for r in everyone.select("features").collect()} == {len(usual.first().features)}


def test_stay_table_takes_pooled_vectors_in_one_pass(spark):
    """The mean vector of a stay's events in place of the sequence, for the same stays and without a second pass over the events."""
    d = "/root/testdata/sf0.001"
    bill = fx.bill(spark, d).where("pat_key % 5 <> 0")
    parts = (fx.stays(spark, d), bill, fx.readmissions(spark, d), fx.vectors(spark, d))
    means = s.pooled_events(bill_window(bill), fx.vectors(spark, d), dim=fx.WIDTH)
    want = build_stays(*parts, dim=fx.WIDTH).drop("embedding").join(means, "pat_key")
    made = build_stays(*parts, dim=fx.WIDTH, pooled=True)
    assert made.columns == [c if c != "embedding" else "pooled" for c in OUTPUT]
    assert rows(made, *want.columns) == rows(want) and want.count() > 500
    everyone = build_stays(*parts, dim=fx.WIDTH, pooled=True, keep_empty=True)
    assert everyone.join(made, "pat_key", "left_anti").first().pooled == [0.0] * fx.WIDTH


def test_long_lists_are_made_by_many_tasks(spark):
    """A few kilobytes of events became hundreds of megabytes of lists in a single task."""
    bill = spark.range(4000).select(F.col("id").alias("pat_key"), (F.col("id") % 7).alias("std_chg_code"), F.lit(0).alias("serv_day"), F.lit(1.0).alias("std_qty"))
    emb = spark.range(7).select(F.col("id").alias("code"), F.array(F.lit(0.5), F.col("id").cast("double")).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    try:
        flat = s.event_sequence(bill, emb, n=100, dim=2)
        tasks = flat.select(F.spark_partition_id().alias("task")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert tasks >= 4


def test_sums_of_arrays_are_those_of_lambdas(spark):
    lists = [[0.1, -3.0, 1e9, 0.7], [], None, [0.0, 0.0, 2.5], [0.0], [1.5, None, 2.0], [float("nan"), 1.0], [None, 0.0, 4.0]] * 3
    df = spark.createDataFrame([(i, x, [x, [0.3, 0.1, 0.2]] if i % 5 else None) for i, x in enumerate(lists)], "k int, a array<float>, m array<array<float>>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x.cast("double"))
    placed = lambda a: total(F.transform(a, lambda x, i: x.cast("double") * (i + 1)))
    first = F.array_min(F.transform("a", lambda x, i: F.when(x != 0, i.cast("bigint"))))
    run = F.transform(F.sequence(F.lit(0), F.ceil(F.size("a") / 2).cast("int") - 1), lambda i: F.slice("a", i * 2 + 1, F.lit(2)))
    runs = F.when(F.size("a") > 0, F.transform(run, placed)).when(F.size("a") == 0, F.array().cast("array<double>"))
    grid = total(F.transform("m", lambda v, k: total(F.transform(v, lambda x, i: x.cast("double") * (k * F.size(v) + i + 1)))))
    pairs = {
        "sum": (sums.array_sum("a"), total(F.col("a"))),
        "placed": (sums.placed_sum("a"), placed(F.col("a"))),
        "each": (sums.each_sum("m"), F.transform("m", total)),
        "runs": (sums.runs_placed_sum("a", 2), runs),
        "grid": (sums.grid_sum("m"), grid),
        "first": (sums.first_filled("a"), first),
    }
    for name, (found, wanted) in pairs.items():
        got = df.select("k", found.cast("string").alias("x"), wanted.cast("string").alias("y")).collect()
        assert all(r.x == r.y for r in got), (name, [tuple(r) for r in got if r.x != r.y])
