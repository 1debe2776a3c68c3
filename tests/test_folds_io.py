import pyarrow as pa
from pyspark.sql import functions as F

from conftest import rows
from stayframe import session
from stayframe.functions.hashing import row_id
from stayframe.operators import folds
from stayframe.session import bounded_session, scratch_path
from stayframe.sinks import writers as w
from stayframe.sources import readers as r


def stays(spark, n=2000):
    return folds.assign_fold(spark.range(n).select(F.col("id").alias("pat_key")))


def test_folds_are_repeatable_disjoint_and_even(spark):
    a, b = rows(stays(spark)), rows(stays(spark).repartition(7))
    assert a == b
    parts = folds.split(stays(spark))
    keys = [set(x.pat_key for x in p.collect()) for p in parts.values()]
    assert sum(map(len, keys)) == 2000 == len(set.union(*keys))
    sizes = [r["count"] for r in stays(spark).groupBy("fold").count().collect()]
    assert len(sizes) == 10 and min(sizes) > 140
    assert set(x.role for x in folds.with_role(stays(spark)).select("role").collect()) == {"train", "validation", "test"}


def test_written_folds_read_back_with_pruning(spark):
    path = scratch_path(spark, "t-folds")
    table = stays(spark).withColumn("v", F.array(F.lit(1.0), F.lit(2.0)))
    spec = {"pat_key": w.Tensor("bigint"), "v": w.Tensor("array<float>", 2)}
    w.write_folds(table, path, spec=spec, files_per_fold=2)
    back = r.read_folds(spark, path, [8, 9])
    assert rows(back.select("pat_key")) == rows(table.where("fold in (8, 9)").select("pat_key"))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [fold" in plan
    assert back.schema["v"].metadata == {"dtype": "array<float>", "shape": [2]}
    assert r.read_folds(spark, path, [77]).count() == 0
    files = back.select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 4


def test_tensor_check_counts_violations(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0]), (3, None)], "k int, v array<double>")
    spec = {"k": w.Tensor("int"), "v": w.Tensor("array<float>", 2)}
    assert rows(w.check_tensor_schema(df, spec)) == [("k", 1, 0), ("v", 1, 1)]


def test_mix_gives_each_source_one_row_per_turn(spark):
    a = spark.range(5).select(F.col("id").alias("pat_key"))
    b = spark.range(100, 103).select(F.col("id").alias("pat_key"))
    mixed = [tuple(x) for x in folds.mix([a, b]).select("turn", "source", "pat_key").collect()]
    assert [t for t, _, _ in mixed] == [1, 1, 2, 2, 3, 3, 4, 5]
    assert sorted(k for _, _, k in mixed) == [0, 1, 2, 3, 4, 100, 101, 102]


def test_batches_are_full_but_the_last(spark):
    batched = folds.with_batch_id(stays(spark), 16)
    sizes = rows(batched.groupBy("fold", "batch").count())
    for fold in range(10):
        mine = [n for f, _, n in sizes if f == fold]
        assert all(n == 16 for n in mine[:-1]) and 0 < mine[-1] <= 16


def test_quarter_paths_and_glob():
    template = "/d/adm_{year}{quarter}_bill.txt"
    paths = r.quarter_paths(template, range(2010, 2019), range(1, 5), skip=[(2018, 4)])
    assert len(paths) == 35 and paths[0] == "/d/adm_20101_bill.txt" and paths[-1] == "/d/adm_20183_bill.txt"
    assert r.quarter_glob(template, [2013, 2014], [1, 2]) == "/d/adm_{2013,2014}{1,2}_bill.txt"


def test_text_round_trip_and_jdbc_options(spark):
    path = scratch_path(spark, "t-text")
    df = spark.createDataFrame([(1, "a|b", None), (2, "", 2.5)], "k int, s string, x double")
    w.write_delimited(df, path)
    assert rows(r.read_delimited(spark, path, "k int, s string, x double").select("k", "x")) == [(1, None), (2, 2.5)]
    assert r.read_delimited(spark, path).schema["k"].dataType.simpleString() == "int"
    split = r.jdbc_options("select 1", "jdbc:x", "k", 0, 9, 3)
    assert split["dbtable"] == "(select 1) result" and split["numPartitions"] == "3"


def test_profile_and_row_id(spark):
    df = spark.range(7)
    assert rows(w.profile(df)) == [(7, 1, "id", "bigint")]
    assert df.select(row_id("id").alias("r")).distinct().count() == 7


def test_long_rows_are_read_in_batches_of_bounded_bytes(spark, monkeypatch):
    """Rows of tens of kilobytes were read 4,096 at a time and sent to Python 10,000 at a time."""
    path = scratch_path(spark, "t-long")
    spark.range(500).select("id", F.array_repeat(F.lit(0.5), 1000).alias("v")).coalesce(1).write.parquet(path)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": [batch.num_rows]})

    before = {k: spark.conf.get(k) for k in session._BATCHES}
    apart = bounded_session(spark, 8000, 80_000)
    assert apart.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    found = [r["id"] for r in apart.read.parquet(path).mapInArrow(sizes, "id bigint").collect()]
    assert max(found) <= 10 and sum(found) == 500
    assert before == {k: spark.conf.get(k) for k in session._BATCHES}
    asked = []
    monkeypatch.setattr(w, "bounded_session", lambda spark, size: asked.append(size) or bounded_session(spark, size))
    table = stays(spark).withColumn("v", F.array(F.lit(1.0), F.lit(2.0)))
    w.write_folds(table, scratch_path(spark, "t-check"), spec={"pat_key": w.Tensor("bigint"), "v": w.Tensor("array<float>", 2)})
    assert asked == [24]
