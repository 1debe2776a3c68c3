"""The given star-schema tables seen as stays, charges, readmissions, vectors and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stayframe.operators.cooccurrence import code_pairs
from stayframe.operators.ordered import scan_groups
from stayframe.operators.skew import lookup

# Values of a given vector.
WIDTH = 64
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _month(date: str):
    return (F.year(date) * 100 + F.month(date)).cast("int")


def _with_customer(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return lookup(orders.withColumn("c_custkey", F.col("o_custkey")), customers, ["c_custkey"], "inner")


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, with every admission column and the patient and quarter keys."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    length = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pat_key")).agg(
        F.max("l_linenumber").alias("los")
    )
    known = _with_customer(orders, customers).select(
        F.col("o_orderkey").alias("pat_key"),
        F.col("o_custkey").alias("medrec_key"),
        _month("o_orderdate").alias("disc_mon"),
        (F.year("o_orderdate") * 10 + F.quarter("o_orderdate")).alias("yq"),
        _month("o_orderdate").alias("adm_mon"),
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("disc_mon_seq"),
        F.substring("o_orderpriority", 1, 1).alias("adm_source"),
        (F.col("c_nationkey") % 5).alias("point_of_origin"),
        F.col("o_orderpriority").alias("adm_type"),
        F.when(F.col("c_acctbal") < 0, "S").otherwise("M").alias("mart_status"),
        (F.col("c_custkey") % 90).cast("int").alias("age"),
        F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("gender"),
        (F.col("c_nationkey") % 6).alias("race"),
        F.when(F.col("c_nationkey") % 4 == 0, "Y").otherwise("N").alias("hispanic_ind"),
        F.col("c_mktsegment").alias("std_payor"),
        F.col("c_nationkey").alias("prov_id"),
        (F.col("o_custkey") % 7).cast("int").alias("admphy_spec"),
        (F.col("o_custkey") % 101).cast("int").alias("adm_phy"),
        (F.col("o_orderkey") % 7).cast("int").alias("attphy_spec"),
        (F.col("o_orderkey") % 101).cast("int").alias("att_phy"),
        F.col("c_acctbal").alias("proj_wgt"),
        F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"), 20)
        .otherwise(1)
        .alias("disc_status"),
        F.col("o_totalprice").alias("pat_cost"),
    )
    return known.join(length, "pat_key", "left")


def bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line; the line number stands for the service day."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pat_key"),
        F.col("l_partkey").alias("std_chg_code"),
        (F.col("l_linenumber") - 1).alias("serv_day"),
        F.col("l_quantity").alias("std_qty"),
    )


def quarterly_bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charge lines with the quarter of their order."""
    quarter = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pat_key"), (F.year("o_orderdate") * 10 + F.quarter("o_orderdate")).alias("yq")
    )
    return lookup(bill(spark, sf_dir), quarter, ["pat_key"], "inner")


def readmissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with the days since the customer's order before."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pat_key"),
        F.col("o_custkey").alias("medrec_key"),
        _month("o_orderdate").alias("disc_mon"),
        F.to_date("o_orderdate").alias("o_date"),
        "o_orderdate",
    )
    before = scan_groups(
        rows,
        ["medrec_key"],
        ["o_orderdate", "pat_key"],
        exact=["o_orderdate"],
        cut="pat_key",
        lags={"_before": F.col("o_date")},
    )
    return before.select(
        "pat_key", "medrec_key", "disc_mon", F.datediff("o_date", "_before").alias("days_from_prior")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, v): the given vectors, ``WIDTH`` values each."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("code"), F.col("embedding").alias("v"))


def ball_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, v): the given vectors halved, as whole they have length 1 and lie on the ball's edge."""
    half = F.transform("v", lambda x: x * F.lit(0.5).cast("float"))
    return vectors(spark, sf_dir).withColumn("v", half)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_pairs(bill(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, score with many ties, run, grp, p0, p1)."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    p = F.col("o_totalprice") / (F.col("o_totalprice") + F.lit(200000.0))
    return _with_customer(orders, customers).select(
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.round(F.col("o_totalprice") / 1000).alias("score"),
        F.col("o_orderpriority").alias("run"),
        F.col("c_mktsegment").alias("grp"),
        p.alias("p1"),
        (1 - p).alias("p0"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, epoch, val_loss): a loss history per event type and day."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("run"), F.day("ts").alias("epoch"))
        .agg(F.round(F.avg("value"), 6).alias("val_loss"))
    )
