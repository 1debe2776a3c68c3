"""Source, sink, feature, fold and stay-table queries."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window, functions as F

from queries.cohort import total_of
from queries.common import draw, query, with_parts
from queries.sequence import LISTED, weighted
from stayframe.functions.arrays import dense_u8, last_n_reshape, one_hot
from stayframe.functions.hashing import key_draw
from stayframe.functions.sums import array_sum, grid_sum
from stayframe.operators import cohort as c, features as ft, folds, sequence as s
from stayframe.plans import fixtures as fx
from stayframe.plans.stay_table import build_stays, labelled_stays
from stayframe.session import bounded_session, scratch_path
from stayframe.sinks import writers as w
from stayframe.sources import readers as r, vectors

BILL_SCHEMA = "pat_key bigint, std_chg_code bigint, serv_day int, std_qty double"


@query("s1_read_delimited", with_parts("bill") + " select * from bill")
def read_delimited(spark, d):
    path = scratch_path(spark, "bill-text")
    w.write_delimited(fx.bill(spark, d), path)
    return r.read_delimited(spark, path, BILL_SCHEMA)


@query(
    "s1_read_inferred",
    with_parts("bill") + " select pat_key, std_chg_code, serv_day, cast(std_qty as double) as std_qty from bill",
)
def read_inferred(spark, d):
    path = scratch_path(spark, "bill-text")
    w.write_delimited(fx.bill(spark, d), path)
    read = r.read_delimited(spark, path)
    return read.select(
        F.col("pat_key").cast("bigint").alias("pat_key"),
        F.col("std_chg_code").cast("bigint").alias("std_chg_code"),
        "serv_day",
        F.col("std_qty").cast("double").alias("std_qty"),
    )


def _quarter_files(spark, d):
    """Charge lines in one folder of text files per quarter."""
    path = scratch_path(spark, "quarters")
    lines = fx.quarterly_bill(spark, d).repartitionByRange("yq", "pat_key")
    lines.write.option("header", True).option("sep", "|").partitionBy("yq").csv(path)
    return path


@query(
    "s2_quarter_paths",
    with_parts("adm", "bill")
    + """ select b.* from bill b join adm a on a.pat_key = b.pat_key
  where a.yq // 10 in (1996, 1997, 1998) and a.yq not in (19981)""",
)
def quarter_paths(spark, d):
    template = _quarter_files(spark, d) + "/yq={year}{quarter}"
    wanted = r.quarter_paths(template, range(1996, 1999), range(1, 5), skip=[(1998, 1)])
    return r.read_delimited(spark, wanted, BILL_SCHEMA)


@query(
    "u1_union_quarters",
    with_parts("adm", "bill")
    + " select b.* from bill b join adm a on a.pat_key = b.pat_key where a.yq is not null",
)
def union_quarters(spark, d):
    template = _quarter_files(spark, d) + "/yq={year}{quarter}"
    found = fx.stays(spark, d).select((F.col("yq") / 10).cast("int").alias("year"), (F.col("yq") % 10).alias("quarter"))
    have = sorted((row["year"], row["quarter"]) for row in found.distinct().collect())  # a few dozen quarters
    middle = have[len(have) // 2][0]
    early = sorted({year for year, _ in have if year < middle})
    late = sorted({year for year, _ in have if year >= middle})
    gaps = [(year, quarter) for year in late for quarter in range(1, 5) if (year, quarter) not in have]
    by_glob = r.read_delimited(spark, r.quarter_glob(template, early, range(1, 5)), BILL_SCHEMA)
    by_list = r.read_delimited(spark, r.quarter_paths(template, late, range(1, 5), skip=gaps), BILL_SCHEMA)
    return r.union_quarters([by_glob, by_list])


@query(
    "s3_register",
    "select l_returnflag, count(*) as n, round(sum(l_quantity), 4) as qty from lineitem group by l_returnflag",
)
def register(spark, d):
    r.register(spark, "charge_lines", f"{d}/lineitem.parquet")
    return spark.sql(
        "select l_returnflag, count(*) as n, round(sum(l_quantity), 4) as qty from charge_lines group by l_returnflag"
    )


@query(
    "s4_read_warehouse",
    "select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as cost from orders group by o_orderpriority",
)
def read_warehouse(spark, d):
    r.register(spark, "warehouse_orders", f"{d}/orders.parquet")
    return r.read_warehouse(
        spark,
        "select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as cost "
        "from warehouse_orders group by o_orderpriority",
    )


@query(
    "s5_list_tables",
    " union all ".join(f"select 'given_{t}' as name, count(*) as n from {t}" for t in fx.TABLES),
)
def list_tables(spark, d):
    """The given tables as the catalog lists them, each with its number of rows."""
    for name in fx.TABLES:
        r.register(spark, f"given_{name}", f"{d}/{name}.parquet")
    listed = [name for name in r.list_tables(spark) if name.startswith("given_")]
    counted = [spark.table(n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n in listed]
    return r.union_quarters(counted)


@query("s6_read_edges", with_parts("edges") + " select id1, id2, weight from edges")
@query("k3_write_edges", with_parts("edges") + " select id1, id2, weight from edges")
def edge_files(spark, d):
    path = scratch_path(spark, "edges")
    w.write_edges(fx.edges(spark, d), path)
    return r.read_edges(spark, path)


@query(
    "s7_embedding_table",
    with_parts("emb")
    + """ select code, row_number() over (order by code) - 1 as position, cast(64 as bigint) as len,
  round(list_sum(list_transform(v, lambda x: x::double)), 6) as total from emb
union all select -1, (select count(*) from emb), 64, 0""",
)
def embedding_table(spark, d):
    made = vectors.embedding_table(fx.vectors(spark, d), fx.WIDTH)
    return made.select("code", "position", F.size("v").cast("bigint").alias("len"), total_of("v").alias("total"))


def _stays(spark, d):
    return labelled_stays(fx.stays(spark, d), fx.readmissions(spark, d))


@query(
    "s8_read_folds",
    with_parts("labelled")
    + " select fold, count(*) as n, sum(mortality_label) as died from labelled where fold in (8, 9) group by fold",
)
def read_folds(spark, d):
    path = scratch_path(spark, "folds")
    w.write_folds(_stays(spark, d).select("pat_key", "mortality_label", "fold"), path)
    wanted = r.read_folds(spark, path, folds.VALIDATION_FOLDS + folds.TEST_FOLDS)
    return wanted.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("mortality_label").alias("died"))


@query(
    "k1_write_folds",
    with_parts("labelled")
    + """ select fold, count(*) as n, cast(sum(pat_key) as bigint) as keys, sum(los_label) as long_stays,
  round(sum(cost_label), 2) as cost from labelled group by fold""",
)
def write_folds(spark, d):
    path = scratch_path(spark, "folds")
    kept = ["pat_key", "mortality_label", "los_label", "readmit_label", "cost_label", "fold"]
    w.write_folds(_stays(spark, d).select(*kept), path)
    return spark.read.parquet(path).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("pat_key").alias("keys"),
        F.sum("los_label").alias("long_stays"),
        F.round(F.sum("cost_label"), 2).alias("cost"),
    )


@query(
    "k2_check_tensor_schema",
    """select 'vec_id' as name, count(*) filter (where vec_id is null) as n_null, cast(0 as bigint) as n_wrong_size
  from embeddings
union all select 'embedding', count(*) filter (where embedding is null),
  count(*) filter (where len(embedding) <> 64) from embeddings
union all select 'first10', count(*) filter (where embedding is null),
  count(*) filter (where len(list_slice(embedding, 1, 10)) <> 12) from embeddings""",
)
def check_tensor_schema(spark, d):
    table = fx.table(spark, d, "embeddings").withColumn("first10", F.slice("embedding", 1, 10))
    spec = {
        "vec_id": w.Tensor("bigint"),
        "embedding": w.Tensor("array<float>", 64),
        "first10": w.Tensor("array<float>", 12),
    }
    return w.check_tensor_schema(w.with_tensor_schema(table, spec), spec)


@query(
    "k4_profile",
    """select count(*) as n_rows, cast(4 as bigint) as n_cols, unnest(['pat_key', 'std_chg_code', 'serv_day', 'std_qty'])
  as name, unnest(['bigint', 'bigint', 'int', 'double']) as type from lineitem""",
)
def profile(spark, d):
    return w.profile(fx.bill(spark, d))


@query(
    "o4_shuffle_rows",
    with_parts("labelled")
    + f""" select fold, min({draw(1, "pat_key")}) as first_draw, max({draw(1, "pat_key")}) as last_draw,
  count(*) as n, cast(0 as bigint) as out_of_order from labelled group by fold""",
)
def shuffle_rows(spark, d):
    """Per fold: range of the draws, and how many rows of a written file come before their predecessor."""
    path = scratch_path(spark, "shuffled")
    folds.shuffle_rows(_stays(spark, d).select("pat_key", "fold")).write.partitionBy("fold").parquet(path)
    rows = spark.read.parquet(path).select(
        "fold",
        key_draw(folds.ORDER_SEED, "pat_key").alias("draw"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    # A file is one slice of one fold, written by one task.
    before = F.lag("draw").over(Window.partitionBy("fold", "file").orderBy("row"))
    return rows.withColumn("late", F.col("draw") < before).groupBy("fold").agg(
        F.min("draw").alias("first_draw"),
        F.max("draw").alias("last_draw"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("late").alias("out_of_order"),
    )


INDEXED = " union all ".join(
    f"select '{c}' as name, cast({c} as varchar) as value, count(*) as n from pats where {c} is not null group by 2"
    for c in ft.CATEGORIES
)


@query(
    "m1_category_index",
    with_parts("pats")
    + f""", counted as ({INDEXED})
select name, value, n, row_number() over (partition by name order by n desc, value) - 1 as idx from counted""",
)
def category_index(spark, d):
    stays = c.attach_readmit(c.cohort(fx.stays(spark, d)), c.days_to_next(fx.readmissions(spark, d)))
    return ft.category_index(stays, ft.CATEGORIES)


WIDTH = " union all ".join(
    f"select {i} as place, '{c}' as name, cast({c} as varchar) as value, count(*) as n"
    f" from pats where {c} is not null group by 3"
    for i, c in enumerate(ft.CATEGORIES)
)
HOT = f""", counted as ({WIDTH}),
indexed as (select *, row_number() over (partition by name order by n desc, value) - 1 as idx from counted),
offsets as (select place, name, count(*) as width, sum(count(*)) over (order by place) - count(*) as start
  from indexed group by place, name),
places as (select i.name, i.value, o.start + i.idx as pos from indexed i join offsets o on i.name = o.name),
long as (unpivot (select pat_key, {", ".join(f"cast({c} as varchar) as {c}" for c in ft.CATEGORIES)} from pats)
  on {", ".join(ft.CATEGORIES)} into name name value value)
select l.pat_key, cast(sum(p.pos) as bigint) as positions, count(*) as ones, cast(any_value(a.age) % 256 as smallint) as age
from long l join places p on l.name = p.name and l.value = p.value join pats a on a.pat_key = l.pat_key group by l.pat_key"""


def _hot(df):
    """Sum of the positions of the ones among the category slots, their number, and the age in the last slot."""
    slots = df.select(
        "pat_key", F.element_at("features", -1).alias("age"), F.posexplode(F.slice("features", F.lit(1), F.size("features") - 1)).alias("pos", "x")
    )
    return slots.groupBy("pat_key", "age").agg(
        F.sum(F.when(F.col("x") == 1, F.col("pos")).otherwise(0)).alias("positions"),
        F.count_if(F.col("x") == 1).alias("ones"),
    )


@query(
    "f4_dense_u8_wrap",
    with_parts("adm")
    + """ select pat_key, cast(i as integer) as place, cast((trunc(x)::bigint % 256 + 256) % 256 as smallint) as value
from (select pat_key, unnest([proj_wgt::double, pat_cost::double, -pat_cost / 7, los / 2.0::double, 0]) as x, unnest(range(5)) as i
  from adm where los is not null)""",
)
def dense_u8_wrap(spark, d):
    """Balances below zero and costs above 255: cut to whole numbers and wrapped."""
    x = [F.col(c).cast("double") for c in ("proj_wgt", "pat_cost")] + [-F.col("pat_cost") / 7, F.col("los") / 2.0, F.lit(0.0)]
    stays = fx.stays(spark, d).where("los is not null").select("pat_key", array_to_vector(F.array(*x)).alias("v"))
    return stays.select("pat_key", F.posexplode(dense_u8("v")).alias("place", "value"))


@query("m1_features", with_parts("pats") + HOT)
@query("f4_dense_u8", with_parts("pats") + HOT)
def features(spark, d):
    stays = c.cohort(fx.stays(spark, d))
    return _hot(ft.apply_features(ft.fit_features(stays), stays).withColumn("features", dense_u8("features")))


@query("s9_load_features", with_parts("pats") + HOT)
def load_features(spark, d):
    stays = c.cohort(fx.stays(spark, d))
    path = scratch_path(spark, "features")
    ft.fit_features(stays).write().overwrite().save(path)
    return _hot(ft.apply_features(r.load_features(path), stays).withColumn("features", dense_u8("features")))


@query(
    "m2_feature_tier",
    with_parts("adm") + f" select pat_key, {', '.join(ft.DEMOGRAPHICS + ft.ADMISSION)} from adm where los > 1",
)
def feature_tier(spark, d):
    return ft.feature_tier(c.cohort(fx.stays(spark, d)), "admission")


@query(
    "m2_feature_tier_demographics",
    with_parts("adm") + f" select pat_key, {', '.join(ft.DEMOGRAPHICS)} from adm where los > 1",
)
def feature_tier_demographics(spark, d):
    return ft.feature_tier(c.cohort(fx.stays(spark, d)), "demographics")


@query(
    "m2_feature_tier_first_day",
    with_parts("adm", "ranked", "emb")
    + LISTED.format(n=3)
    + f"""select a.pat_key, {', '.join('a.' + x for x in ft.DEMOGRAPHICS + ft.ADMISSION)}, t.total
from adm a join (select pat_key, round(coalesce(sum(list_sum(list_transform(v, lambda x: x::double))), 0), 4) as total
  from cells group by pat_key) t on a.pat_key = t.pat_key where a.los > 1""",
)
def feature_tier_first_day(spark, d):
    sequences = s.event_sequence(c.bill_window(fx.bill(spark, d)), fx.vectors(spark, d), n=3, dim=fx.WIDTH)
    stays = s.attach_features(sequences, c.cohort(fx.stays(spark, d))).where(F.col("los").isNotNull())
    total = F.round(array_sum("embedding"), 4)
    return ft.feature_tier(stays, "first_day").withColumn("total", total).drop("embedding")


@query(
    "m2_feature_tier_first_day_full",
    with_parts("adm", "ranked", "emb")
    + LISTED.format(n=100)
    + f"""select a.pat_key, {', '.join('a.' + x for x in ft.DEMOGRAPHICS + ft.ADMISSION)}, t.total
from adm a join (select pat_key, round(coalesce(sum(list_sum(list_transform(v, lambda x: x::double))), 0), 4) as total
  from cells group by pat_key) t on a.pat_key = t.pat_key where a.los > 1""",
)
def feature_tier_first_day_full(spark, d):
    sequences = s.event_sequence(c.bill_window(fx.bill(spark, d)), fx.vectors(spark, d), n=100, dim=fx.WIDTH)
    stays = s.attach_features(sequences, c.cohort(fx.stays(spark, d))).where(F.col("los").isNotNull())
    total = F.round(array_sum("embedding"), 4)
    return ft.feature_tier(stays, "first_day").withColumn("total", total).drop("embedding")


@query(
    "x3_mix",
    with_parts("adm")
    + f""" select pat_key, std_payor, row_number() over
  (partition by std_payor order by {draw(1, "std_payor", "pat_key")}, pat_key) as turn from adm where los > 1""",
)
def mix(spark, d):
    stays = c.cohort(fx.stays(spark, d)).select("pat_key", "std_payor")
    return folds.interleave(stays, "std_payor")


@query(
    "x4_with_batch_id",
    with_parts("labelled")
    + f""" select fold, pat_key, (row_number() over
  (partition by fold order by {draw(1, "fold", "pat_key")}, pat_key) - 1) // 128 as batch from labelled""",
)
def with_batch_id(spark, d):
    stays = folds.assign_fold(c.cohort(fx.stays(spark, d))).select("fold", "pat_key")
    return folds.with_batch_id(stays, 128)


# The position-weighted sum of a stay's features: one-hot places as the training folds know them, then the age.
FEATURES = " union all ".join(
    f"select {i} as place, '{c}' as name, cast({c} as varchar) as value, count(*) as n"
    f" from labelled where {c} is not null and fold < 8 group by 3"
    for i, c in enumerate(ft.CATEGORIES)
)
FEATURES = f""", feat_counted as ({FEATURES}),
feat_indexed as (select *, row_number() over (partition by name order by n desc, value) - 1 as idx from feat_counted),
feat_offsets as (select place, name, count(*) as width, sum(count(*)) over (order by place) - count(*) as start
  from feat_indexed group by place, name),
feat_places as (select i.name, i.value, o.start + i.idx as pos from feat_indexed i join feat_offsets o on i.name = o.name),
feat_long as (unpivot (select pat_key, {", ".join(f"cast({c} as varchar) as {c}" for c in ft.CATEGORIES)} from labelled)
  on {", ".join(ft.CATEGORIES)} into name name value value),
feat as (select l.pat_key, cast(coalesce(sum(p.pos + 1), 0) + (select sum(width) + 1 from feat_offsets) * (any_value(a.age) % 256) as bigint) as features
  from feat_long l left join feat_places p on l.name = p.name and l.value = p.value join labelled a on a.pat_key = l.pat_key group by l.pat_key)
"""
WEIGHED = """, seq as (select pat_key, count(*) as steps,
    round(coalesce(sum(list_sum(list_transform(v, lambda x, i: x::double * (64 * step + i)))), 0), 4) as weighted
  from cells group by pat_key)"""


def _weighed(features):
    """The position-weighted sum of the features."""
    return F.aggregate(F.transform(features, lambda x, i: x.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda t, x: t + x)


@query(
    "k2_export_stays",
    with_parts("labelled", "ranked", "emb")
    + LISTED.format(n=100)
    + WEIGHED
    + FEATURES
    + """
select l.pat_key, l.fold, case when l.fold < 8 then 'train' when l.fold = 8 then 'validation' else 'test' end as role,
  s.steps, cast(64 as bigint) as width, s.weighted, f.features,
  cast(l.los_label = 0 as integer) as los0, cast(l.los_label = 1 as integer) as los1
from labelled l join seq s on l.pat_key = s.pat_key join feat f on l.pat_key = f.pat_key""",
)
def export_stays(spark, d):
    """The stay table written by fold with its tensor schema, checked, and all ten folds read back by role and reshaped."""
    table = build_stays(fx.stays(spark, d), fx.bill(spark, d), fx.readmissions(spark, d), fx.vectors(spark, d), dim=fx.WIDTH)
    path = scratch_path(spark, "export")
    features = table.select(F.size("features")).first()[0]
    spec = w.stay_spec(100, fx.WIDTH, features)
    w.write_folds(table, path, spec=spec)
    # A row's sequence and its grid have tens of kilobytes, so few rows are read and summed at once.
    apart = bounded_session(spark, w.spec_bytes(spec))
    parts = [r.read_folds(apart, path, x) for x in (folds.TRAIN_FOLDS, folds.VALIDATION_FOLDS, folds.TEST_FOLDS)]
    rows = folds.with_role(parts[0].unionByName(parts[1]).unionByName(parts[2])).select(
        "pat_key", "fold", "role", "features", last_n_reshape("embedding", 100, fx.WIDTH).alias("m"), one_hot("los_label").alias("los")
    )
    told = rows.select(
        "pat_key",
        "fold",
        "role",
        F.size("m").cast("bigint").alias("steps"),
        F.size(F.col("m")[0]).cast("bigint").alias("width"),
        F.round(grid_sum("m"), 4).alias("weighted"),
        _weighed(F.col("features")).alias("features"),
        F.col("los")[0].alias("los0"),
        F.col("los")[1].alias("los1"),
    )
    # Written out, as the batches are bounded in the session that reads the folds only.
    out = scratch_path(spark, "exported")
    told.write.parquet(out)
    return spark.read.parquet(out)


@query(
    "c2_build_stays",
    with_parts("labelled", "ranked", "emb")
    + LISTED.format(n=100)
    + WEIGHED
    + FEATURES
    + """
select l.pat_key, cast(6400 as bigint) as len, s.weighted, f.features, l.mortality_label, l.los_label, l.readmit_label,
  round(l.cost_label, 6) as cost_label, l.fold
from labelled l join seq s on l.pat_key = s.pat_key join feat f on l.pat_key = f.pat_key""",
)
def stay_table(spark, d):
    table = build_stays(fx.stays(spark, d), fx.bill(spark, d), fx.readmissions(spark, d), fx.vectors(spark, d), dim=fx.WIDTH)
    kept = ["pat_key", "features", "mortality_label", "los_label", "readmit_label", "cost_label", "fold"]
    return weighted(table, fx.WIDTH, kept).withColumns(
        {"cost_label": F.round("cost_label", 6), "weighted": F.coalesce("weighted", F.lit(0.0)), "features": _weighed(F.col("features"))}
    ).drop("first_at")
