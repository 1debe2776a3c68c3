"""Event rank, slots, lookup and sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.cohort import total_of
from queries.common import query, with_parts
from stayframe.functions import arrays, sums
from stayframe.functions.hashing import row_id
from stayframe.operators import cohort as c, sequence as s
from stayframe.operators.skew import lookup
from stayframe.plans import fixtures as fx


def _window(spark, d):
    return c.bill_window(fx.bill(spark, d))


RANK_ALL = """ select pat_key, std_chg_code, serv_day, std_qty,
  dense_rank() over (partition by pat_key order by std_chg_code, serv_day desc) as rank from bill"""


@query("w2_rank_events", with_parts("bill") + RANK_ALL)
def rank_events(spark, d):
    return s.rank_events(fx.bill(spark, d))


SLOTS = """select pat_key, cast(n as bigint) as rank
from (select distinct pat_key from windowed) k, range(1, 101) r(n)"""


@query("w3_slot_numbers", with_parts("windowed") + SLOTS)
def slot_numbers(spark, d):
    return s.slots(_window(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


@query("j8_slots", with_parts("windowed") + SLOTS.replace("101", "6"))
def slots(spark, d):
    return s.slots(_window(spark, d), 5).withColumn("rank", F.col("rank").cast("bigint"))


JOINED = """ select k.pat_key, cast(n as bigint) as rank, r.std_chg_code, r.serv_day, r.std_qty
from (select distinct pat_key from windowed) k cross join range(1, 4) x(n)
left join ranked r on k.pat_key = r.pat_key and x.n = r.rank"""


@query("j3_slot_join", with_parts("windowed", "ranked") + JOINED)
def slot_join(spark, d):
    return s.slot_join(_window(spark, d), 3).withColumn("rank", F.col("rank").cast("bigint"))


@query("j3_slot_join_full", with_parts("windowed", "ranked") + JOINED.replace("range(1, 4)", "range(1, 101)"))
def slot_join_full(spark, d):
    return s.slot_join(_window(spark, d), 100).withColumn("rank", F.col("rank").cast("bigint"))


EMBEDDED = """ select w.pat_key, w.std_chg_code, w.serv_day, w.std_qty,
  round(list_sum(list_transform(e.v, lambda x: x::double)), 6) as total
from windowed w left join emb e on w.std_chg_code = e.code"""


@query("j4_embed_events", with_parts("windowed", "emb") + EMBEDDED)
def embed_events(spark, d):
    embedded = s.embed_events(_window(spark, d), fx.vectors(spark, d))
    return embedded.withColumn("total", total_of("v")).drop("v")


@query(
    "j5_attach_features",
    with_parts("adm", "evts")
    + """ select e.pat_key, e.n, a.los, a.std_payor from
  (select pat_key, count(*) as n from evts group by pat_key) e left join adm a on e.pat_key = a.pat_key""",
)
def attach_features(spark, d):
    counted = s.dedup_events(_window(spark, d)).groupBy("pat_key").agg(F.count(F.lit(1)).alias("n"))
    return s.attach_features(counted, fx.stays(spark, d).select("pat_key", "los", "std_payor"))


@query("a2_active_stays", with_parts("windowed") + " select distinct pat_key from windowed")
def active_stays(spark, d):
    return s.active_stays(_window(spark, d))


@query("a3_dedup_events", with_parts("evts") + " select * from evts")
def dedup_events(spark, d):
    return s.dedup_events(_window(spark, d))


LISTED = """, first as (select r.pat_key, r.rank, e.v from ranked r left join emb e on r.std_chg_code = e.code
  where r.rank <= {n}),
sized as (select pat_key, count(*) as n from first group by pat_key),
cells as (select s.pat_key, p as step, f.v from sized s cross join range(0, {n}) x(p)
  left join first f on f.pat_key = s.pat_key and f.rank = {n} - x.p)
"""


@query(
    "a4_event_lists",
    with_parts("ranked", "emb")
    + LISTED.format(n=3)
    + """select pat_key, cast(step as bigint) as step,
  round(coalesce(list_sum(list_transform(v, lambda x: x::double)), 0), 6) as total from cells""",
)
def event_lists(spark, d):
    lists = s.event_lists(_window(spark, d), fx.vectors(spark, d), n=3, dim=fx.WIDTH)
    cells = lists.select("pat_key", F.posexplode(sums.each_sum("vectors")).alias("step", "total"))
    return cells.select("pat_key", F.col("step").cast("bigint").alias("step"), F.round("total", 6).alias("total"))


@query(
    "a4_event_lists_full",
    with_parts("ranked", "emb")
    + LISTED.format(n=100)
    + """select pat_key, cast(step as bigint) as step,
  round(coalesce(list_sum(list_transform(v, lambda x: x::double)), 0), 6) as total from cells""",
)
def event_lists_full(spark, d):
    lists = s.event_lists(_window(spark, d), fx.vectors(spark, d), n=100, dim=fx.WIDTH)
    cells = lists.select("pat_key", F.posexplode(sums.each_sum("vectors")).alias("step", "total"))
    return cells.select("pat_key", F.col("step").cast("bigint").alias("step"), F.round("total", 6).alias("total"))


@query(
    "c1_event_sequence",
    with_parts("ranked", "emb")
    + LISTED.format(n=100)
    + """select pat_key, cast(6400 as bigint) as len,
  round(sum(list_sum(list_transform(v, lambda x, i: x::double * (64 * step + i)))), 4) as weighted,
  min(case when v is not null then 64 * step end) as first_at
from cells group by pat_key""",
)
def event_sequence(spark, d):
    return weighted(s.event_sequence(_window(spark, d), fx.vectors(spark, d), dim=fx.WIDTH), fx.WIDTH)


def weighted(sequences, dim, keys=("pat_key",)):
    """Length, position-weighted sum and first non-zero step of each sequence."""
    summed = sequences.select(
        *keys,
        F.size("embedding").cast("bigint").alias("len"),
        sums.placed_sum("embedding").alias("total"),
        sums.first_filled("embedding").alias("first"),
    ).withColumn("first_at", F.floor(F.col("first") / dim) * dim)
    return summed.select(
        *keys, "len", F.when(F.col("first_at").isNotNull(), F.round("total", 4)).alias("weighted"), "first_at"
    )


@query(
    "c1_event_sequence_cut",
    with_parts("ranked", "emb")
    + LISTED.format(n=3)
    + """select pat_key, cast(192 as bigint) as len,
  round(sum(list_sum(list_transform(v, lambda x, i: x::double * (64 * step + i)))), 4) as weighted,
  min(case when v is not null then 64 * step end) as first_at
from cells group by pat_key""",
)
def event_sequence_cut(spark, d):
    return weighted(s.event_sequence(_window(spark, d), fx.vectors(spark, d), n=3, dim=fx.WIDTH), fx.WIDTH)


@query(
    "a5_stay_constants",
    with_parts("adm", "windowed")
    + """ select w.pat_key, min(a.los) as los, min(a.disc_status) as disc_status
  from windowed w join adm a on w.pat_key = a.pat_key group by w.pat_key""",
)
def stay_constants(spark, d):
    stays = fx.stays(spark, d).select("pat_key", "los", "disc_status")
    lines = lookup(_window(spark, d), stays, ["pat_key"], "inner")
    return s.stay_constants(lines, ["los", "disc_status"])


@query(
    "o3_slots_descending",
    with_parts("ranked")
    + """ select pat_key, string_agg(cast(std_chg_code as varchar), ',' order by rank desc) as codes
  from ranked where rank <= 100 group by pat_key""",
)
def slots_descending(spark, d):
    events = s.first_events(_window(spark, d), 100)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "std_chg_code")), asc=False)
    listed = events.groupBy("pat_key").agg(ordered.alias("e"))
    return listed.select("pat_key", F.array_join(F.col("e.std_chg_code").cast("array<string>"), ",").alias("codes"))


@query(
    "f1_repeat_explode",
    with_parts("windowed")
    + " select pat_key, count(*) as n from (select distinct pat_key from windowed) k, range(0, 100) r(i) group by 1",
)
def repeat_explode(spark, d):
    repeated = s.active_stays(_window(spark, d)).select(F.explode(arrays.repeat_value("pat_key", 100)).alias("pat_key"))
    return repeated.groupBy("pat_key").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f2_row_id",
    """select o_orderkey, md5(length(cast(o_orderkey as varchar)) || ':' || cast(o_orderkey as varchar)
  || '|' || length(o_orderstatus) || ':' || o_orderstatus) as id from orders""",
)
def row_ids(spark, d):
    return fx.table(spark, d, "orders").select("o_orderkey", row_id("o_orderkey", "o_orderstatus").alias("id"))


@query(
    "f3_flatten_seq",
    with_parts("ranked", "emb")
    + LISTED.format(n=5)
    + """select c.pat_key, cast(64 * c.step + x.i as bigint) as pos,
  round(coalesce(list_extract(c.v, x.i + 1), 0)::double, 6) as value
from cells c cross join range(0, 64) x(i)""",
)
def flatten_seq(spark, d):
    lists = s.event_lists(_window(spark, d), fx.vectors(spark, d), n=5, dim=fx.WIDTH)
    flat = lists.select("pat_key", F.posexplode(arrays.flatten_seq("vectors")).alias("pos", "value"))
    return flat.select(
        "pat_key", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("value").cast("double"), 6).alias("value")
    )


@query(
    "f3_flatten_seq_full",
    with_parts("ranked", "emb")
    + LISTED.format(n=100)
    + """select pat_key, cast(step as bigint) as step,
  round(coalesce(list_sum(list_transform(v, lambda x, i: x::double * i)), 0), 6) as weighted from cells""",
)
def flatten_seq_full(spark, d):
    """Each step's place in the flat sequence of all hundred, by a sum that weighs its values."""
    flat = s.event_sequence(_window(spark, d), fx.vectors(spark, d), dim=fx.WIDTH)
    each = flat.select("pat_key", F.posexplode(sums.runs_placed_sum("embedding", fx.WIDTH)).alias("step", "weighted"))
    return each.select("pat_key", F.col("step").cast("bigint").alias("step"), F.round("weighted", 6).alias("weighted"))


@query(
    "f5_last_n_reshape",
    """select vec_id, cast(i as bigint) as step, cast(j as bigint) as dim,
  round(list_extract(embedding, cast(len(embedding) - 40 + 10 * i + j + 1 as integer))::double, 6) as value
from embeddings cross join range(0, 4) a(i) cross join range(0, 10) b(j)""",
)
def last_n_reshape(spark, d):
    shaped = fx.table(spark, d, "embeddings").select("vec_id", arrays.last_n_reshape("embedding", 4, 10).alias("m"))
    steps = shaped.select("vec_id", F.posexplode("m").alias("step", "row"))
    cells = steps.select("vec_id", "step", F.posexplode("row").alias("dim", "value"))
    return cells.select(
        "vec_id",
        F.col("step").cast("bigint").alias("step"),
        F.col("dim").cast("bigint").alias("dim"),
        F.round(F.col("value").cast("double"), 6).alias("value"),
    )


@query(
    "f6_one_hot",
    with_parts("labelled")
    + " select pat_key, cast(los_label = 0 as integer) as c0, cast(los_label = 1 as integer) as c1 from labelled",
)
def one_hot(spark, d):
    stays = c.attach_readmit(c.cohort(fx.stays(spark, d)), c.days_to_next(fx.readmissions(spark, d)))
    hot = c.with_labels(stays).select("pat_key", arrays.one_hot("los_label").alias("h"))
    return hot.select("pat_key", F.col("h")[0].alias("c0"), F.col("h")[1].alias("c1"))
