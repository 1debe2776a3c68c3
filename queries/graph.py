"""Co-occurrence graph and code-vector queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from queries.common import draw, query, with_parts
from stayframe.operators import cohort as c, cooccurrence as g, poincare as p
from stayframe.operators.edge_table import EdgeTable
from stayframe.plans import fixtures as fx
from stayframe.session import cut_lineage


def _edge_table(spark, d):
    """The edges written out, as the graph steps expect them."""
    return cut_lineage(fx.edges(spark, d))


@query("j6_code_pairs", with_parts("edges") + " select id1, id2, weight from edges")
def code_pairs(spark, d):
    return fx.edges(spark, d)


@query(
    "j6_code_pairs_by_stay",
    with_parts("bill")
    + """ select a.std_chg_code as id1, b.std_chg_code as id2, count(*) as weight
  from bill a join bill b on a.pat_key = b.pat_key and a.std_chg_code < b.std_chg_code group by 1, 2""",
)
def code_pairs_by_stay(spark, d):
    return g.code_pairs(fx.bill(spark, d), on=["pat_key"])


@query("a1_pair_weights", with_parts("edges") + " select weight, count(*) as n from edges group by weight")
def pair_weights(spark, d):
    return fx.edges(spark, d).groupBy("weight").agg(F.count(F.lit(1)).alias("n"))


HALVES = """, parts as (select x.std_chg_code as id1, y.std_chg_code as id2, count(*) as weight
  from adm a join bill x on a.pat_key = x.pat_key
  join bill y on x.pat_key = y.pat_key and x.std_chg_code < y.std_chg_code
  group by a.yq % 10 > 2, x.std_chg_code, y.std_chg_code)
select id1, id2, cast(sum(weight) as bigint) as weight from parts group by id1, id2"""


@query("j7_merge_edges", with_parts("adm", "bill") + HALVES)
def merge_edges(spark, d):
    lines = fx.quarterly_bill(spark, d)
    bill, late = fx.bill(spark, d), F.col("yq") % 10 > 2
    halves = [g.code_pairs(lines.where(half), ["pat_key"], probe=bill) for half in (~late, late)]
    return g.merge_edges(*halves, partitions=g.pair_tasks(bill))


@query(
    "u1_quarterly_pairs",
    with_parts("quarterly") + " select id1, id2, cast(sum(weight) as bigint) as weight from quarterly group by id1, id2",
)
def quarterly_pairs(spark, d):
    return g.code_pairs(fx.quarterly_bill(spark, d), on=["yq", "pat_key", "serv_day"], probe=fx.bill(spark, d))


@query(
    "j7_edge_table",
    with_parts("quarterly") + " select id1, id2, cast(sum(weight) as bigint) as weight from quarterly group by id1, id2",
)
def edge_table(spark, d):
    """Year after year merged into the persistent table: the same as all quarters at once."""
    lines = cut_lineage(fx.quarterly_bill(spark, d))
    years = sorted(r[0] for r in lines.select(F.floor(F.col("yq") / 10).alias("year")).distinct().collect())
    table = EdgeTable(spark, f"edges_{uuid.uuid4().hex[:12]}")
    for year in years:
        table.merge(g.code_pairs(lines.where(F.floor(F.col("yq") / 10) == year), on=["yq", "pat_key", "serv_day"]))
    return table.edges()


@query("p5_filter_edges", with_parts("edges") + " select * from edges where weight >= 2")
def filter_edges(spark, d):
    return g.filter_edges(fx.edges(spark, d), 2)


@query("a6_edge_total", with_parts("edges") + " select cast(sum(weight) as bigint) as total from edges")
def edge_total(spark, d):
    return g.edge_total(fx.edges(spark, d))


@query(
    "a7_histogram",
    with_parts("bill")
    + """, b as (select min(std_qty) as lo, max(std_qty) as hi from bill),
counted as (select least(cast(floor((std_qty - lo) / (hi - lo) * 10) as integer), 9) as bin, count(*) as n
  from bill, b group by 1)
select cast(i as integer) as bin, round(lo + i * ((hi - lo) / 10), 6) as low,
  round(lo + (i + 1) * ((hi - lo) / 10), 6) as high, coalesce(n, 0) as n
from range(0, 10) r(i) cross join b left join counted on i = bin""",
)
def histogram(spark, d):
    bins = g.histogram(fx.bill(spark, d), "std_qty")
    return bins.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@query(
    "o2_top_edges",
    with_parts("edges") + " select * from edges order by weight desc, id1, id2 limit 100",
)
def top_edges(spark, d):
    return g.top_edges(fx.edges(spark, d), 100)


@query("o5_sort_edges", with_parts("edges") + " select * from edges order by id1, id2")
def sort_edges(spark, d):
    return g.sort_edges(fx.edges(spark, d))


@query(
    "o6_pilot_pairs",
    with_parts("bill")
    + """, pilot as (select * from bill order by pat_key, serv_day, std_chg_code, std_qty limit 1000)
select a.std_chg_code as id1, b.std_chg_code as id2, count(*) as weight
from pilot a join pilot b on a.pat_key = b.pat_key and a.serv_day = b.serv_day
  and a.std_chg_code < b.std_chg_code group by 1, 2""",
)
def pilot_pairs(spark, d):
    return g.code_pairs(c.first_n(fx.bill(spark, d), 1000))


@query("o7_preview", with_parts("edges") + " select * from edges order by id1, id2 limit 5")
def preview(spark, d):
    return c.preview(fx.edges(spark, d), 5, ["id1", "id2"])


@query(
    "u2_symmetrize",
    with_parts("edges") + " select id1, id2, weight from edges union all select id2, id1, weight from edges",
)
def symmetrize(spark, d):
    return g.symmetrize(fx.edges(spark, d))


DISTANCE = """acosh(1 + 2 * list_sum(list_transform(list_zip({u}, {v}), lambda z: (z[1]::double - z[2]::double)
  * (z[1]::double - z[2]::double)))
  / ((1 - list_sum(list_transform({u}, lambda x: x::double * x::double)))
   * (1 - list_sum(list_transform({v}, lambda x: x::double * x::double)))))"""


@query(
    "g1_edge_distance",
    with_parts("edges", "ball")
    + f""" select e.id1, e.id2, e.weight, round({DISTANCE.format(u="a.v", v="b.v")}, 6) as distance
  from edges e left join ball a on e.id1 = a.code left join ball b on e.id2 = b.code""",
)
def edge_distance(spark, d):
    measured = p.edge_distance(fx.edges(spark, d), fx.ball_vectors(spark, d), fx.WIDTH)
    return measured.withColumn("distance", F.round("distance", 6))


NEGATIVES = """, ids as (select id1 as code from edges union select id2 from edges),
nodes as (select code, row_number() over (order by code) as n from ids),
links as (select id1, id2 from edges union select id2, id1 from edges union select code, code from nodes),
taken as (select id1, list(n order by n) as held from links join nodes on id2 = code group by id1),
free as (select id1, list_filter(range(1, (select count(*) + 1 from nodes)), lambda x: not list_contains(held, x)) as free
  from taken)
select e.id1, e.id2, cast(k as integer) as k, nodes.code as neg
from edges e join free on e.id1 = free.id1 cross join range(1, 51) r(k)
left join nodes on nodes.n = free[{draw} % len(free) + 1]""".replace("{draw}", draw(1, "e.id1", "e.id2", "k"))


@query("g2_negative_samples", with_parts("edges") + NEGATIVES)
def negative_samples(spark, d):
    return p.negative_samples(_edge_table(spark, d), n=50)


DIM = 8
# One epoch over all edges of both directions but the held-out ones, five negatives each, at the full rate.
EPOCH = """, both_ways as (select id1, id2 from edges union select id2, id1 from edges),
ids as (select distinct id1 as code from both_ways),
nodes as materialized (select code, row_number() over (order by code) as n from ids),
links as (select id1, id2 from both_ways union select code, code from nodes),
taken as (select id1, list(n order by n) as held from links join nodes on id2 = code group by id1),
free as materialized (select id1, list_filter(range(1, (select count(*) + 1 from nodes)), lambda x: not list_contains(held, x)) as free from taken),
parts as materialized (select *, {held} < {share} as is_held from both_ways),
terms as materialized (
  select id1 as e1, id2 as e2, id1, id2 as target, 1 as positive, is_held from parts
  union all
  select e.id1, e.id2, e.id1, nodes.code, 0, is_held from parts e join free on e.id1 = free.id1 cross join range(1, 6) r(k)
  join nodes on nodes.n = free[(case when is_held then {draw0} else {draw1} end) % len(free) + 1]),
start as materialized (select code, [{start}] as v from nodes),
""".format(
    held=draw(1, "'held'", "least(id1, id2)", "greatest(id1, id2)"),
    share=round(0.1 * 2**32),
    draw0=draw(0, "e.id1", "e.id2", "k"),
    draw1=draw(1, "e.id1", "e.id2", "k"),
    start=", ".join(f"({draw(1, 'code', str(j))} / 4294967296.0::double - 0.5::double) * 2e-3::double" for j in range(DIM)),
)


def _far(name: str, vectors: str, held: str) -> str:
    """SQL of the terms' distances and shares under some vectors."""
    return f"""{name}_m as (
  select t.*, a.v as u, b.v as w, 1 - list_dot_product(a.v, a.v) as ru, 1 - list_dot_product(b.v, b.v) as rv,
    list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as gap
  from terms t join {vectors} a on a.code = t.id1 join {vectors} b on b.code = t.target where {held}),
{name}_n as (select *, exp(-acosh(1 + 2 * gap / (ru * rv))) as near, 4 / sqrt(greatest((1 + 2 * gap / (ru * rv)) * (1 + 2 * gap / (ru * rv)) - 1, 1e-12)) as s from {name}_m),
{name} as materialized (select *, near / sum(near) over (partition by e1, e2) as share from {name}_n)"""


MOVED = EPOCH + _far("trained", "start", "not is_held") + """,
pulls as (
  select id1 as code, list_transform(list_zip(u, w), lambda z: (positive - share) * (s / rv * (gap + ru) / (ru * ru) * z[1] - s / rv / ru * z[2])) as g from trained
  union all
  select target, list_transform(list_zip(u, w), lambda z: (positive - share) * (s / ru * (gap + rv) / (rv * rv) * z[2] - s / ru / rv * z[1])) from trained),
means as (select code, [""" + ", ".join(f"avg(g[{j}])" for j in range(1, DIM + 1)) + """] as g from pulls group by code),
moved as materialized (
  select code, case when g is null then v else list_transform(list_zip(v, g), lambda z: z[1] - 0.3::double * (pow(1 - list_dot_product(v, v), 2) / 4) * z[2]) end as v
  from start left join means using (code))"""


def _one_epoch(spark, d):
    return p.fit_embedding(_edge_table(spark, d), dim=DIM, epochs=1, negs=5, burnin=0, holdout=0.1)


@query(
    "g3_epoch_vectors",
    with_parts("edges") + MOVED + " select code, cast(i as integer) as place, round(v[i + 1], 7) as x from moved, range(0, 8) r(i)",
)
def epoch_vectors(spark, d):
    """Every value of every vector after one epoch from the hashed start vectors."""
    return _one_epoch(spark, d).vectors.select("code", F.posexplode("v").alias("place", "x")).withColumn("x", F.round("x", 7))


@query(
    "g3_epoch_losses",
    with_parts("edges") + MOVED + ", " + _far("judged", "moved", "is_held") + """
select 1 as epoch, (select round(avg(-ln(share)), 7) from trained where positive = 1) as train_loss,
  (select round(avg(-ln(share)), 7) from judged where positive = 1) as held_loss""",
)
def epoch_losses(spark, d):
    """Loss of the epoch on its edges, and of the vectors after it on the held-out ones."""
    return _one_epoch(spark, d).losses().select("epoch", *[F.round(c, 7).alias(c) for c in ("train_loss", "held_loss")])


@query("g3_train_embedding")
def train_embedding(spark, d):
    """The vectors of a whole training: all epochs, negatives and slow epochs of the operator's own settings."""
    return p.train_embedding(_edge_table(spark, d))


@query(
    "g4_reconstruction",
    with_parts("edges", "ball")
    + f""", links as (select id1, id2 from edges union select id2, id1 from edges),
nodes as (select code, v from ball where code in (select id1 from links)),
dist as (select a.code as u, b.code as w, {DISTANCE.format(u="a.v", v="b.v")} as x,
    l.id1 is not null as linked
  from nodes a join nodes b on a.code <> b.code left join links l on l.id1 = a.code and l.id2 = b.code),
placed as (select u, w, x, linked, count(*) filter (where not linked) over strictly as strangers,
    row_number() over (partition by u, linked order by x, w) as i
  from dist window strictly as (partition by u order by x
    range between unbounded preceding and current row)),
ranked as (select u, i, strangers from placed where linked),
per_code as (select u, sum(strangers + 1) as ranks, count(*) as n, sum(i / (i + strangers)) as precision
  from ranked group by u)
select round(sum(ranks) / sum(n), 6) as mean_rank, round(avg(precision / n), 6) as map from per_code""",
)
def reconstruction(spark, d):
    judged = p.reconstruction(_edge_table(spark, d), fx.ball_vectors(spark, d), fx.WIDTH)
    return judged.select(F.round("mean_rank", 6).alias("mean_rank"), F.round("map", 6).alias("map"))
