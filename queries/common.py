"""Registration of queries, and the SQL form of the fixture tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL where SQL can say it."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


STAYS = """
select o.o_orderkey as pat_key, o.o_custkey as medrec_key,
  year(o.o_orderdate)*100+month(o.o_orderdate) as disc_mon,
  year(o.o_orderdate)*10+quarter(o.o_orderdate) as yq,
  year(o.o_orderdate)*100+month(o.o_orderdate) as adm_mon,
  year(o.o_orderdate)*12+month(o.o_orderdate) as disc_mon_seq,
  substr(o.o_orderpriority,1,1) as adm_source, c.c_nationkey % 5 as point_of_origin,
  o.o_orderpriority as adm_type, case when c.c_acctbal<0 then 'S' else 'M' end as mart_status,
  cast(c.c_custkey % 90 as integer) as age, case when c.c_custkey % 2 = 0 then 'F' else 'M' end as gender,
  c.c_nationkey % 6 as race, case when c.c_nationkey % 4 = 0 then 'Y' else 'N' end as hispanic_ind,
  c.c_mktsegment as std_payor, c.c_nationkey as prov_id,
  cast(o.o_custkey % 7 as integer) as admphy_spec, cast(o.o_custkey % 101 as integer) as adm_phy,
  cast(o.o_orderkey % 7 as integer) as attphy_spec, cast(o.o_orderkey % 101 as integer) as att_phy,
  c.c_acctbal as proj_wgt,
  case when o.o_orderstatus='F' and o.o_orderpriority='1-URGENT' then 20 else 1 end as disc_status,
  o.o_totalprice as pat_cost, l.los
from orders o join customer c on o.o_custkey=c.c_custkey
left join (select l_orderkey, max(l_linenumber) as los from lineitem group by l_orderkey) l
  on o.o_orderkey=l.l_orderkey"""

BILL = """
select l_orderkey as pat_key, l_partkey as std_chg_code, l_linenumber-1 as serv_day,
  l_quantity as std_qty from lineitem"""

READMIT = """
select o_orderkey as pat_key, o_custkey as medrec_key,
  year(o_orderdate)*100+month(o_orderdate) as disc_mon,
  date_diff('day', cast(lag(o_orderdate) over w as date), cast(o_orderdate as date)) as days_from_prior
from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)"""

TIMES = """
select *, lead(days_from_prior) over (partition by medrec_key order by disc_mon, pat_key) as readmit_time
from readmit"""

PATS = """
select a.*, coalesce(t.readmit_time, 9999) as readmit_time
from adm a left join times t on a.pat_key = t.pat_key where a.los > 1"""

LABELLED = """
select *, case when disc_status = 20 then 1 else 0 end as mortality_label,
  case when los > 6 or disc_status = 20 then 1 else 0 end as los_label,
  case when readmit_time < 31 or disc_status = 20 then 1 else 0 end as readmit_label,
  pat_cost as cost_label, {fold} as fold
from pats"""

EMB = "select vec_id as code, embedding as v from embeddings"

BALL = "select vec_id as code, list_transform(embedding, lambda x: x * 0.5::float) as v from embeddings"

WINDOWED = "select pat_key, std_chg_code, serv_day, std_qty from bill where serv_day in (0, 1)"

EVENTS = """
select pat_key, std_chg_code, serv_day, max(std_qty) as std_qty
from windowed group by pat_key, std_chg_code, serv_day"""

RANKED = """
select *, row_number() over (partition by pat_key order by std_chg_code, serv_day desc) as rank
from evts"""

EDGES = """
select a.std_chg_code as id1, b.std_chg_code as id2, count(*) as weight
from bill a join bill b on a.pat_key = b.pat_key and a.serv_day = b.serv_day
  and a.std_chg_code < b.std_chg_code
group by a.std_chg_code, b.std_chg_code"""

QUARTERLY = """
select a.yq, x.std_chg_code as id1, y.std_chg_code as id2, count(*) as weight
from adm a join bill x on a.pat_key = x.pat_key
join bill y on x.pat_key = y.pat_key and x.serv_day = y.serv_day and x.std_chg_code < y.std_chg_code
group by a.yq, x.std_chg_code, y.std_chg_code"""

SCORES = """
select case when o_orderstatus = 'F' then 1 else 0 end as label, round(o_totalprice/1000) as score,
  o_orderpriority as run, c_mktsegment as grp, o_totalprice/(o_totalprice+200000.0::double) as p1,
  1 - o_totalprice/(o_totalprice+200000.0::double) as p0
from orders join customer on o_custkey = c_custkey"""

METRICS = """
select event_type as run, day(ts) as epoch, round(avg(value),6) as val_loss
from events group by event_type, day(ts)"""


def draw(seed: int, *keys: str) -> str:
    """The library's key draw, in SQL."""
    text = " || '|' || ".join([f"'{seed}'", *[f"cast({k} as varchar)" for k in keys]])
    return f"cast('0x' || substr(md5({text}), 1, 8) as bigint)"


_PARTS = {
    "adm": (STAYS, ()),
    "bill": (BILL, ()),
    "readmit": (READMIT, ()),
    "times": (TIMES, ("readmit",)),
    "pats": (PATS, ("adm", "times")),
    "labelled": (LABELLED.format(fold=f"cast({draw(42, 'pat_key')} % 10 as integer)"), ("pats",)),
    "emb": (EMB, ()),
    "ball": (BALL, ()),
    "windowed": (WINDOWED, ("bill",)),
    "evts": (EVENTS, ("windowed",)),
    "ranked": (RANKED, ("evts",)),
    "edges": (EDGES, ("bill",)),
    "quarterly": (QUARTERLY, ("adm", "bill")),
    "scores": (SCORES, ()),
    "metrics": (METRICS, ()),
}


def with_parts(*names: str) -> str:
    """A WITH clause that defines the named fixture tables and what they need."""
    order: list[str] = []

    def need(name):
        for dep in _PARTS[name][1]:
            need(dep)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return "with " + ",\n".join(f"{n} as ({_PARTS[n][0]})" for n in order)
