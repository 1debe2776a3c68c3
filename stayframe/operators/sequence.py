"""From charge lines to one fixed-length sequence of code vectors per stay."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from stayframe.functions.arrays import default_vector, flatten_seq, zero_vector
from stayframe.operators.ordered import scan_groups
from stayframe.operators.skew import HOT_ROWS, hot_keys, lookup
from stayframe.operators.topn import first_rows

EVENT = ["pat_key", "std_chg_code", "serv_day"]
PAD_CODE = -1
# Vectors of up to this many codes are broadcast: some 20 MB at ten values each.
BROADCAST_CODES = 200_000
# Charge lines for each partition of what becomes long lists.
LINES_PER_TASK = 250_000


def active_stays(bill: DataFrame) -> DataFrame:
    """Stays with at least one charge line."""
    return bill.select("pat_key").distinct()


def dedup_events(bill: DataFrame) -> DataFrame:
    """One row per (stay, code, day), with the largest quantity.

    The three-column key spreads the lines of a very long stay, and copies of a line
    collapse before the shuffle.
    """
    return bill.groupBy(*EVENT).agg(F.max("std_qty").alias("std_qty"))


def rank_events(bill: DataFrame, min_rows: int = HOT_ROWS, **options) -> DataFrame:
    """Dense rank of each charge line in its stay, by code ascending, then day descending.

    With a huge stay in the data, ranks are computed on distinct events in chunks and looked
    up for the lines.
    """
    if not hot_keys(bill, ["pat_key"], min_rows):
        window = Window.partitionBy("pat_key").orderBy("std_chg_code", F.desc("serv_day"))
        return bill.withColumn("rank", F.dense_rank().over(window).cast("bigint"))
    events = bill.select(*EVENT).distinct().withColumns(
        {"_dayless": F.col("serv_day").isNull(), "_day": -F.col("serv_day")}
    )
    ranked = scan_groups(
        events,
        ["pat_key"],
        ["std_chg_code", "_dayless", "_day"],
        cut="std_chg_code",
        sums={"rank": F.lit(1).cast("bigint")},
        min_rows=min_rows,
        **options,
    )
    return lookup(bill, ranked.select(*EVENT, "rank"), EVENT, null_safe=True, min_rows=min_rows)


def first_events(bill: DataFrame, n: int = 100, **options) -> DataFrame:
    """Distinct events of rank 1..n in each stay, with their rank.

    Among distinct events the dense rank is the row number. No more than n rows of a stay go
    through the shuffle on the stay, or, where n is large, of each slice of a huge stay.
    """
    return first_rows(dedup_events(bill), ["pat_key"], ["std_chg_code", F.desc("serv_day")], n, **options)


def slots(keys: DataFrame, n: int = 100) -> DataFrame:
    """Every distinct stay with the slot numbers 1..n."""
    return keys.select("pat_key").distinct().select("pat_key", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rank"))


def slot_join(bill: DataFrame, n: int = 100) -> DataFrame:
    """Events placed on the slots of their stay: later events vanish, empty slots are null.

    Ranks have no gaps, so the event of a slot is found by position in the stay's list of at most
    n events. That saves a join of all slots with all events.
    """
    event = F.struct("rank", "std_chg_code", "serv_day", "std_qty")
    listed = first_events(bill, n).groupBy("pat_key").agg(F.sort_array(F.collect_list(event)).alias("events"))
    slotted = listed.select("pat_key", "events", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rank"))
    found = F.get("events", F.col("rank") - 1)
    return slotted.select("pat_key", "rank", *[found[c].alias(c) for c in ("std_chg_code", "serv_day", "std_qty")])


def fill_slots(df: DataFrame, value: int = PAD_CODE) -> DataFrame:
    """The pad value where a slot has no code, day or quantity."""
    return df.na.fill(value, subset=["std_chg_code", "serv_day", "std_qty"])


def embed_events(
    events: DataFrame, emb: DataFrame, probe: DataFrame | None = None, broadcast_codes: int = BROADCAST_CODES
) -> DataFrame:
    """Left lookup of the code's vector ``v`` (null where the code has none)."""
    vectors = emb.select(F.col("code").alias("std_chg_code"), "v")
    return lookup(events, vectors, ["std_chg_code"], broadcast_rows=broadcast_codes, probe=probe)


def event_lists(
    bill: DataFrame, emb: DataFrame, n: int = 100, dim: int = 10, broadcast_codes: int = BROADCAST_CODES
) -> DataFrame:
    """One list of exactly n vectors per stay: empty slots first, then ranks n .. 1.

    Empty slots are never rows: the list of at most n real events is padded in place. A stay's few bytes become
    a long list, so events are dealt to partitions by the number of lines and not by the bytes shuffled.
    """
    # Never as many as the ranks' own shuffle has: Spark would take the two for one and merge its small partitions.
    partitions = int(bill.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(2 * partitions, math.ceil(bill.count() / LINES_PER_TASK))
    embedded = embed_events(first_events(bill, n).repartition(tasks, "pat_key"), emb, bill, broadcast_codes)
    events = embedded.select("pat_key", F.struct("rank", default_vector("v", dim).alias("v")).alias("event"))
    listed = events.groupBy("pat_key").agg(F.sort_array(F.collect_list("event"), asc=False).alias("events"))
    padding = F.array_repeat(zero_vector(dim), F.lit(n) - F.size("events"))
    return listed.select("pat_key", F.concat(padding, F.col("events.v")).alias("vectors"))


def event_sequence(
    bill: DataFrame, emb: DataFrame, n: int = 100, dim: int = 10, broadcast_codes: int = BROADCAST_CODES
) -> DataFrame:
    """The event list of each stay as one flat array of ``n * dim`` floats."""
    lists = event_lists(bill, emb, n, dim, broadcast_codes)
    return lists.select("pat_key", flatten_seq("vectors").alias("embedding"))


def pooled_events(
    bill: DataFrame, emb: DataFrame, n: int = 100, dim: int = 10, broadcast_codes: int = BROADCAST_CODES
) -> DataFrame:
    """(pat_key, pooled): mean vector of a stay's first n events, unknown codes as zeros, empty slots left out."""
    embedded = embed_events(first_events(bill, n), emb, bill, broadcast_codes)
    sums = [F.sum(F.coalesce(F.get("v", F.lit(j)).cast("double"), F.lit(0.0))) / F.count(F.lit(1)) for j in range(dim)]
    return embedded.groupBy("pat_key").agg(F.array(*sums).alias("pooled"))


def attach_features(sequences: DataFrame, features: DataFrame, on: Sequence[str] = ("pat_key",)) -> DataFrame:
    """Left join stay-level columns to the sequence rows, one row per stay on both sides."""
    return sequences.join(features, list(on), "left")


def stay_constants(events: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per stay with columns that are the same on all its rows."""
    return events.groupBy("pat_key").agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])
