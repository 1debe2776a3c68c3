"""Running totals and neighbours along an order, without a whole group in one task.

Rows are cut into chunks that follow the order. Each chunk is one window partition.
What a chunk must know of the chunks around it (total before it, last row before it,
first row after it) comes from a summary with one row per chunk and enters the chunk's
window as an extra row at its head or tail, so no join back is needed and null groups
need no special care.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from stayframe.operators.skew import HOT_ROWS, hot_keys, is_hot

CHUNK = "_chunk"
SIDE = "_side"
ROWS_PER_CHUNK = 250_000
# Cut points are constants of the plan, so their number is bounded; beyond four billion rows in one order chunks grow.
MAX_CHUNKS = 16_384
# Sampled values for each cut point, and rounds of cutting chunks that came out too large.
_SAMPLED = 20
_ROUNDS = 3


def with_quantile_chunks(
    df: DataFrame,
    value: Column,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    max_chunks: int = MAX_CHUNKS,
    basis: DataFrame | None = None,
) -> DataFrame:
    """Add a chunk number that grows with ``value``; chunks hold about equally many rows.

    A frame of no more than ``rows_per_chunk`` rows (counted) needs no chunks and gets no number.
    Otherwise a bounded sample of ``basis`` (default: the frame itself) yields the cut points, and a count
    of every interval shows which are still too large and are cut again. The points enter the plan as
    constants, so every use of the chunk number agrees even when tasks are run again. No task and not the driver
    holds more than the sample, some twenty numbers for each cut point.
    """
    basis = df if basis is None else basis
    total = basis.count()
    chunks = min(max_chunks, math.ceil(total / rows_per_chunk))
    if chunks < 2:
        return df
    number = value.cast("double")
    if isinstance(df.select(value).schema[0].dataType, StringType):
        number = _text_place(basis, value, min(1.0, _SAMPLED * chunks / total))
    chosen = _cut_points(basis.select(number.alias("_value")).where("_value is not null and not isnan(_value)"), total, chunks, max_chunks)
    if not chosen:
        return df
    cut = _cut(df.withColumn("_value", number), chosen)
    # Nulls sort first, so they come before every other chunk.
    chunk = F.when(F.col("_value").isNull(), -1).otherwise(F.col("_bucket").cast("int"))
    return cut.withColumn(CHUNK, chunk).drop("_value", "_bucket")


def _cut(rows: DataFrame, points: Sequence[float]) -> DataFrame:
    splits = [-math.inf, *points, math.inf]
    return Bucketizer(splits=splits, inputCol="_value", outputCol="_bucket", handleInvalid="keep").transform(rows)


def _cut_points(values: DataFrame, total: int, chunks: int, max_chunks: int) -> list[float]:
    """Points that cut ``_value`` into about ``chunks`` intervals of like counts, where its ties allow it."""
    aim, points = total / chunks, set()
    wanted = values
    for seed in range(_ROUNDS):
        sample = wanted.sample(min(1.0, _SAMPLED * chunks / total), seed=17 + seed)
        drawn = sample.groupBy("_value").agg(F.count(F.lit(1)).alias("n")).orderBy("_value").collect()
        seen, every = 0, max(1.0, sum(r["n"] for r in drawn) / chunks) if seed == 0 else _SAMPLED
        for r in drawn:
            before, seen = seen, seen + r["n"]
            if int(before / every) != int(seen / every) and math.isfinite(r["_value"]):
                points.add(r["_value"])
        chosen = sorted(points)
        chosen = chosen[:: -(-len(chosen) // max(1, max_chunks - 1))] if chosen else []
        if not chosen:
            return []
        counts = {int(r["_bucket"]): r["count"] for r in _cut(values, chosen).groupBy("_bucket").count().collect()}
        large = [b for b, n in counts.items() if n > 2 * aim]
        if not large or 2 * len(chosen) > max_chunks:
            break
        # Only what lies in the intervals that came out too large is sampled again.
        wanted = _cut(values, chosen).where(F.col("_bucket").isin([float(b) for b in large])).select("_value")
    return chosen


def _text_place(basis: DataFrame, value: Column, share: float) -> Column:
    """A number that never falls as the text rises: its next six bytes after what nearly all texts begin with.

    Texts outside the range of a sample's middle stand before or after all others.
    """
    texts = basis.select(value.cast("binary").alias("t")).where("t is not null")
    drawn = [bytes(r["t"]) for r in texts.sample(share, seed=13).select(F.substring("t", 1, 64).alias("t")).orderBy("t").collect()]
    if not drawn:
        drawn = [bytes(r["t"])[:64] for r in texts.limit(1).collect()] or [b""]
    edge = len(drawn) // 200
    low, high = drawn[edge], drawn[len(drawn) - 1 - edge]
    shared = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    prefix = F.lit(bytearray(low[:shared]))
    head = F.substring(value.cast("binary"), 1, shared)
    part = F.hex(F.substring(value.cast("binary"), shared + 1, 6))
    place = F.conv(F.rpad(part, 12, "0"), 16, 10).cast("double")
    below, above = F.lit(-1.0), F.lit(2.0**49)
    return F.when(value.isNull(), F.lit(None).cast("double")).when(head < prefix, below).when(head > prefix, above).otherwise(place)


def scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    *,
    sums: Mapping[str, Column] | None = None,
    mins: Mapping[str, Column] | None = None,
    leads: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    busy: Column | None = None,
) -> DataFrame:
    """Running sums and minimums, next and previous values, per ``by`` along ``order``.

    ``order`` is ascending and must be total within a group. A frame with large groups carries
    a ``CHUNK`` column that never decreases along the order; without it each group is one window
    partition. ``busy`` limits the chunk summary to the groups that are really cut (the others
    must lie in one chunk).
    """
    split = CHUNK in df.columns
    sums, mins, leads, lags = sums or {}, mins or {}, leads or {}, lags or {}
    kinds = (("sum", sums), ("min", mins), ("lead", leads), ("lag", lags))
    inner = {f"_{kind}_{out}": value for kind, group in kinds for out, value in group.items()}
    rows = df.withColumns(inner)
    if split:
        rows = _with_carried(rows.withColumn(SIDE, F.lit(1)), list(by), list(order), sums, mins, leads, lags, busy)
        window = Window.partitionBy(*by, CHUNK).orderBy(SIDE, *order)
    else:
        window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = {out: F.sum(f"_sum_{out}").over(upto) for out in sums}
    made |= {out: F.min(f"_min_{out}").over(upto) for out in mins}
    made |= {out: F.lead(f"_lead_{out}").over(window) for out in leads}
    made |= {out: F.lag(f"_lag_{out}").over(window) for out in lags}
    done = rows.select("*", *[value.alias(out) for out, value in made.items()])
    if split:
        done = done.where(F.col(SIDE) == 1)
    return done.drop(*inner, SIDE, CHUNK)


def _with_carried(rows, by, order, sums, mins, leads, lags, busy):
    place = F.struct(*order)
    parts = rows if busy is None else rows.where(busy)
    summary = parts.groupBy(*by, CHUNK).agg(
        *[F.sum(f"_sum_{o}").alias(f"_sum_{o}") for o in sums],
        *[F.min(f"_min_{o}").alias(f"_min_{o}") for o in mins],
        *[F.min_by(F.struct(f"_lead_{o}"), place).alias(f"_first_{o}") for o in leads],
        *[F.max_by(F.struct(f"_lag_{o}"), place).alias(f"_last_{o}") for o in lags],
        F.count(F.lit(1)).alias("_rows"),
    )
    # One row per chunk, so a group of this window has as many rows as it has chunks.
    along = Window.partitionBy(*(by or [F.lit(0)])).orderBy(CHUNK)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    out = rows
    if sums or mins or lags:
        heads = summary.select(
            *by,
            CHUNK,
            F.lit(0).alias(SIDE),
            *[F.sum(f"_sum_{o}").over(before).alias(f"_sum_{o}") for o in sums],
            *[F.min(f"_min_{o}").over(before).alias(f"_min_{o}") for o in mins],
            *[F.lag(f"_last_{o}").over(along)[f"_lag_{o}"].alias(f"_lag_{o}") for o in lags],
        )
        out = out.unionByName(heads, allowMissingColumns=True)
    if leads:
        tails = summary.select(
            *by,
            CHUNK,
            F.lit(2).alias(SIDE),
            *[F.lead(f"_first_{o}").over(along)[f"_lead_{o}"].alias(f"_lead_{o}") for o in leads],
        )
        out = out.unionByName(tails, allowMissingColumns=True)
    return out


def scan_groups(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    *,
    exact: Sequence[str] = (),
    cut: str,
    min_rows: int = HOT_ROWS,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    **what,
) -> DataFrame:
    """``scan`` for many groups of which a few may be huge.

    Ordinary groups keep the plain window and pay one shuffle. Groups found hot are cut by the
    leading ``exact`` order columns and by quantiles of the order column ``cut`` after them.
    """
    hot = hot_keys(df, by, min_rows)
    if not hot:
        return scan(df, by, order, **what)
    busy = is_hot(by, hot)
    chunked = with_quantile_chunks(df, F.col(cut), rows_per_chunk, basis=df.where(busy))
    cut_at = F.col(CHUNK) if CHUNK in chunked.columns else F.lit(0)
    chunked = chunked.withColumn(CHUNK, F.when(busy, F.struct(*exact, cut_at.alias("cut"))))
    return scan(chunked, by, order, busy=busy, **what)


def number_rows(
    df: DataFrame, order: Sequence[str], out: str, cut: str | None = None, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """1, 2, 3 … along a total order over the whole frame."""
    chunked = with_quantile_chunks(df, F.col(cut or order[0]), rows_per_chunk)
    return scan(chunked, [], order, sums={out: F.lit(1).cast("bigint")})
