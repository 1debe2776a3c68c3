"""Charge codes that occur together, as a weighted undirected graph."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from stayframe.operators.skew import HOT_ROWS, MOST_HOT, hot_keys, is_hot

# Groups with more distinct codes than this are paired in slices.
SLICE_CODES = 2_000
# Charge lines for each partition of lines and of their pairs.
LINES_PER_TASK = 250_000


def code_pairs(
    bill: DataFrame,
    on: Sequence[str] = ("pat_key", "serv_day"),
    code: str = "std_chg_code",
    slice_codes: int = SLICE_CODES,
    probe: DataFrame | None = None,
    lines_per_task: int = LINES_PER_TASK,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """How often two codes id1 < id2 share a group: edges (id1, id2, weight).

    Each pair of lines counts, so repeated lines of a code multiply. Lines are first reduced to
    one row per (group, code) with a count; a pair's weight is the sum of the products. A line with
    very many copies is counted before it is shuffled, and a group holds at most one row per code of the vocabulary.
    Pairs are summed in the task that makes them, so single pairs are not shuffled.

    Lines and pairs are dealt to partitions by the number of lines, so no task grows with the table. ``probe`` names a
    cheaper frame of the same lines, to count them and look for large groups in; it may lack columns of ``on``.

    Groups above ``slice_codes`` codes are cut: each slice of the left side meets the whole group
    in a task of its own. One count of the lines by the hash of their group tells which lines may lie in such
    a group, and all others are paired without looking for them.
    """
    on = list(on)
    probe = bill if probe is None else probe
    total = probe.count()
    tasks = _tasks(probe, total, lines_per_task)
    keyed = [c for c in on if c in probe.columns]
    # A share of the groups has a quarter of ``slice_codes`` lines on average, and no group has more lines than its share.
    shares = math.ceil(4 * total / slice_codes) or 1
    crowded, most = _crowded(_whole(probe, [*keyed, code]), keyed, shares, slice_codes)
    present = _whole(bill, [*on, code])
    copied = [*keyed, code]
    hot = hot_keys(probe, copied, min_rows) if most >= min_rows else []
    counted = [*on, F.col(code).alias("id")]
    lines = (present.where(~is_hot(copied, hot)) if hot else present).select(*counted, F.lit(1).cast("bigint").alias("n"))
    if hot:
        lines = lines.unionByName(present.where(is_hot(copied, hot)).groupBy(*counted).agg(F.count(F.lit(1)).alias("n")))
    if not crowded:
        return merge_edges(_paired(_sized(lines, on, tasks), on), partitions=tasks)
    if len(crowded) > MOST_HOT:
        return merge_edges(*_paired_in_slices(_sized(lines, on, tasks), on, slice_codes), partitions=tasks)
    busy = _share(keyed, shares).isin(crowded)
    usual = _paired(_sized(lines.where(~busy), on, tasks), on)
    large = _paired_in_slices(_sized(lines.where(busy), on, tasks), on, slice_codes)
    return merge_edges(usual, *large, partitions=tasks)


def pair_tasks(lines: DataFrame, lines_per_task: int = LINES_PER_TASK) -> int:
    """Partitions for the lines and their pairs."""
    return _tasks(lines, lines.count(), lines_per_task)


def _tasks(lines: DataFrame, total: int, lines_per_task: int) -> int:
    return max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / lines_per_task))


def _whole(lines: DataFrame, cols: Sequence[str]) -> DataFrame:
    for c in cols:
        lines = lines.where(F.col(c).isNotNull())
    return lines


def _share(keyed: Sequence[str], shares: int) -> Column:
    """Number of the share that a group's lines are counted in."""
    return F.pmod(F.xxhash64(F.lit(shares), *keyed), F.lit(shares))


def _crowded(lines: DataFrame, keyed: Sequence[str], shares: int, above: int) -> tuple[list[int], int]:
    """Shares of more than ``above`` lines, ``MOST_HOT`` + 1 at most, and the lines of the largest of them."""
    sums = lines.groupBy(_share(keyed, shares).alias("share")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > above)
    top = sums.orderBy(F.desc("n")).limit(MOST_HOT + 1).collect()
    return [r["share"] for r in top], max((r["n"] for r in top), default=above)


def _sized(lines: DataFrame, on: list[str], tasks: int) -> DataFrame:
    """One row per (group, code), with the number of the group's codes.

    Groups of one part lie in one task, where lines are counted, paired and summed without another shuffle.
    """
    dealt = lines.withColumn("_part", F.pmod(F.xxhash64(*on), F.lit(4 * tasks))).repartition(tasks, "_part")
    each = dealt.groupBy("_part", *on, "id").agg(F.sum("n").alias("n"))
    whole = _by_code(on).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return each.withColumn("_codes", F.count(F.lit(1)).over(whole))


def _by_code(on: list[str]) -> WindowSpec:
    return Window.partitionBy("_part", *on).orderBy("id")


def _paired(sized: DataFrame, on: list[str]) -> DataFrame:
    """Edges within groups that one task holds, summed for each part."""
    later = F.collect_list(F.struct("id", "n")).over(_by_code(on).rowsBetween(1, Window.unboundedFollowing))
    first = sized.where(F.col("_codes") > 1).select("_part", "id", "n", later.alias("later"))
    pairs = first.select("_part", "id", "n", F.explode("later").alias("second"))
    products = pairs.select(
        "_part", F.col("id").alias("id1"), F.col("second.id").alias("id2"), (F.col("n") * F.col("second.n")).alias("product")
    )
    return products.groupBy("_part", "id1", "id2").agg(F.sum("product").alias("weight")).drop("_part")


def _paired_in_slices(sized: DataFrame, on: list[str], slice_codes: int) -> tuple[DataFrame, DataFrame]:
    """Edges within groups up to ``slice_codes`` codes, and within larger ones."""
    wide = sized.where(F.col("_codes") > slice_codes).withColumn(
        "_slices", F.ceil(F.col("_codes") / slice_codes).cast("int")
    )
    left = wide.withColumn("_slice", F.pmod(F.xxhash64("id"), F.col("_slices")).cast("int"))
    right = wide.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    far = _products(left, right, [*on, "_slice"]).groupBy("id1", "id2").agg(F.sum("product").alias("weight"))
    return _paired(sized.where(F.col("_codes") <= slice_codes), on), far


def _products(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    first = left.select(*keys, F.col("id").alias("id1"), F.col("n").alias("n1"))
    second = right.select(*keys, F.col("id").alias("id2"), F.col("n").alias("n2"))
    pairs = first.join(second, keys).where(F.col("id1") < F.col("id2"))
    return pairs.select("id1", "id2", (F.col("n1") * F.col("n2")).alias("product"))


def merge_edges(*edges: DataFrame, partitions: int | None = None) -> DataFrame:
    """Add edge lists; an edge missing from a list counts 0 there. Long lists can be dealt to a number of ``partitions``."""
    together = reduce(DataFrame.unionByName, edges)
    if partitions:
        together = together.repartition(partitions, "id1", "id2")
    return together.groupBy("id1", "id2").agg(F.sum("weight").alias("weight"))


def filter_edges(edges: DataFrame, min_weight: int = 10) -> DataFrame:
    return edges.where(F.col("weight") >= min_weight)


def edge_total(edges: DataFrame) -> DataFrame:
    return edges.agg(F.sum("weight").alias("total"))


def top_edges(edges: DataFrame, k: int) -> DataFrame:
    return edges.orderBy(F.desc("weight"), "id1", "id2").limit(k)


def sort_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("id1", "id2")


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    turned = {"id1": "id2", "id2": "id1"}
    back = edges.select(*[F.col(turned.get(c, c)).alias(c) for c in edges.columns])
    return edges.unionByName(back)


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Counts in ``bins`` equal intervals between minimum and maximum, empty ones included.

    Null, NaN and infinite values are left out.
    """
    spark = df.sparkSession
    value = F.col(col).cast("double")
    df = df.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))))
    low, high = df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    if low is None:
        low, high = 0.0, 1.0
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins
    place = F.floor((F.col(col).cast("double") - F.lit(low)) / F.lit(high - low) * bins)
    counted = (
        df.groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counted, "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * step).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * step).alias("high"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )
