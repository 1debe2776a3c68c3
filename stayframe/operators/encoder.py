"""One-hot rows for columns of any number of values, indexed and encoded without a driver-side list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stayframe.operators.features import ADMISSION, DEMOGRAPHICS
from stayframe.operators.ordered import scan_groups
from stayframe.operators.skew import HOT_ROWS, lookup
from stayframe.session import cut_lineage

# An index of up to this many values is broadcast to the rows, if it is small enough as measured.
BROADCAST_VALUES = 200_000
# Numbers among the stay columns, with the unit they are counted in; all others are categories.
UNITS = {"age": 100.0}
TIER_COLUMNS = {"demographics": DEMOGRAPHICS, "admission": ADMISSION}


@dataclass(frozen=True)
class Encoder:
    """Places of one-hot and numeric columns in a sparse row, tier after tier.

    ``index`` has ``name, value, n, idx``: each category's values by frequency, then value. ``places`` has
    ``name, first, width``, one row per column: where its places begin and how many there are. ``tiers`` says how
    many places lead up to the end of each tier, so a model of a tier sees a prefix of the row.
    """

    index: DataFrame
    places: dict[str, tuple[int, int]]
    tiers: dict[str, int]
    units: Mapping[str, float]

    @property
    def width(self) -> int:
        return max(self.tiers.values(), default=0)

    def write(self, path: str) -> None:
        """The index as a table of values and one of columns, so that any later job can encode alike."""
        spark = self.index.sparkSession
        tier_of = {c: t for t, end in sorted(self.tiers.items(), key=lambda x: -x[1]) for c, (a, n) in self.places.items() if a + n <= end}
        rows = [(c, a, n, tier_of[c], self.tiers[tier_of[c]], self.units.get(c)) for c, (a, n) in self.places.items()]
        self.index.write.mode("overwrite").parquet(f"{path}/values")
        kind = "name string, first bigint, width bigint, tier string, tier_end bigint, unit double"
        spark.createDataFrame(rows, kind).write.mode("overwrite").parquet(f"{path}/columns")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Encoder:
        rows = spark.read.parquet(f"{path}/columns").orderBy("first").collect()
        return cls(
            spark.read.parquet(f"{path}/values"),
            {r["name"]: (r["first"], r["width"]) for r in rows},
            {r["tier"]: r["tier_end"] for r in rows},
            {r["name"]: r["unit"] for r in rows if r["unit"] is not None},
        )


def _named(df: DataFrame, cats: Sequence[str], *kept: str) -> DataFrame:
    """One row for each category value that a row has: ``name, value``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in cats])
    return df.select(*kept, F.inline(pairs)).where("value is not null")


def value_index(df: DataFrame, cats: Sequence[str], min_rows: int = HOT_ROWS, **options) -> DataFrame:
    """(name, value, n, idx): values of each column, the most frequent first, ties by value; null is no value.

    Numbers run over chunks of equal counts and neighbouring values, so a column of any number of values is
    indexed by many tasks.
    """
    counted = cut_lineage(_named(df, cats).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n")))
    falling = counted.withColumn("_rare", -F.col("n"))
    numbered = scan_groups(
        falling, ["name"], ["_rare", "value"], exact=["_rare"], cut="value", min_rows=min_rows,
        sums={"_rank": F.lit(1).cast("bigint")}, **options,
    )
    return numbered.select("name", "value", "n", (F.col("_rank") - 1).alias("idx"))


def fit_encoder(
    df: DataFrame, tiers: Mapping[str, Sequence[str]] = TIER_COLUMNS, units: Mapping[str, float] = UNITS, **options
) -> Encoder:
    """Index the columns of each tier; a numeric column (one with a unit) takes one place."""
    cats = [c for columns in tiers.values() for c in columns if c not in units]
    index = cut_lineage(value_index(df, cats, **options))
    sizes = dict(index.groupBy("name").agg(F.max("idx") + 1).collect())  # one row per column
    places, ends, at = {}, {}, 0
    for tier, columns in tiers.items():
        for c in columns:
            width = 1 if c in units else sizes.get(c, 0)
            places[c] = (at, width)
            at += width
        ends[tier] = at
    return Encoder(index, places, ends, {c: u for c, u in units.items() if c in places})


def encode(
    encoder: Encoder, df: DataFrame, key: str = "pat_key", extra: Column | None = None,
    broadcast_values: int = BROADCAST_VALUES, min_rows: int = HOT_ROWS,
) -> DataFrame:
    """(key, places, values): the sparse row of each ``key``, places ascending.

    Unseen and null values have no place, null numbers neither; a row without any still comes, empty. ``extra`` is
    an array whose values follow after the last place. ``df`` has one row per key.
    """
    cats = [c for c in encoder.places if c not in encoder.units]
    long = _named(df, cats, key)
    met = lookup(long, encoder.index.select("name", "value", "idx"), ["name", "value"], broadcast_rows=broadcast_values, min_rows=min_rows)
    first = F.create_map(*[F.lit(x) for c in cats for x in (c, encoder.places[c][0])]) if cats else F.lit(None)
    spot = F.struct((first[F.col("name")] + F.col("idx")).cast("int").alias("place"), F.lit(1.0).alias("value"))
    hot = met.where("idx is not null").groupBy(key).agg(F.collect_list(spot).alias("_hot"))  # one entry a column at most
    numbers = [
        F.struct(F.lit(encoder.places[c][0]).cast("int").alias("place"), (F.col(f"`{c}`").cast("double") / u).alias("value"))
        for c, u in encoder.units.items()
    ]
    none = F.array().cast("array<struct<place:int,value:double>>")
    follow = none
    if extra is not None:
        follow = F.transform(extra.cast("array<double>"), lambda x, i: F.struct((i + encoder.width).cast("int").alias("place"), x.alias("value")))
    own = df.select(key, F.coalesce(follow, none).alias("_extra"), F.filter(F.array(*numbers) if numbers else none, lambda s: s["value"].isNotNull()).alias("_numbers"))
    joined = own.join(hot, key, "left")
    entries = F.array_sort(F.concat(F.coalesce("_hot", none), "_numbers", "_extra"))
    return joined.select(key, entries.alias("_row")).select(
        key, F.col("_row.place").alias("places"), F.col("_row.value").alias("values")
    )
