"""Which stays and charges take part, and what each stay is labelled with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from stayframe.functions import labels
from stayframe.operators.ordered import number_rows, scan_groups
from stayframe.operators.skew import HOT_ROWS, fan_out, lookup

# The admission columns the models may use.
STAY_COLUMNS = [
    "pat_key", "adm_mon", "disc_mon_seq", "adm_source", "point_of_origin", "adm_type", "mart_status",
    "age", "gender", "race", "hispanic_ind", "std_payor", "prov_id", "admphy_spec", "adm_phy",
    "attphy_spec", "att_phy", "proj_wgt", "disc_status", "pat_cost", "los",
]
BILL_COLUMNS = ["pat_key", "std_chg_code", "serv_day", "std_qty"]


def admission_columns(df: DataFrame, cols: Sequence[str] = STAY_COLUMNS) -> DataFrame:
    return df.select(*cols)


def cohort(adm: DataFrame, min_los: int = 1, limit: int | None = None) -> DataFrame:
    """Stays longer than ``min_los`` days; with ``limit``, the first so many by key.

    The cap numbers the stays chunk by chunk rather than sorting them into one task.
    """
    kept = adm.where(F.col("los") > min_los)
    if limit is None:
        return kept
    return number_rows(kept, ["pat_key"], "_n").where(F.col("_n") <= limit).drop("_n")


def bill_window(bill: DataFrame, days: Sequence[int] = (0, 1)) -> DataFrame:
    """Charge lines of the given service days, with the columns the sequence needs."""
    return bill.where(F.col("serv_day").isin(*days)).select(*BILL_COLUMNS)


def restrict_to(
    bill: DataFrame, stays: DataFrame, on: Sequence[str] = ("pat_key",), min_rows: int = HOT_ROWS
) -> DataFrame:
    """Charge lines whose stay is in ``stays`` (semi join)."""
    return lookup(bill, stays.select(*on), on, "left_semi", min_rows=min_rows)


def days_to_next(readmit: DataFrame, min_rows: int = HOT_ROWS, **options) -> DataFrame:
    """Days until the patient's next admission: the next row's ``days_from_prior``.

    Rows of a patient go by discharge month, and within a month by stay key.
    """
    return scan_groups(
        readmit,
        ["medrec_key"],
        ["disc_mon", "pat_key"],
        exact=["disc_mon"],
        cut="pat_key",
        leads={"readmit_time": F.col("days_from_prior")},
        min_rows=min_rows,
        **options,
    )


def attach_readmit(stays: DataFrame, times: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    """Left join the readmission horizon; a stay without one gets 9999.

    Several horizon rows for one stay give several rows, as a left join does.
    """
    horizon = times.select("pat_key", "readmit_time")
    return fan_out(stays, horizon, ["pat_key"], min_rows).withColumn(
        "readmit_time", F.coalesce("readmit_time", F.lit(labels.NOT_READMITTED))
    )


def with_labels(stays: DataFrame) -> DataFrame:
    return stays.withColumns(
        {
            "mortality_label": labels.label_mortality(),
            "los_label": labels.label_los(),
            "cost_label": labels.label_cost(),
            "readmit_label": labels.label_readmit(),
        }
    )


def sort_bill(bill: DataFrame) -> DataFrame:
    """Charge lines by stay and service day (code and quantity settle ties).

    The row number in the input only lets the range shuffle cut through copies of a line.
    """
    place = F.monotonically_increasing_id()
    ordered = bill.withColumn("_place", place).orderBy("pat_key", "serv_day", "std_chg_code", "std_qty", "_place")
    return ordered.drop("_place")


def first_n(bill: DataFrame, n: int = 1000) -> DataFrame:
    """The first n charge lines in that order, for a pilot run."""
    return bill.orderBy("pat_key", "serv_day", "std_chg_code", "std_qty").limit(n)


def preview(df: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    return df.orderBy(*by).limit(n)
