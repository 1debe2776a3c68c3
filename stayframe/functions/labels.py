"""Outcome labels of a stay."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The discharge status that means death, and the two day limits.
DIED = 20
LONG_STAY_ABOVE = 6
READMIT_BELOW = 31
NOT_READMITTED = 9999


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def label_mortality() -> Column:
    return _flag(F.col("disc_status") == DIED)


def label_los() -> Column:
    return _flag((F.col("los") > LONG_STAY_ABOVE) | (F.col("disc_status") == DIED))


def label_readmit() -> Column:
    return _flag((F.col("readmit_time") < READMIT_BELOW) | (F.col("disc_status") == DIED))


def label_cost() -> Column:
    return F.col("pat_cost").cast("double")
