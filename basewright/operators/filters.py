"""Row filters on collections. Each is a plain predicate, so Spark can push it to the scan."""

from __future__ import annotations

import re
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import COLLECTION_END, CURED, CUSTOMER_TYPE, DATE, DAYS_LATE


def checked_date(day: str) -> str:
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", day):
        raise ValueError(f"snapshot date {day!r} is not of the form YYYY-MM-DD")
    date.fromisoformat(day)  # raises ValueError for days that don't exist
    return day


def checked_range(low: int, high: int) -> tuple[int, int]:
    if low is None or high is None or low > high:
        raise ValueError(f"days late range {low}..{high} is empty or incomplete")
    return low, high


def on_date(day: str) -> Column:
    return F.col(DATE) == F.lit(checked_date(day)).cast("date")


def of_type(customer_type: str) -> Column:
    return F.col(CUSTOMER_TYPE) == customer_type


def is_open() -> Column:
    return F.col(COLLECTION_END).isNull()


def is_cured() -> Column:
    return F.col(CURED) == 1


def days_late_between(low: int, high: int) -> Column:
    """Both ends count; unknown days late never match."""
    return F.col(DAYS_LATE).between(*checked_range(low, high))


def all_of(predicates: list[Column]) -> Column:
    return reduce(and_, predicates, F.lit(True))


def keep(df: DataFrame, *predicates: Column) -> DataFrame:
    return df.where(all_of(list(predicates))) if predicates else df
