"""Checks on data: unique keys, contradictory filters, unlabelled rows, rows per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import CUSTOMER, SEGMENT
from .filters import is_cured, is_open


def repeated_keys(df: DataFrame, key: str = CUSTOMER) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def key_uniqueness(df: DataFrame, name: str, key: str = CUSTOMER) -> DataFrame:
    """One row: how many keys a lookup has, how many repeat, and the most rows of one key."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.count(F.lit(1)).alias("keys"),
        F.count_if(F.col("n") > 1).alias("repeated_keys"),
        F.max("n").alias("most_rows"),
    ).select(F.lit(name).alias("lookup"), "keys", "repeated_keys", "most_rows")


def cured_and_open(collections: DataFrame) -> DataFrame:
    """Rows that are cured, open, and both: both together is usually (nearly) none."""
    return collections.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(is_cured()).alias("cured"),
        F.count_if(is_open()).alias("open"),
        F.count_if(is_cured() & is_open()).alias("cured_and_open"),
    )


def segment_counts(base: DataFrame) -> DataFrame:
    """Rows per segment; rows labelled 'error' carry neither product."""
    return base.groupBy(SEGMENT).agg(F.count(F.lit(1)).alias("rows"))
