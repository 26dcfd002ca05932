"""Keeping joins splittable when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

MANY_PARTITIONS = 1_000_000


def with_own_shuffle(lookup: DataFrame) -> DataFrame:
    """`lookup`, to be shuffled once more by the join it takes part in.

    A lookup that was grouped by the join key is already partitioned by it, so Spark
    joins it within that stage. Its skew handling, which cuts a hot partition of the
    other side into many tasks, works only where both inputs come straight from a
    shuffle. Coalescing to more partitions than there are moves no row; it merely
    makes the join shuffle the lookup (customer grain, small next to the base) again.
    """
    return lookup.coalesce(MANY_PARTITIONS)


def as_it_is(lookup: DataFrame) -> DataFrame:
    """`lookup` joined in the stage that grouped it: right where no key of the base is hot."""
    return lookup


def joinable(lookup: DataFrame, one_per_key: bool) -> DataFrame:
    """`lookup` as it should meet a base with one row per key, or with any number."""
    return as_it_is(lookup) if one_per_key else with_own_shuffle(lookup)
