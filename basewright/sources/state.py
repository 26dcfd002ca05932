"""The current state as a stored table that a new day is merged into without moving it.

The state is stored in buckets of its key. A day's rows are brought to the buckets by one
shuffle of the day; the state is read bucket by bucket where it lies. The merged state is already dealt out by
key, so storing it again needs no shuffle either. Each store is a table of its own, shown by one view
that is replaced when it is complete (`sinks.versions`).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import COLLECTION, DATE
from ..sinks.versions import quoted, switch_table
from .collections import latest_state


def store_state(state: DataFrame, name: str, buckets: int, key: str = COLLECTION, dealt: bool = False) -> DataFrame:
    """Save a state in `buckets` buckets of `key`, and let the view `name` show it.

    `dealt` says that `state` comes from `merged_state` of a state with as many buckets.
    """
    spark = state.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    # With the rows dealt as buckets are, each task writes one file.
    rows = state if dealt else state.repartition(buckets, key)
    rows.write.bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    switch_table(spark, name, table)
    return spark.table(quoted(name))


def _newness(row: Column, date: str, ties: Sequence[str]) -> Column:
    """Later is greater, then the greater ties; null is least."""
    return F.struct(row[date], *(row[c] for c in ties))


def merged_state(
    state: DataFrame,
    new_days: DataFrame,
    buckets: int,
    key: str = COLLECTION,
    date: str = DATE,
    ties: Sequence[str] = (),
) -> DataFrame:
    """A state brought forward by the rows of some days: the newest row of every key, as `latest_state` has it.

    Among rows of the same date the one with the greatest `ties` is kept; if those are equal too, one of
    the new rows. `buckets` is the number the state was stored in. Days may come late or twice: an older row never replaces a newer one. Rows without a key
    count as one collection.
    """
    columns = state.columns
    if sorted(columns) != sorted(new_days.columns):
        raise ValueError(f"the state has columns {columns}, the new days {new_days.columns}")
    new_days = new_days.select(*columns)
    # Dealt out like the state, for ranking and join alike; otherwise Spark would deal out the state again.
    newest = latest_state(new_days.where(F.col(key).isNotNull()).repartition(buckets, key), key, date, ties)
    old = state.where(F.col(key).isNotNull()).select(F.col(key).alias("_old_key"), F.struct(*columns).alias("_old"))
    new = newest.select(F.col(key).alias("_new_key"), F.struct(*columns).alias("_new"))
    both = old.join(new, F.col("_old_key") == F.col("_new_key"), "full")
    stays = F.col("_new").isNull() | (_newness(F.col("_old"), date, ties) > _newness(F.col("_new"), date, ties))
    kept = both.select(F.when(F.col("_old").isNotNull() & stays, F.col("_old")).otherwise(F.col("_new")).alias("_row")).select("_row.*")
    without_key = state.unionByName(new_days).where(F.col(key).isNull())
    return kept.unionByName(latest_state(without_key, key, date, ties))
