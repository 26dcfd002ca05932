"""One row per customer (or per customer and prototype)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row_per(df: DataFrame, keys: Sequence[str], measures: Sequence[str] = ()) -> DataFrame:
    """Collapse `df` to its keys with the maximum of each measure.

    The maxima are combined inside each map task first, so a customer with very
    many collections costs one shuffled row per task. Without measures only the
    distinct keys are left.
    """
    if not keys:
        raise ValueError("grouping needs at least one key")
    if not measures:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*(F.max(m).alias(m) for m in measures))
