"""Column naming."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Give physical names to the columns of `df`; names it lacks are an error."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"cannot rename missing columns {missing}")
    return df.withColumnsRenamed(dict(names))
