"""Saving bases: one table, one table per combination, CSV export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import LATENESS, LATENESS_VALUES, SEGMENT, SEGMENTS
from ..operators.caps import cap_per_combo, checked_cap, combo_key
from .versions import checked_version, new_version, quoted, replace_view, switch

ALLOWED = {SEGMENT: SEGMENTS, LATENESS: LATENESS_VALUES}
SPLITS = {
    "segment": (SEGMENT,),
    "lateness": (LATENESS,),
    "segment_lateness": (SEGMENT, LATENESS),
}


def save_table(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write `df` and let the name `name` show it, replacing what it showed; returns the saved table.

    The files go to a folder of their own below `folder` (or the warehouse). The name changes
    over in one step once they are written, see `versions`: after a failed save it shows the rows of the one
    before, and `df` may read them.
    """
    spark = df.sparkSession
    path = new_version(spark, name, folder)
    df.write.parquet(path)
    _fill_if_empty(df, path)
    checked_version(spark, path, df.columns)
    switch(spark, name, path)
    return spark.table(name)


def _fill_if_empty(df: DataFrame, path: str, parts: Mapping[str, str] | None = None) -> None:
    """A version without rows gets a file without rows, so that its columns are known.

    A partitioned one gets it in the partition of `parts`.
    """
    spark, parts = df.sparkSession, parts or {}
    if spark.read.schema(df.schema).parquet(path).isEmpty():
        place = "".join(f"/{part}={value}" for part, value in parts.items())
        spark.createDataFrame([], df.drop(*parts).schema).write.mode("append").parquet(f"{path}{place}")


def preview(spark: SparkSession, name: str, rows: int = 20) -> None:
    """Print the first rows of a saved table."""
    spark.table(name).show(rows, truncate=False)


def export_csv(
    spark: SparkSession, names: Sequence[str], folder: str, single_file: bool = False
) -> list[str]:
    """Write saved tables as CSV with a header, one folder per table.

    `single_file` gives one file per table; that sends a whole table through one
    task, so it suits capped tables only.
    """
    paths = []
    for name in names:
        table = spark.table(name)
        table = table.coalesce(1) if single_file else table
        path = f"{folder.rstrip('/')}/{name}"
        table.write.mode("overwrite").option("header", "true").csv(path)
        paths.append(path)
    return paths


def split_values(
    mode: str,
    segments: Sequence[str] = SEGMENTS,
    lateness: Sequence[str] = LATENESS_VALUES,
) -> dict[str, tuple[str, ...]]:
    """The column or columns a split uses, with the values to keep, in their usual order."""
    if mode not in SPLITS:
        raise ValueError(f"split {mode!r} is not one of {tuple(SPLITS)}")
    asked = {SEGMENT: segments, LATENESS: lateness}
    unknown = [v for c in SPLITS[mode] for v in asked[c] if v not in ALLOWED[c]]
    if unknown:
        raise ValueError(f"{unknown} are no values of {SPLITS[mode]}")
    kept = {c: tuple(v for v in ALLOWED[c] if v in asked[c]) for c in SPLITS[mode]}
    empty = [c for c, values in kept.items() if not values]
    if empty:
        raise ValueError(f"the split keeps no value of {empty}")
    return kept


def table_names(name: str, values: Mapping[str, Sequence[str]]) -> dict[tuple[str, ...], str]:
    """Table name of every combination: `<name>_<segment>_<lateness>`."""
    return {combo: combo_key(name, *combo) for combo in product(*values.values())}


#: Property of a view that holds its text.
DEFINITION = "basewright.select"


def _definition(spark: SparkSession, name: str) -> str | None:
    if not spark.catalog.tableExists(name) or spark.catalog.getTable(name).tableType != "VIEW":
        return None
    held = spark.sql(f"SHOW TBLPROPERTIES {quoted(name)}").where(f"key = '{DEFINITION}'").first()
    return held["value"] if held else None


def save_split(
    df: DataFrame,
    name: str,
    mode: str,
    columns: Sequence[str],
    segments: Sequence[str] = SEGMENTS,
    lateness: Sequence[str] = LATENESS_VALUES,
    row_cap: int | None = None,
    caps: Mapping[str, int] | None = None,
    order_by: Sequence[str] = (),
    folder: str | None = None,
) -> dict[str, DataFrame]:
    """Save one table per combination; returns the saved tables by name.

    The base is computed and written once, partitioned by combination, to a folder of its
    own below `folder` (or the warehouse); each name is a view of one of its partitions. They
    all look through one pointer, `<name>_rows`, so that saving a split again replaces all tables in one
    step, or none if it fails (see `versions`). Only a split whose columns change redefines
    the views one by one, after the switch.

    Caps are applied to all combinations together before the write, so no more than the
    caps is ever stored. They keep the first rows by `order_by`; without it,
    by the other columns. `caps` without a `row_cap` leave other combinations whole.
    """
    spark = df.sparkSession
    values = split_values(mode, segments, lateness)
    missing = [c for c in (*values, *columns) if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in the base; it has {df.columns}")
    combos = {combo_key(*combo) for combo in product(*values.values())}
    if strange := sorted(set(caps or {}) - combos):
        raise ValueError(f"caps are given for {strange}, which the split has no table for")
    for cap in (*([] if row_cap is None else [row_cap]), *(caps or {}).values()):
        checked_cap(cap)

    parts = {c: f"split_{c}" for c in values}
    rows = df.where(reduce(and_, (F.col(c).isin(*kept) for c, kept in values.items())))
    rows = rows.select(*columns, *(F.col(c).alias(part) for c, part in parts.items()))
    if row_cap is not None or caps:
        rows = cap_per_combo(rows, row_cap, caps, tuple(parts.values()), order_by)
    names = table_names(name, values)
    path = new_version(spark, name, folder)
    rows.write.partitionBy(*parts.values()).parquet(path)
    _fill_if_empty(rows, path, dict(zip(parts.values(), next(iter(names)), strict=True)))
    checked_version(spark, path, rows.columns)

    pointer = f"{name}_rows"
    switch(spark, pointer, path)
    shown = ", ".join(quoted(c) for c in columns)
    for combo, table in names.items():
        select = f"SELECT {shown} FROM {quoted(pointer)} WHERE " + " AND ".join(
            f"{part} = '{value}'" for part, value in zip(parts.values(), combo, strict=True)
        )
        if _definition(spark, table) != select:
            replace_view(spark, table, select, {DEFINITION: select})
    return {table: spark.table(table) for table in names.values()}
