"""Collections inputs: product tagging, union, latest state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..functions.vocabulary import COLLECTION, DATE, IS_CC, IS_LL


def latest_state(
    daily: DataFrame, key: str = COLLECTION, date: str = DATE, ties: Sequence[str] = ()
) -> DataFrame:
    """The newest row of every collection.

    `row_number() = 1` lets Spark keep one row per key inside each map task
    (WindowGroupLimit) before it shuffles. Stored by day, a task holds a collection once,
    so all history is shuffled: derive the state once, then use `advanced`.
    A collection occurs once a day (`checks.repeated_keys` tells); where it does not, the
    row with the greatest `ties` is kept, nulls last. Naming no ties keeps columns that
    nobody asks for out of the scan.
    """
    if date not in daily.columns:
        raise ValueError(f"the latest state needs a {date!r} column")
    greatest_first = [F.col(c).desc_nulls_last() for c in ties]
    newest_first = Window.partitionBy(key).orderBy(F.col(date).desc(), *greatest_first)
    return (
        daily.withColumn("_age", F.row_number().over(newest_first))
        .where(F.col("_age") == 1)
        .drop("_age")
    )


def advanced(
    current: DataFrame,
    new_days: DataFrame,
    key: str = COLLECTION,
    date: str = DATE,
    ties: Sequence[str] = (),
) -> DataFrame:
    """A stored latest state brought forward by the rows of later days.

    Costs one pass over the state and the new days, whatever the length of the history. A state
    that is stored in buckets need not even be shuffled, see `state.merged_state`.
    """
    return latest_state(current.unionByName(new_days), key, date, ties)


def wanted_products(credit_card: bool, lending: bool) -> tuple[bool, bool]:
    """Which product tables to read; asking for neither means both."""
    return (credit_card, lending) if credit_card or lending else (True, True)


def has_current_tables(
    tables: Mapping[str, DataFrame], credit_card: bool, lending: bool
) -> bool:
    """Whether a ready-made current table exists for the first product that is read."""
    name = "collections_cc" if wanted_products(credit_card, lending)[0] else "collections_ll"
    return f"{name}_current" in tables


def tie_columns(daily: DataFrame, among: Sequence[str] | None = None) -> list[str]:
    """The columns that choose between rows of a collection and day: those of `among`, or all, in order of name."""
    fixed = {COLLECTION, DATE}
    comparable = {f.name for f in daily.schema if not isinstance(f.dataType, MapType)} - fixed
    return sorted(comparable if among is None else comparable & set(among))


def product_tables(
    tables: Mapping[str, DataFrame],
    credit_card: bool,
    lending: bool,
    current: bool = False,
    ties: Sequence[str] | None = None,
) -> list[tuple[str, DataFrame]]:
    """(flag column, collections) for each product table that has to be read.

    With `current`, ready-made current tables are used where they exist; otherwise
    the latest state is derived from the daily ones. Of several rows of a collection on its newest day the
    one with the greatest values is kept, column by column in order of name. `ties` names the columns
    that count: with all that are used later, the outcome is as definite as with all there are, and
    the others need not be read.
    """
    want_cc, want_ll = wanted_products(credit_card, lending)
    wanted = [(IS_CC, "collections_cc")] * want_cc + [(IS_LL, "collections_ll")] * want_ll
    found = []
    for flag, name in wanted:
        if not current:
            found.append((flag, tables[name]))
        elif f"{name}_current" in tables:
            found.append((flag, tables[f"{name}_current"]))
        else:
            found.append((flag, latest_state(tables[name], ties=tie_columns(tables[name], ties))))
    return found


def collections_source(
    tables: Mapping[str, DataFrame],
    credit_card: bool = False,
    lending: bool = False,
    current: bool = False,
    ties: Sequence[str] | None = None,
) -> DataFrame:
    """Collections of the wanted products, each row flagged with its product.

    One product carries only its own flag column. Two products are united by
    name (columns only one of them has become null) and carry both flags.
    """
    found = product_tables(tables, credit_card, lending, current, ties)
    if len(found) == 1:
        [(flag, rows)] = found
        return rows.withColumn(flag, F.lit(1))
    flags = [flag for flag, _ in found]
    (_, first), (_, second) = (
        (own, rows.withColumns({flag: F.lit(int(flag == own)) for flag in flags}))
        for own, rows in found
    )
    return first.unionByName(second, allowMissingColumns=True)
