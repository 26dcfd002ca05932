"""Customer lookups: attributes, tiers and income segments.

Every lookup is reduced to one row per customer before it meets the base, so a
join never adds rows. `with_lookups` combines the lookups with each other first,
at customer grain, and joins the base once: the large side is shuffled once, and
a customer with a large share of its rows can be split over many tasks. Whether a
lookup is broadcast is left to Spark, which goes by its measured size.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import zero_if_null
from ..functions.vocabulary import CUSTOMER, DATE, INCOME, INCOME_MONTH, INCOME_SEGMENTS
from .skew import joinable, with_own_shuffle
from .tags import without_forbidden


def attributes_by_customer(
    customers: DataFrame, columns: Sequence[str], key: str = CUSTOMER
) -> DataFrame:
    """One row per customer: the greatest of its (contract-level) attribute rows."""
    return (
        customers.groupBy(key)
        .agg(F.max(F.struct(*columns)).alias("_row"))
        .select(key, *(F.col(f"_row.{c}").alias(c) for c in columns))
    )


def with_attributes(
    df: DataFrame,
    customers: DataFrame,
    columns: Sequence[str],
    key: str = CUSTOMER,
    one_per_key: bool = False,
) -> DataFrame:
    """Attach attributes; rows of customers the lookup lacks are dropped."""
    attributes = attributes_by_customer(customers, columns, key)
    return df.join(joinable(attributes, one_per_key), key, "inner")


def members(tier: DataFrame, key: str = CUSTOMER) -> DataFrame:
    return tier.select(key).distinct()


def in_tier(
    df: DataFrame, tier: DataFrame, name: str, key: str = CUSTOMER, one_per_key: bool = False
) -> DataFrame:
    """Keep the members of a tier and mark them with a column of ones."""
    kept = df.join(joinable(members(tier, key), one_per_key), key, "leftsemi")
    return kept.withColumn(name, F.lit(1))


def flag_tier(
    df: DataFrame, tier: DataFrame, name: str, key: str = CUSTOMER, one_per_key: bool = False
) -> DataFrame:
    """Mark members 1 and everybody else 0, keeping all rows."""
    flagged = joinable(members(tier, key).withColumn(name, F.lit(1)), one_per_key)
    return df.join(flagged, key, "left").withColumn(name, zero_if_null(name))


def latest_date(collections: DataFrame) -> DataFrame:
    """The newest snapshot day of a collections table, as one row."""
    if DATE not in collections.columns:
        raise ValueError(f"the newest day needs a {DATE!r} column")
    return collections.agg(F.max(DATE).alias("latest_date"))


def recent_income(income: DataFrame, collections: DataFrame) -> DataFrame:
    """Income rows whose month starts on or after the newest snapshot day.

    The day is a scalar subquery: it is never collected while the plan is built.
    """
    return income.where(F.col(INCOME_MONTH) >= latest_date(collections).scalar())


def income_by_customer(income: DataFrame, key: str = CUSTOMER) -> DataFrame:
    """One segment per customer: that of the latest month, then the greatest."""
    return income.groupBy(key).agg(F.max_by(INCOME, F.struct(INCOME_MONTH, INCOME)).alias(INCOME))


def income_choice(values: Sequence[str]) -> tuple[str, ...]:
    """The wanted segments in their usual order; () means all, so no filter."""
    wanted = tuple(v for v in INCOME_SEGMENTS if v in values)
    if not wanted or len(wanted) < len(set(values)):
        raise ValueError(f"income segments {list(values)} must be some of {INCOME_SEGMENTS}")
    return wanted if len(wanted) < len(INCOME_SEGMENTS) else ()


def with_income(
    df: DataFrame,
    income: DataFrame,
    values: Sequence[str] = INCOME_SEGMENTS,
    key: str = CUSTOMER,
    one_per_key: bool = False,
) -> DataFrame:
    """Attach the income segment (null where unknown), or keep a strict subset of them.

    `income` has one row per customer, see `income_by_customer`.
    """
    wanted = income_choice(values)
    if wanted:
        income = income.where(F.col(INCOME).isin(*wanted))
    return df.join(joinable(income, one_per_key), key, "inner" if wanted else "left")


def audience(
    *,
    forbidden: DataFrame | None = None,
    attributes: DataFrame | None = None,
    tiers: Mapping[str, DataFrame] | None = None,
    income: DataFrame | None = None,
    income_values: Sequence[str] = INCOME_SEGMENTS,
    key: str = CUSTOMER,
) -> DataFrame | None:
    """The customers that all restricting lookups let through, with what they add.

    None when no lookup restricts the base to known customers.
    """
    rest = dict(tiers or {})
    if attributes is not None:
        chosen = attributes
    elif rest:
        first = next(iter(rest))
        chosen = members(rest.pop(first), key).withColumn(first, F.lit(1))
    elif income is not None and income_choice(income_values):
        chosen = income.where(F.col(INCOME).isin(*income_choice(income_values)))
        income = None
    else:
        return None
    for name, tier in rest.items():
        chosen = in_tier(chosen, tier, name, key, one_per_key=True)
    if forbidden is not None:
        chosen = without_forbidden(chosen, forbidden, key, one_per_key=True)
    if income is not None:
        chosen = with_income(chosen, income, income_values, key, one_per_key=True)
    return chosen


def with_lookups(
    base: DataFrame,
    *,
    forbidden: DataFrame | None = None,
    attributes: DataFrame | None = None,
    tiers: Mapping[str, DataFrame] | None = None,
    income: DataFrame | None = None,
    income_values: Sequence[str] = INCOME_SEGMENTS,
    key: str = CUSTOMER,
    prepare: Callable[[DataFrame], DataFrame] = with_own_shuffle,
) -> DataFrame:
    """Remove forbidden customers and apply all other lookups, with one join of the base.

    Same rows as chaining `without_forbidden`, `with_attributes`, `in_tier` and
    `with_income`. `prepare` is applied to the combined lookup before that join.
    """
    chosen = audience(
        forbidden=forbidden,
        attributes=attributes,
        tiers=tiers,
        income=income,
        income_values=income_values,
        key=key,
    )
    if chosen is not None:
        return base.join(prepare(chosen), key, "inner")
    if forbidden is None:
        return base if income is None else base.join(prepare(income), key, "left")
    if income is None:
        return base.join(prepare(forbidden), key, "leftanti")
    marked = income.join(forbidden.withColumn("_forbidden", F.lit(True)), key, "full")
    joined = base.join(prepare(marked), key, "left")
    return joined.where(F.col("_forbidden").isNull()).drop("_forbidden")
