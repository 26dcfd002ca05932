"""From a BaseSpec to a DataFrame: source, filters, grain, labels, lookups, output."""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import lateness, product_segment
from ..functions.vocabulary import (
    COLLECTION_END,
    CURED,
    CUSTOMER,
    CUSTOMER_TYPE,
    DAYS_LATE,
    EXACT_TAGS,
    IS_CC,
    IS_LL,
    LATENESS,
    SEGMENT,
    TAG_NEEDLES,
)
from ..operators.caps import any_rows
from ..operators.filters import all_of, days_late_between, is_cured, is_open, of_type, on_date
from ..operators.grouping import one_row_per
from ..operators.lookups import (
    attributes_by_customer,
    income_by_customer,
    recent_income,
    with_lookups,
)
from ..operators.partials import Partials
from ..operators.prefilter import is_broadcast, without_keys
from ..operators.skew import as_it_is, with_own_shuffle
from ..operators.tags import forbidden_by_exact_tag, forbidden_by_substring
from ..sinks.shared import written
from ..sources.collections import collections_source, has_current_tables, product_tables
from .spec import EXACT, BaseSpec


def source_rows(tables: Mapping[str, DataFrame], spec: BaseSpec) -> DataFrame:
    """The flagged collections, without columns the customers table will supply."""
    rows = collections_source(tables, spec.credit_card, spec.lending, spec.current, used_columns(spec))
    return rows.drop(*spec.attributes)


def used_columns(spec: BaseSpec) -> list[str]:
    """The columns of collections that can change a base: keys, filters, measures, output."""
    filters = {CUSTOMER_TYPE: spec.customer_type, COLLECTION_END: spec.open_only, CURED: spec.cured_only, DAYS_LATE: spec.days_late}
    wanted = {CUSTOMER, *spec.group_by, *measures(spec), *spec.columns, *(c for c, on in filters.items() if on)}
    return sorted(wanted - set(spec.attributes))


def row_filter(spec: BaseSpec) -> Column:
    """The filters of a spec as one predicate."""
    predicates = []
    if spec.snapshot_date is not None:
        predicates.append(on_date(spec.snapshot_date))
    if spec.customer_type is not None:
        predicates.append(of_type(spec.customer_type))
    if spec.open_only:
        predicates.append(is_open())
    if spec.cured_only:
        predicates.append(is_cured())
    if spec.days_late is not None:
        predicates.append(days_late_between(*spec.days_late))
    return all_of(predicates)


def filtered_rows(tables: Mapping[str, DataFrame], spec: BaseSpec) -> DataFrame:
    return source_rows(tables, spec).where(row_filter(spec))


def measures(spec: BaseSpec) -> list[str]:
    """Columns worth keeping when rows are collapsed: wanted flags, days late if used."""
    uses_days_late = spec.days_late is not None or spec.lateness_cutoff is not None
    wanted = {IS_CC: spec.credit_card, IS_LL: spec.lending, DAYS_LATE: uses_days_late}
    return [column for column, is_wanted in wanted.items() if is_wanted]


def labelled(rows: DataFrame, spec: BaseSpec) -> DataFrame:
    if spec.lateness_cutoff is not None:
        rows = rows.withColumn(LATENESS, lateness(spec.lateness_cutoff))
    if spec.product_segment:
        rows = rows.withColumn(SEGMENT, product_segment())
    return rows


def build_base(tables: Mapping[str, DataFrame], spec: BaseSpec) -> DataFrame:
    """The base that all outputs of a spec share, before any lookup."""
    rows = filtered_rows(tables, spec)
    if spec.group_by:
        rows = one_row_per(rows, spec.group_by, measures(spec))
    return labelled(rows, spec)


def forbidden_customers(tables: Mapping[str, DataFrame], spec: BaseSpec) -> DataFrame | None:
    if spec.tag_rule is None:
        return None
    if spec.tag_rule == EXACT:
        listed = tables[spec.tag_list] if spec.tag_list else spec.forbidden_tags or EXACT_TAGS
        return forbidden_by_exact_tag(tables["customers"], listed)
    return forbidden_by_substring(
        tables["tags_daily"], spec.needles or TAG_NEEDLES, spec.fold_needles
    )


def lookups(tables: Mapping[str, DataFrame], spec: BaseSpec) -> dict:
    """The lookups a spec asks for, as arguments of `with_lookups`; others stay unread."""
    wanted: dict = {"forbidden": forbidden_customers(tables, spec)}
    if spec.attributes:
        wanted["attributes"] = attributes_by_customer(tables["customers"], spec.attributes)
    if spec.tiers:
        wanted["tiers"] = {name: tables[f"tier_{name}"] for name in spec.tiers}
    if spec.income:
        # The newest day is read from the first product table, before any filter. Where no
        # ready-made current table exists, the daily one has the same newest day.
        ready = spec.current and has_current_tables(tables, spec.credit_card, spec.lending)
        _, dated = product_tables(tables, spec.credit_card, spec.lending, ready)[0]
        wanted["income"] = income_by_customer(recent_income(tables["income_segments"], dated))
        wanted["income_values"] = spec.income
    return wanted


def project(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in the base; it has {df.columns}")
    return df.select(*columns)


def partials_of(tables: Mapping[str, DataFrame], spec: BaseSpec, path: str) -> Partials:
    """The store of a grouped spec's partial results. It holds for this spec: its filters are applied before a day is added.

    `partials.add(filtered_rows(tables, spec))`, with tables that hold some days, adds these days.
    """
    if not spec.group_by or spec.current or spec.snapshot_date:
        raise ValueError("partial results are kept for a grouped base over all days")
    rows = filtered_rows(tables, spec)
    return Partials(rows.sparkSession, path, spec.group_by, measures(spec), rows)


def enriched_base(
    tables: Mapping[str, DataFrame], spec: BaseSpec, staged: bool | None = None, partials: Partials | None = None
) -> DataFrame:
    """The base after all lookups, with every column and without a cap.

    `staged`, the rule for a base without grouping, writes the combined lookup to the shared folder first. Its size is then
    known before the base is touched, so a small one is broadcast and a base without
    grouping, the largest input there is, need not be shuffled at all. Forbidden customers that are too many for that, with
    nothing else to look up, are removed through a filter over their keys (`prefilter`). With `partials` the
    grouping is read from stored results instead of the collections.
    """
    stages = not spec.group_by if staged is None else staged
    if stages:
        prepare = partial(written, purpose="lookup")
    elif spec.group_by == (CUSTOMER,):
        prepare = as_it_is
    else:
        prepare = with_own_shuffle
    base = build_base(tables, spec) if partials is None else labelled(partials.total(), spec)
    wanted = lookups(tables, spec)
    if stages and [name for name, lookup in wanted.items() if lookup is not None] == ["forbidden"]:
        flagged = written(wanted["forbidden"], "lookup")
        rows = base.join(flagged, CUSTOMER, "leftanti") if is_broadcast(flagged) else without_keys(base, flagged, CUSTOMER)
    else:
        rows = with_lookups(base, prepare=prepare, **wanted)
    return rows if spec.segment is None else rows.where(F.col(SEGMENT) == spec.segment)


def finish_base(rows: DataFrame, spec: BaseSpec) -> DataFrame:
    rows = project(rows, spec.columns)
    return rows if spec.row_cap is None else any_rows(rows, spec.row_cap)


def base_for(
    tables: Mapping[str, DataFrame], spec: BaseSpec, staged: bool | None = None, partials: Partials | None = None
) -> DataFrame:
    """The whole base a spec describes."""
    return finish_base(enriched_base(tables, spec, staged, partials), spec)
