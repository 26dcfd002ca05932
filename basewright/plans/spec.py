"""What a base should contain. Contradictory wishes are refused before any plan is built."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.vocabulary import (
    CUSTOMER,
    CUSTOMER_TYPES,
    PROTOTYPE,
    SEGMENTS,
)
from ..operators.caps import checked_cap
from ..operators.filters import checked_date, checked_range
from ..operators.lookups import income_choice

EXACT, SUBSTRING = "exact", "substring"


@dataclass(frozen=True)
class BaseSpec:
    """The options of a base.

    source     credit_card / lending: read only that product; both or neither: the
               union. current: latest state of each collection instead of all days.
    filters    snapshot_date, days_late (low, high), customer_type, open_only, cured_only.
    grain      group_by: keys to collapse to; () keeps one row per collection and day.
    labels     lateness_cutoff adds 'lateness', product_segment adds 'segment'.
    lookups    tag_rule removes non-contactable customers; attributes come from the
               customers table; tiers are all required; income adds 'income_segments'
               and, for fewer than all values, keeps only those.
    output     segment keeps one segment; columns shape the result. No row is dropped
               unless row_cap asks for it.
    tag lists  forbidden_tags (exact rule) and needles (substring rule) replace the
               built-in ones; tag_list names a table of tags for the exact rule.
    """

    credit_card: bool = False
    lending: bool = False
    current: bool = False
    snapshot_date: str | None = None
    days_late: tuple[int, int] | None = None
    customer_type: str | None = None
    open_only: bool = False
    cured_only: bool = False
    group_by: tuple[str, ...] = ()
    lateness_cutoff: int | None = None
    product_segment: bool = False
    tag_rule: str | None = None
    fold_needles: bool = False
    attributes: tuple[str, ...] = ()
    tiers: tuple[str, ...] = ()
    income: tuple[str, ...] = ()
    segment: str | None = None
    columns: tuple[str, ...] = (CUSTOMER, PROTOTYPE)
    row_cap: int | None = None
    forbidden_tags: tuple[str, ...] | None = None
    needles: tuple[str, ...] | None = None
    tag_list: str | None = None

    def __post_init__(self) -> None:
        if self.snapshot_date is not None:
            checked_date(self.snapshot_date)
        if self.current and self.snapshot_date is not None:
            raise ValueError("the current state has no snapshot date to filter by")
        if self.customer_type not in (None, *CUSTOMER_TYPES):
            raise ValueError(f"customer type {self.customer_type!r} is not one of {CUSTOMER_TYPES}")
        if both := set(self.group_by) & set(self.attributes):
            raise ValueError(f"{sorted(both)} cannot be both a grouping key and looked up afterwards")
        if self.days_late is not None:
            checked_range(*self.days_late)
        if self.group_by and CUSTOMER not in self.group_by:
            raise ValueError(f"grouping keys {self.group_by} must contain {CUSTOMER!r}")
        if self.product_segment and not (self.credit_card and self.lending):
            raise ValueError("the product segment needs both product flags")
        if self.segment is not None:
            if not self.product_segment:
                raise ValueError("keeping one segment needs product_segment")
            if self.segment not in SEGMENTS:
                raise ValueError(f"segment {self.segment!r} is not one of {SEGMENTS}")
        if self.tag_rule not in (None, EXACT, SUBSTRING):
            raise ValueError(f"tag rule {self.tag_rule!r} is neither exact nor substring")
        if self.forbidden_tags is not None and self.tag_rule != EXACT:
            raise ValueError("forbidden_tags belong to the exact tag rule")
        if self.tag_list is not None and (self.tag_rule != EXACT or self.forbidden_tags is not None):
            raise ValueError("tag_list belongs to the exact tag rule and excludes forbidden_tags")
        if self.needles is not None and self.tag_rule != SUBSTRING:
            raise ValueError("needles belong to the substring tag rule")
        if self.income:
            income_choice(self.income)
        if not self.columns:
            raise ValueError("the base needs at least one column")
        if self.row_cap is not None:
            checked_cap(self.row_cap)
