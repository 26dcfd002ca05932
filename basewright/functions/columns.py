"""Column expressions: labels and tag tests. All are built-in Spark expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import alternation
from .vocabulary import DAYS_LATE, IS_CC, IS_LL


def lateness(cutoff: int, days_late: str = DAYS_LATE) -> Column:
    """'long' from the cutoff on, 'short' below it; unknown days late count as 'short'."""
    return F.when(F.col(days_late) >= cutoff, "long").otherwise("short")


def product_segment(cc: str = IS_CC, ll: str = IS_LL) -> Column:
    """Label a row by the products it holds; 'error' when neither flag says so.

    Before grouping every row comes from one product, so 'multi_debt' needs a
    base that was collapsed to one row per customer first.
    """
    holds_cc, holds_ll = F.col(cc) >= 1, F.col(ll) >= 1
    lacks_cc, lacks_ll = F.col(cc) == 0, F.col(ll) == 0
    return (
        F.when(holds_cc & holds_ll, "multi_debt")
        .when(holds_ll & lacks_cc, "ll_only")
        .when(holds_cc & lacks_ll, "cc_only")
        .otherwise("error")
    )


def zero_if_null(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def lowered(tags: str | Column) -> Column:
    """Every tag of an array in lower case; null arrays and null tags stay null."""
    return F.transform(tags, F.lower)


#: Up to so many needles a test each is fastest; more become one pattern.
FEW_NEEDLES = 64


def live_needles(needles: Sequence[str], fold: bool = False) -> list[str]:
    """The fewest needles that flag the same lowercased tags.

    An upper-case needle can never occur in lowercased text, so it is left out
    (or lowercased, with `fold`); a needle that contains another one is implied
    by the shorter one.
    """
    usable = dict.fromkeys(n.lower() if fold else n for n in needles)
    usable = [n for n in usable if n == n.lower()]
    return [n for n in usable if not any(o != n and o in n for o in usable)]


def any_tag_contains(tags: str | Column, needles: Sequence[str], fold: bool = False) -> Column:
    """True when a tag, lowercased, contains one of the needles.

    Null (not True) for a null array, or when only null tags could have matched. Any number of
    needles makes a plan of bounded size.
    """
    if len(needles) > FEW_NEEDLES:
        # Needles with capitals never match; what one pattern implies is left out there.
        pattern = alternation(n for n in (n.lower() if fold else n for n in needles) if n == n.lower())
        return F.lit(False) if pattern is None else F.exists(lowered(tags), lambda tag: tag.rlike(pattern))
    kept = live_needles(needles, fold)
    if not kept:
        return F.lit(False)
    return F.exists(lowered(tags), lambda tag: reduce(or_, (tag.contains(n) for n in kept)))
