from dataclasses import replace

import pytest

from basewright import BaseSpec
from basewright.operators.filters import days_late_between, on_date
from basewright.plans.build import base_for, measures, project
from basewright.plans.templates import ELIGIBILITY_EXACT, ELIGIBILITY_SUBSTRING, TEMPLATES
from basewright.sources.fixtures import fixture_tables

BOTH = {"credit_card": True, "lending": True}


@pytest.mark.parametrize(
    "options",
    [
        {"days_late": (10, 5)},
        {"days_late": (None, 5)},
        {"snapshot_date": "03/03/2026"},
        {"snapshot_date": "2026-03-03x"},
        {"snapshot_date": "2026-03-03", "current": True},
        {"product_segment": True},
        {"product_segment": True, "credit_card": True},
        {"segment": "cc_only"},
        {"segment": "error", "product_segment": True, **BOTH},
        {"tag_rule": "fuzzy"},
        {"income": ("rich",)},
        {"columns": ()},
        {"row_cap": 0},
        {"snapshot_date": "2026-02-30"},
        {"customer_type": "persn"},
        {"group_by": ("customer__id", "prototype"), "attributes": ("prototype",)},
        {"forbidden_tags": ("x",), "tag_rule": "substring"},
        {"needles": ("x",)},
        {"row_cap": -3},
        {"group_by": ("prototype",)},
    ],
)
def test_contradictions_are_refused(options):
    with pytest.raises(ValueError):
        BaseSpec(**options)


def test_operators_check_their_own_arguments():
    with pytest.raises(ValueError):
        on_date("2026-3-3")
    with pytest.raises(ValueError):
        days_late_between(3, 2)


def test_unknown_columns_are_refused(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="nope"):
        project(df, ("a", "nope"))


def test_only_wanted_measures_are_kept():
    assert measures(BaseSpec()) == []
    assert measures(BaseSpec(lending=True)) == ["is_ll"]
    assert measures(BaseSpec(credit_card=True, lateness_cutoff=5)) == ["is_cc", "product__days_late"]
    assert measures(ELIGIBILITY_EXACT) == ["is_cc", "is_ll", "product__days_late"]


def test_templates():
    assert len(TEMPLATES) == 5
    assert ELIGIBILITY_EXACT.days_late == (5, 365)
    assert ELIGIBILITY_SUBSTRING.group_by == ("customer__id", "prototype")
    assert ELIGIBILITY_SUBSTRING.tag_rule is None


def test_unused_tables_are_never_opened(spark):
    tables = fixture_tables(spark, "/root/testdata/sf0.001")
    base_for(tables, BaseSpec(credit_card=True, columns=("customer__id",)))
    assert set(tables._opened) == {"collections_cc"}


@pytest.mark.parametrize("name", TEMPLATES)
def test_capped_templates_hold_their_cap(spark, name):
    tables = fixture_tables(spark, "/root/testdata/sf0.001")
    assert base_for(tables, replace(TEMPLATES[name], row_cap=17)).count() == 17


def test_no_row_cap_unless_asked():
    assert BaseSpec().row_cap is None
