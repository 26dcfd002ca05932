"""Rows per stage, counted in one pass, against counting every stage on its own."""

from dataclasses import replace

import pytest

from basewright.operators.tags import without_forbidden
from basewright.plans.build import build_base, enriched_base, lookups, row_filter, source_rows
from basewright.plans.stages import STAGES, stage_counts
from basewright.plans.templates import ELIGIBILITY_EXACT, ELIGIBILITY_SUBSTRING, OPEN_ONLY, PDP
from basewright.sources.fixtures import fixture_tables

BOTH_LABELS = {"group_by": (), "row_cap": 700}
SPECS = {
    "whole": replace(
        ELIGIBILITY_EXACT, tiers=("uv",), income=("super_core", "mass_market"), row_cap=None
    ),
    "pairs": replace(ELIGIBILITY_SUBSTRING, tag_rule="substring", segment="ll_only", row_cap=100),
    "ungrouped": replace(PDP, income=("super_core",), attributes=("prototype",)),
    "ungrouped_segment": replace(ELIGIBILITY_EXACT, segment="cc_only", **BOTH_LABELS),
    "no_lookups": OPEN_ONLY,
    "one_product": replace(OPEN_ONLY, credit_card=True, group_by=("customer__id",)),
}


@pytest.mark.parametrize("name", SPECS)
def test_stages_equal_separate_counts(spark, name):
    spec = SPECS[name]
    tables = fixture_tables(spark, "/root/testdata/sf0.01")
    source, base = source_rows(tables, spec), build_base(tables, spec)
    forbidden = lookups(tables, spec)["forbidden"]
    saved = enriched_base(tables, spec).count()
    expected = {
        "input": source.count(),
        "filtered": source.where(row_filter(spec)).count(),
        "grouped": base.count(),
        "compliant": (base if forbidden is None else without_forbidden(base, forbidden)).count(),
        "enriched": enriched_base(tables, replace(spec, segment=None)).count(),
        "saved": saved if spec.row_cap is None else min(saved, spec.row_cap),
    }
    got = stage_counts(tables, spec).orderBy("stage_no").collect()
    assert [r["stage"] for r in got] == list(STAGES)
    assert {r["stage"]: r["rows"] for r in got} == expected
    assert 0 < expected["saved"]
