"""The five ready-made specs. Vary one with `dataclasses.replace(spec, ...)`.

Two variants exist: the *exact* one matches whole tags and takes `prototype` from
the customers table; the *substring* one matches parts of tags, keeps open
collections, and has `prototype` on the collections themselves.
"""

from __future__ import annotations

from ..functions.vocabulary import CUSTOMER, LATENESS, PROTOTYPE, SEGMENT
from .spec import EXACT, SUBSTRING, BaseSpec

# --- fixed values: the templates' options -----------------------------------------
ELIGIBILITY_EXACT = BaseSpec(
    credit_card=True,
    lending=True,
    snapshot_date="2026-03-03",
    days_late=(5, 365),
    customer_type="person",
    group_by=(CUSTOMER,),
    lateness_cutoff=65,
    product_segment=True,
    tag_rule=EXACT,
    attributes=(PROTOTYPE,),
    columns=(CUSTOMER, LATENESS, SEGMENT, PROTOTYPE),
    row_cap=100_000,
)

HOMEPAGE = BaseSpec(
    customer_type="person",
    tag_rule=EXACT,
    attributes=(PROTOTYPE,),
    columns=(CUSTOMER, PROTOTYPE),
    row_cap=50_000,
)

ELIGIBILITY_SUBSTRING = BaseSpec(
    credit_card=True,
    lending=True,
    open_only=True,
    days_late=(5, 60),
    group_by=(CUSTOMER, PROTOTYPE),
    lateness_cutoff=60,
    product_segment=True,
    columns=(CUSTOMER, LATENESS, SEGMENT, PROTOTYPE),
    row_cap=100_000,
)

PDP = BaseSpec(
    open_only=True,
    tag_rule=SUBSTRING,
    columns=(CUSTOMER, PROTOTYPE),
    row_cap=100_000,
)

OPEN_ONLY = BaseSpec(
    open_only=True,
    columns=(CUSTOMER, PROTOTYPE),
    row_cap=100_000,
)

TEMPLATES = {
    "eligibility_exact": ELIGIBILITY_EXACT,
    "homepage": HOMEPAGE,
    "eligibility_substring": ELIGIBILITY_SUBSTRING,
    "pdp": PDP,
    "open_only": OPEN_ONLY,
}
