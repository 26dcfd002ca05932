"""The single-join form of the lookups against the chained operators, and against plain Python."""

import datetime as dt
from itertools import product

import pytest

from basewright.operators import lookups as L
from basewright.operators.tags import without_forbidden

K = "customer__id"
APRIL, MAY, PAST = dt.date(2026, 4, 1), dt.date(2026, 5, 1), dt.date(2026, 2, 1)


@pytest.fixture(scope="module")
def data(spark):
    ids = [None, *range(1, 13)]
    base = [(k, n) for k in ids for n in range(3 if k == 5 else 1)]
    return {
        "base": spark.createDataFrame(base, f"{K} bigint, n int"),
        "forbidden": spark.createDataFrame([(2,), (7,), (99,), (None,)], f"{K} bigint"),
        "customers": spark.createDataFrame(
            [(k, f"p{k}") for k in range(1, 11) for _ in range(1 + k % 2)] + [(None, "p")],
            f"{K} bigint, prototype string",
        ),
        "tier_a": spark.createDataFrame([(k,) for k in (1, 2, 3, 3, 5, 6, 50)], f"{K} bigint"),
        "tier_b": spark.createDataFrame([(k,) for k in (3, 3, 5, 7, None)], f"{K} bigint"),
        "income": spark.createDataFrame(
            [(1, "mass_market"), (2, "super_core"), (3, "high_income"), (5, "mass_market")],
            f"{K} bigint, income_segments string",
        ),
    }


TIERS = [(), ("tier_a",), ("tier_a", "tier_b")]
INCOMES = [None, L.INCOME_SEGMENTS, ("mass_market", "super_core")]


@pytest.mark.parametrize(
    "forbidden,attributes,tiers,income",
    list(product([False, True], [False, True], TIERS, INCOMES)),
)
def test_one_join_equals_the_chain(data, rows, forbidden, attributes, tiers, income):
    chain = data["base"]
    if forbidden:
        chain = without_forbidden(chain, data["forbidden"])
    if attributes:
        chain = L.with_attributes(chain, data["customers"], ["prototype"])
    for tier in tiers:
        chain = L.in_tier(chain, data[tier], tier)
    if income:
        chain = L.with_income(chain, data["income"], income)

    arguments = {
        "forbidden": data["forbidden"] if forbidden else None,
        "attributes": (
            L.attributes_by_customer(data["customers"], ["prototype"]) if attributes else None
        ),
        "tiers": {tier: data[tier] for tier in tiers},
        "income": data["income"] if income else None,
    }
    if income:
        arguments["income_values"] = income
    joined = L.with_lookups(data["base"], **arguments)
    assert set(joined.columns) == set(chain.columns)
    assert rows(joined, *chain.columns) == rows(chain)


def test_enrichment_drops_unknown_customers_and_adds_no_rows(data, rows):
    got = L.with_attributes(data["base"], data["customers"], ["prototype"])
    expected = [(k, n, f"p{k}") for k in range(1, 11) for n in range(3 if k == 5 else 1)]
    assert rows(got) == sorted(expected, key=lambda r: [(False, str(v)) for v in r])


def test_tier_flag_keeps_everybody(data, rows):
    flags = dict(rows(L.flag_tier(data["base"].select(K).distinct(), data["tier_b"], "b")))
    assert flags == {k: int(k in (3, 5, 7)) for k in [None, *range(1, 13)]}


def test_attributes_take_one_whole_row(spark, rows):
    df = spark.createDataFrame(
        [(1, "a", 9), (1, "b", 1), (2, None, 5), (2, None, None)], f"{K} bigint, x string, y int"
    )
    assert rows(L.attributes_by_customer(df, ["x", "y"])) == [(1, "b", 1), (2, None, 5)]


def test_income_takes_the_latest_month_then_the_greatest_value(spark, rows):
    income = spark.createDataFrame(
        [
            (1, "mass_market", APRIL),
            (1, "high_income", MAY),
            (2, "mass_market", APRIL),
            (2, "super_core", APRIL),
            (3, "super_core", PAST),
        ],
        f"{K} bigint, income_segments string, income_month date",
    )
    days = spark.createDataFrame([(dt.date(2026, 3, 7),), (APRIL,)], "date date")
    recent = L.recent_income(income, days)
    assert rows(L.income_by_customer(recent)) == [(1, "high_income"), (2, "super_core")]


def test_months_before_the_newest_day_are_stale(spark, rows):
    income = spark.createDataFrame([(1, "x", APRIL)], f"{K} bigint, i string, income_month date")
    days = spark.createDataFrame([(dt.date(2026, 4, 2),)], "date date")
    assert rows(L.recent_income(income, days)) == []


def test_recency_needs_a_date(spark):
    with pytest.raises(ValueError, match="date"):
        L.latest_date(spark.createDataFrame([(1,)], "a int"))


@pytest.mark.parametrize("values", [(), ("mass_market", "rich"), ("rich",)])
def test_unknown_income_values_are_refused(values):
    with pytest.raises(ValueError):
        L.income_choice(values)
