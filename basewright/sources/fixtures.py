"""The collections data model as views over the given TPC-H-ish tables.

`FIXTURES.md` describes the views. Nothing is stored: every view is a lazy
DataFrame, so the work of a query grows with the tables below it. Only the lines
are counted beforehand, from the footers of their files.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import EXACT_TAGS, TAG_NEEDLES, TIERS
from .collections import latest_state
from .tables import Tables

# The columns the views use; stating them saves reading a footer per table to learn them.
SCHEMAS = {
    "lineitem": "l_orderkey BIGINT, l_linenumber INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, "
    "o_orderdate TIMESTAMP_NTZ",
    "customer": "c_custkey BIGINT, c_mktsegment STRING",
}
TIER_DIVISORS = dict(zip(TIERS, (7, 11, 13, 17)))
#: Lines that one task deduplicates and joins.
LINES_PER_TASK = 150_000


def collections_daily(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    # lineitem repeats (order, line) pairs; all other columns follow from the pair
    # and from orders' primary key, so the two slim columns are deduplicated first.
    # Two such columns pack so well that tasks made by the size of a shuffle hold millions of
    # rows. So their number follows the lines; one shuffle by order serves all steps up to the latest state.
    tasks = max(1, -(-lineitem.count() // LINES_PER_TASK))
    days = lineitem.select("l_orderkey", "l_linenumber").repartition(tasks, "l_orderkey").distinct()
    return days.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "o_orderkey AS collection__id",
        "CASE WHEN o_orderkey % 101 <> 0 THEN o_custkey END AS customer__id",
        "CASE WHEN o_custkey % 10 < 8 THEN 'person' ELSE 'company' END AS customer__type",
        """CASE WHEN l_orderkey % 97 <> 0 THEN CAST((l_orderkey * 7 + l_linenumber) % 400 AS INT)
           END AS product__days_late""",
        "o_orderstatus AS collection__status",
        "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS collection__cured",
        "CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS collection__end",
        "concat('proto_', CAST((o_custkey + o_orderkey % 2) % 5 AS STRING)) AS prototype",
        "date_add(DATE '2026-02-28', l_linenumber) AS date",
        # On the order's own columns, so that a product filter reaches the scan of orders.
        """CASE WHEN o_custkey % 3 = 0 OR (o_custkey % 3 = 2 AND o_orderkey % 2 = 0)
           THEN 'cc' ELSE 'll' END AS product""",
    )


def _listed(values: tuple[str, ...]) -> str:
    """One of the values, in turn by customer, so that every entry of a list occurs."""
    quoted = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({quoted}), CAST(floor(c_custkey / 20) % {len(values)} AS INT) + 1)"


def customers(customer: DataFrame) -> DataFrame:
    """One or two contracts per customer, with prototypes of their own."""
    contracts = "explode(CASE WHEN c_custkey % 4 = 0 THEN array(0, 1) ELSE array(0) END)"
    return (
        customer.where("c_custkey % 50 <> 49")
        .selectExpr("c_custkey", f"{contracts} AS contract")
        .selectExpr(
            "c_custkey AS customer__id",
            "concat('proto_', CAST((c_custkey + contract) % 5 AS STRING)) AS prototype",
            f"""CASE c_custkey % 20
               WHEN 0 THEN array('fraud_id', 'x') WHEN 1 THEN array('Beta')
               WHEN 2 THEN array('suspected') WHEN 3 THEN NULL WHEN 4 THEN array('AML')
               WHEN 5 THEN array('Customer_group_owner') WHEN 6 THEN array(NULL, 'ok')
               WHEN 7 THEN array({_listed(EXACT_TAGS)})
               WHEN 8 THEN array(concat('x ', {_listed(TAG_NEEDLES)}, ' y'))
               ELSE array('ok') END AS customer__tags""",
        )
    )


def tags_daily(customers: DataFrame) -> DataFrame:
    """Tags seen on the first day only: 'ever tagged' must still catch them."""
    return customers.selectExpr("*", "explode(array(1, 2)) AS k").selectExpr(
        "customer__id",
        "CASE WHEN k = 1 THEN customer__tags ELSE array('ok') END AS customer__tags",
        "date_add(DATE '2026-02-28', k) AS date",
    )


def tier(orders: DataFrame, divisor: int) -> DataFrame:
    return orders.where(f"o_custkey % {divisor} = 0").selectExpr("o_custkey AS customer__id")


def income_segments(customer: DataFrame) -> DataFrame:
    estimated = customer.selectExpr(
        "c_custkey AS customer__id",
        """CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'mass_market'
           WHEN c_mktsegment = 'HOUSEHOLD' THEN 'high_income' ELSE 'super_core'
           END AS income_segments""",
        """CASE WHEN c_custkey % 6 = 0 THEN DATE '2026-02-01' ELSE DATE '2026-04-01'
           END AS income_month""",
    )
    conflicting = customer.where("c_custkey % 9 = 0").selectExpr(
        "c_custkey AS customer__id",
        "'super_core' AS income_segments",
        "DATE '2026-05-01' AS income_month",
    )
    return estimated.unionByName(conflicting)


def fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All fixture views over the parquet tables in `sf_dir`."""

    @cache
    def raw(name: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

    @cache
    def daily() -> DataFrame:
        return collections_daily(raw("lineitem"), raw("orders"))

    def of_product(product: str) -> DataFrame:
        return daily().where(F.col("product") == product)

    openers: dict[str, Callable[[], DataFrame]] = {
        "collections_daily": daily,
        "collections_cc": lambda: of_product("cc").selectExpr(
            "*", "customer__id * 10 AS account__id"
        ),
        "collections_ll": lambda: of_product("ll").selectExpr(
            "*", "collection__id * 10 AS loan__id"
        ),
        "collections_current": lambda: latest_state(daily()),
        "customers": lambda: customers(raw("customer")),
        "tags_daily": lambda: tags_daily(customers(raw("customer"))),
        "income_segments": lambda: income_segments(raw("customer")),
    }
    for name, divisor in TIER_DIVISORS.items():
        openers[f"tier_{name}"] = lambda d=divisor: tier(raw("orders"), d)
    return Tables(openers)
