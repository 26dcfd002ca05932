"""Plans that have to hold at scale: pushed filters, pruned columns, few and splittable shuffles."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from basewright.operators import lookups as L
from basewright.operators.tags import without_forbidden
from basewright.plans.build import base_for, enriched_base, lookups
from basewright.plans.spec import BaseSpec
from basewright.plans.templates import ELIGIBILITY_EXACT, HOMEPAGE, PDP
from basewright.queries.registry import QUERIES
from basewright.sources.collections import latest_state
from basewright.sources.fixtures import fixture_tables
from basewright.sources.tables import Tables

SF_DIR = "/root/testdata/sf0.001"
WRITING = {
    name for name in QUERIES if name.startswith(("split_", "save_")) or name.endswith("_roundtrip")
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plan_after_run(df):
    """The final adaptive plan."""
    executed = df._jdf.queryExecution().executedPlan()
    executed.executeCollect()
    return executed.toString().split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The fixture views written as tables, collections partitioned by day."""
    root = tmp_path_factory.mktemp("stored")
    tables = fixture_tables(spark, SF_DIR)
    paths = {}
    for name in ("collections_cc", "collections_ll", "customers", "tags_daily", "income_segments"):
        paths[name] = f"{root}/{name}"
        writer = tables[name].write
        writer = writer.partitionBy("date") if "date" in tables[name].columns else writer
        writer.parquet(paths[name])
    return Tables.from_parquet(spark, paths)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITING))
def test_no_cross_join_no_python_no_collected_group(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "collect_"):
        assert operator not in text


def test_filters_and_columns_reach_the_scan(stored, conf):
    conf("spark.sql.maxMetadataStringLength", "10000")
    text = plan(enriched_base(stored, ELIGIBILITY_EXACT))
    scans = [line for line in text.splitlines() if "FileScan" in line and "collections_" in line]
    assert len(scans) == 2
    for scan in scans:
        assert "date#" in scan.split("PartitionFilters")[1].split("]")[0]
        for filter_ in ("EqualTo(customer__type,person)", "GreaterThanOrEqual", "LessThanOrEqual"):
            assert filter_ in scan
        schema = scan.split("ReadSchema: struct<")[1]
        assert "account__id" not in schema and "collection__status" not in schema


def test_grouped_base_is_shuffled_once(stored, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = plan(enriched_base(stored, ELIGIBILITY_EXACT))
    # base, attributes, forbidden customers: each once, on the customer, for group and join alike.
    assert text.count("Exchange hashpartitioning(customer__id") == 3
    assert text.count("Exchange") == 3


def test_ungrouped_base_is_shuffled_once(stored, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    spec = replace(
        HOMEPAGE,
        income=("mass_market", "super_core"),
        columns=("customer__id", "prototype", "income_segments"),
        row_cap=None,
    )
    text = plan(base_for(stored, spec, staged=False))
    # base; attributes, forbidden and income; and their combination for the join with the base.
    assert text.count("Exchange hashpartitioning(customer__id") == 5
    [first_join] = [l for l in text.splitlines() if "SortMergeJoin" in l and l.startswith("   +- ")]
    assert "Inner" in first_join
    of_base = [l for l in text.splitlines() if "FileScan" in l and "customer__type" in l]
    assert len(of_base) == 2


def test_no_date_scan_without_income(stored):
    assert "Subquery" not in plan(base_for(stored, HOMEPAGE))


def test_recency_reads_only_the_date_partitions(stored):
    text = plan(L.latest_date(stored["collections_cc"]))
    assert "ReadSchema: struct<>" in text


def test_latest_state_keeps_one_row_per_key_before_the_shuffle(stored):
    text = plan(latest_state(stored["collections_cc"]).select("collection__id", "collection__cured"))
    before, after = text.split("Exchange hashpartitioning(collection__id")
    assert "Final" in before.split("WindowGroupLimit")[1]
    assert "Partial" in after.split("WindowGroupLimit")[1]
    assert "account__id" not in after and "prototype" not in after


# --- a customer holding a third of all rows ---------------------------------------------


@pytest.fixture
def small_skew_limits(conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "100KB")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100KB")
    conf("spark.sql.shuffle.partitions", "16")


ROWS, KEYS, HOT = 300_000, 20_000, 7


@pytest.fixture
def hot(spark):
    ids = spark.range(0, ROWS, 1, 16)
    key = F.when(F.col("id") % 3 == 0, F.lit(HOT)).otherwise(F.col("id") % KEYS)
    return {
        "base": ids.select(key.cast("long").alias("customer__id"), F.xxhash64("id").alias("x")),
        "customers": spark.range(0, 2 * KEYS, 1, 4).select(
            (F.col("id") % KEYS).alias("customer__id"), F.lit("p").alias("prototype")
        ),
        "members": spark.range(0, KEYS, 1, 4).select(F.col("id").alias("customer__id")),
        "income": spark.range(0, KEYS, 1, 4).select(
            F.col("id").alias("customer__id"), F.lit("mass_market").alias("income_segments")
        ),
    }


def test_hot_customer_is_split_in_every_join(hot, small_skew_limits):
    base, members = hot["base"], hot["members"]
    odd = members.where("customer__id % 2 = 1 AND customer__id != 7").distinct()
    hot_included = members.where(f"customer__id % 2 = 1 OR customer__id = {HOT}")
    attributes = L.attributes_by_customer(hot["customers"], ["prototype"])
    income = hot["income"].distinct()
    joined = {
        "anti": without_forbidden(base, odd),
        "attributes": L.with_attributes(base, hot["customers"], ["prototype"]),
        "tier": L.in_tier(base, hot_included, "t"),
        "flag": L.flag_tier(base, hot_included, "t"),
        "income": L.with_income(base, income),
        "all": L.with_lookups(
            base,
            forbidden=odd,
            attributes=attributes,
            tiers={"t": members},
            income=income,
        ),
        "marks": L.with_lookups(base, forbidden=odd, income=income),
    }
    for name, df in joined.items():
        assert "SortMergeJoin(skew=true)" in plan_after_run(df), name
        assert df.where(f"customer__id = {HOT}").count() >= ROWS // 3, name


def test_hot_customer_is_reduced_before_the_shuffle(hot, stored):
    """A grouped base sends one row per key and map task, however hot the key."""
    text = plan(hot["base"].groupBy("customer__id").agg(F.max("x").alias("x")))
    assert "partial_max" in text.split("Exchange")[1]
    spec = BaseSpec(credit_card=True, group_by=("customer__id",), columns=("customer__id",))
    assert "Exchange hashpartitioning(customer__id" in plan(base_for(stored, spec))


def test_substring_rule_is_computed_once_for_both_products(stored, small_skew_limits):
    """The anti-join is pushed into both sides of the union; the flagged keys are reused."""
    text = plan_after_run(enriched_base(stored, PDP, staged=False))
    assert text.count("tags_daily") + text.count("Filter (exists(") == 2
    assert text.count("ReusedExchange") == 1


def test_a_base_without_grouping_is_staged_by_itself(stored):
    text = plan(base_for(stored, replace(PDP, row_cap=None)))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_newest_day_is_read_without_a_window(stored):
    spec = replace(HOMEPAGE, current=True, snapshot_date=None, income=("mass_market",), row_cap=None)
    text = plan(lookups(stored, spec)["income"])
    assert "row_number" not in text


def test_staged_lookup_decides_the_join_by_its_size(stored, conf):
    spec = replace(PDP, row_cap=None)
    small = plan(base_for(stored, spec, staged=True))
    assert "BroadcastHashJoin" in small and "Exchange hashpartitioning" not in small
    conf("spark.sql.autoBroadcastJoinThreshold", "100")
    large = plan(base_for(stored, spec, staged=True))
    assert "SortMergeJoin" in large and "Broadcast" not in large
    # Both inputs come straight from a shuffle, so a hot customer can be split.
    assert large.count("Exchange hashpartitioning(customer__id") == large.count("Sort [")
