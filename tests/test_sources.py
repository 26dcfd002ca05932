import datetime as dt

import pytest

from pyspark.sql import functions as F

from basewright import Tables
from basewright.functions.columns import lateness, product_segment
from basewright.operators.grouping import one_row_per
from basewright.sources import fixtures
from basewright.sources.collections import advanced, collections_source, latest_state
from basewright.sources.naming import renamed

D1, D2 = dt.date(2026, 3, 1), dt.date(2026, 3, 2)


@pytest.fixture
def tables(spark):
    cc = spark.createDataFrame(
        [(1, 10, D1, 5, 100), (1, 10, D2, 6, 100), (2, 20, D1, None, 200)],
        "collection__id long, customer__id long, date date, product__days_late int, account__id long",
    )
    ll = spark.createDataFrame(
        [(3, 10, D1, 70, 300)],
        "collection__id long, customer__id long, date date, product__days_late int, loan__id long",
    )
    return Tables({"collections_cc": lambda: cc, "collections_ll": lambda: ll})


def test_one_product_has_only_its_own_flag(tables):
    cc = collections_source(tables, credit_card=True)
    assert cc.columns[-1] == "is_cc" and "is_ll" not in cc.columns and cc.count() == 3
    ll = collections_source(tables, lending=True)
    assert ll.columns[-1] == "is_ll" and "is_cc" not in ll.columns and ll.count() == 1


@pytest.mark.parametrize("flags", [{}, {"credit_card": True, "lending": True}])
def test_both_or_neither_is_the_union(tables, rows, flags):
    union = collections_source(tables, **flags)
    got = rows(union, "collection__id", "account__id", "loan__id", "is_cc", "is_ll")
    assert got == [
        (1, 100, None, 1, 0),
        (1, 100, None, 1, 0),
        (2, 200, None, 1, 0),
        (3, None, 300, 0, 1),
    ]


def test_current_is_derived_or_read(tables, spark, rows):
    derived = collections_source(tables, credit_card=True, current=True)
    assert rows(derived, "collection__id", "date") == [(1, D2), (2, D1)]
    ready = spark.createDataFrame([(9,)], "collection__id long")
    stored = Tables({"collections_cc_current": lambda: ready})
    assert rows(collections_source(stored, credit_card=True, current=True)) == [(9, 1)]


def test_latest_state_needs_a_date(spark):
    with pytest.raises(ValueError, match="date"):
        latest_state(spark.createDataFrame([(1,)], "collection__id int"))


def test_renaming(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert renamed(df, {"a": "x"}).columns == ["x", "b"]
    with pytest.raises(ValueError, match="zz"):
        renamed(df, {"zz": "x"})


def test_ties_of_the_newest_day_do_not_depend_on_the_rows_order(spark, rows):
    data = [(1, D2, 5, "a"), (1, D2, 5, "b"), (1, D2, None, "z"), (1, D1, 9, "y"), (2, D1, 1, "x")]
    schema = "collection__id int, date date, late int, x string"
    for some in (data, data[::-1]):
        df = spark.createDataFrame(some, schema)
        newest = rows(latest_state(df, ties=["late", "x"]))
        assert newest == [(1, D2, 5, "b"), (2, D1, 1, "x")]
        stored = latest_state(df.where(df.date == D1))
        assert rows(advanced(stored, df.where(df.date == D2), ties=["late", "x"])) == newest


def test_column_names_are_mapped_at_load(spark):
    lake = Tables({"t": lambda: spark.createDataFrame([(1, 2)], "a int, b int"), "u": lambda: spark.range(1)})
    named = lake.with_column_names({"t": {"a": "customer__id"}})
    assert named["t"].columns == ["customer__id", "b"] and named["u"].columns == ["id"]
    with pytest.raises(ValueError, match="zz"):
        lake.with_column_names({"t": {"zz": "x"}})["t"]
    with pytest.raises(ValueError, match="other"):
        lake.with_column_names({"other": {}})


def test_unknown_table(tables):
    with pytest.raises(KeyError, match="customers"):
        tables["customers"]


def test_saved_tables_can_be_read_by_name_or_path(spark, tmp_path):
    df = spark.range(3)
    df.write.parquet(str(tmp_path / "t"))
    df.createOrReplaceTempView("some_view")
    assert Tables.from_parquet(spark, {"t": str(tmp_path / "t")})["t"].count() == 3
    assert Tables.from_catalog(spark, {"t": "some_view"})["t"].count() == 3


def test_unknown_days_late_count_as_short(spark, rows):
    df = spark.createDataFrame([(64,), (65,), (None,)], "product__days_late int")
    got = rows(df.select("product__days_late", lateness(65)))
    assert got == [(64, "short"), (65, "long"), (None, "short")]


def test_segments(spark, rows):
    df = spark.createDataFrame(
        [(1, 1), (1, 0), (0, 1), (0, 0), (None, 1)], "is_cc int, is_ll int"
    )
    got = {r[:2]: r[2] for r in rows(df.withColumn("s", product_segment()))}
    assert got == {
        (1, 1): "multi_debt",
        (1, 0): "cc_only",
        (0, 1): "ll_only",
        (0, 0): "error",
        (None, 1): "error",
    }


def test_grouping(tables, rows):
    union = collections_source(tables)
    grouped = one_row_per(union, ["customer__id"], ["is_cc", "is_ll", "product__days_late"])
    assert rows(grouped) == [(10, 1, 1, 70), (20, 1, 0, None)]
    assert rows(one_row_per(union, ["customer__id"])) == [(10,), (20,)]
    with pytest.raises(ValueError):
        one_row_per(union, [])


def test_tasks_of_the_daily_view_follow_the_lines(spark, monkeypatch):
    """The fewer lines a task is given, the more tasks there are, however well a shuffle packs."""
    monkeypatch.setattr(fixtures, "LINES_PER_TASK", 10_000)
    lines = spark.range(300_000).selectExpr("id DIV 5 AS l_orderkey", "CAST(id % 5 AS INT) AS l_linenumber")
    orders = spark.range(60_000).selectExpr("id AS o_orderkey", "id % 100 AS o_custkey", "'F' AS o_orderstatus", "TIMESTAMP_NTZ '2026-01-01 00:00:00' AS o_orderdate")
    daily = fixtures.collections_daily(lines, orders)
    for df in (daily, latest_state(daily)):
        held = df.groupBy(F.spark_partition_id().alias("p")).count()
        assert held.count() == 30 and held.agg(F.max("count")).first()[0] <= 12_000
    assert daily.count() == 300_000 and latest_state(daily).count() == 60_000
