"""Saves take effect in one step or not at all."""

from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from basewright.plans.build import enriched_base
from basewright.plans.templates import ELIGIBILITY_EXACT
from basewright.sinks import tables as sinks
from basewright.sinks import versions
from basewright.sinks.tables import save_split, save_table
from basewright.sources.fixtures import fixture_tables

COLUMNS = ELIGIBILITY_EXACT.columns


@pytest.fixture(scope="module")
def base(spark):
    return enriched_base(fixture_tables(spark, "/root/testdata/sf0.01"), ELIGIBILITY_EXACT)


def breaking(df, after=50):
    """`df` with rows that cannot be computed, so that a write fails half-way."""
    return df.withColumn("customer__id", F.when(F.rand(1) < 0.5, F.col("customer__id")).otherwise(F.raise_error(F.lit("lost"))))


def folders(path):
    return sorted(p.name for p in Path(path).iterdir())


def test_a_failed_save_leaves_the_old_table(spark, tmp_path):
    save_table(spark.range(5), "kept", str(tmp_path))
    bad = spark.range(100).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).cast("long").alias("id"))
    with pytest.raises(PySparkException):
        save_table(bad, "kept", str(tmp_path))
    assert spark.table("kept").count() == 5


def test_a_save_that_dies_before_the_switch_leaves_the_old_table(spark, tmp_path, monkeypatch):
    save_table(spark.range(5), "cut_off", str(tmp_path))

    def die(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(sinks, "switch", die)
    with pytest.raises(KeyboardInterrupt):
        save_table(spark.range(9), "cut_off", str(tmp_path))
    assert spark.table("cut_off").count() == 5
    monkeypatch.undo()
    assert save_table(spark.range(9), "cut_off", str(tmp_path)).count() == 9


def test_a_base_can_read_the_table_it_replaces(spark, rows, tmp_path):
    save_table(spark.range(3), "grows", str(tmp_path))
    for _ in range(3):
        save_table(spark.table("grows").union(spark.range(100, 101)), "grows", str(tmp_path))
    assert rows(spark.table("grows")) == [(0,), (1,), (100,), (100,), (100,), (2,)]


def test_one_earlier_version_is_kept_for_readers(spark, tmp_path):
    reader = save_table(spark.range(4), "versioned", str(tmp_path))
    save_table(spark.range(5), "versioned", str(tmp_path))
    assert reader.count() == 4 and len(folders(tmp_path)) == 2
    for n in (6, 7):
        save_table(spark.range(n), "versioned", str(tmp_path))
    assert len(folders(tmp_path)) == 2 and spark.table("versioned").count() == 7
    assert versions.versions_of(spark, "versioned")[0].rsplit("/", 1)[1] in folders(tmp_path)


def test_columns_can_change_and_rows_can_be_none(spark, tmp_path):
    save_table(spark.range(4), "changing", str(tmp_path))
    got = save_table(spark.range(2).select(F.lit("x").alias("it's"), F.col("id").alias("`n`")), "changing", str(tmp_path))
    assert got.columns == ["it's", "`n`"] and got.count() == 2
    got = save_table(spark.range(2).where("id > 5"), "changing", str(tmp_path))
    assert got.columns == ["id"] and got.count() == 0


def test_a_plain_table_of_that_name_is_replaced(spark, tmp_path):
    spark.range(3).write.saveAsTable("was_plain")
    assert save_table(spark.range(8), "was_plain", str(tmp_path)).count() == 8
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("was_plain")] == ["was_plain"]


def split_rows(spark, rows, name):
    return {t: rows(spark.table(f"{name}_{t}")) for t in ("cc_only", "ll_only", "multi_debt")}


def test_a_failed_split_leaves_every_table_of_the_old_one(spark, base, rows, tmp_path, monkeypatch):
    save_split(base, "halved", "segment", COLUMNS, folder=str(tmp_path))
    before = split_rows(spark, rows, "halved")
    assert all(before.values())
    with pytest.raises(PySparkException):
        save_split(breaking(base), "halved", "segment", COLUMNS, folder=str(tmp_path))
    assert split_rows(spark, rows, "halved") == before

    made = []

    def dies_after_two(*given):
        made.append(given)
        if len(made) > 2:
            raise KeyboardInterrupt
        return versions.replace_view(*given)

    monkeypatch.setattr(sinks, "replace_view", dies_after_two)
    monkeypatch.setattr(sinks, "checked_version", dies_after_two)
    made.extend([None, None])
    with pytest.raises(KeyboardInterrupt):
        save_split(base.limit(9), "halved", "segment", COLUMNS, folder=str(tmp_path))
    assert split_rows(spark, rows, "halved") == before


def test_all_tables_of_a_split_change_together(spark, base, rows, tmp_path, monkeypatch):
    save_split(base, "together", "segment", COLUMNS, folder=str(tmp_path))
    seen = []
    real = versions.replace_view

    def watch(session, name, *rest):
        real(session, name, *rest)
        seen.append((name, {t: spark.table(f"together_{t}").count() for t in ("cc_only", "ll_only", "multi_debt")}))

    monkeypatch.setattr(versions, "replace_view", watch)
    monkeypatch.setattr(sinks, "replace_view", watch)
    save_split(base, "together", "segment", COLUMNS, row_cap=3, order_by=["customer__id"], folder=str(tmp_path))
    # One call to the catalog, and after it every table is the new one.
    assert seen == [("together_rows", {"cc_only": 3, "ll_only": 3, "multi_debt": 3})]


def test_a_split_reads_one_partition_for_each_table(spark, base, tmp_path):
    saved = save_split(base, "pruned", "segment", COLUMNS, folder=str(tmp_path))
    plan = saved["pruned_multi_debt"]._jdf.queryExecution().executedPlan().toString()
    assert "split_segment" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_cap_of_one_combination_alone(base, tmp_path):
    saved = save_split(base, "one_cap", "segment", COLUMNS, caps={"multi_debt": 2}, folder=str(tmp_path))
    counts = {r["segment"]: r["count"] for r in base.groupBy("segment").count().collect()}
    assert saved["one_cap_multi_debt"].count() == 2 < counts["multi_debt"]
    assert saved["one_cap_cc_only"].count() == counts["cc_only"]


def test_split_with_other_columns(spark, base, tmp_path):
    save_split(base, "wider", "segment", ["customer__id"], folder=str(tmp_path))
    saved = save_split(base, "wider", "segment", COLUMNS, folder=str(tmp_path))
    assert saved["wider_cc_only"].columns == list(COLUMNS) and saved["wider_cc_only"].count() > 0
