"""Stored partial results: the same rows as grouping everything, one day's work for a day."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from basewright.operators.grouping import one_row_per
from basewright.operators.partials import Partials
from basewright.plans.build import base_for, filtered_rows, partials_of
from basewright.plans.templates import ELIGIBILITY_EXACT, ELIGIBILITY_SUBSTRING, HOMEPAGE
from basewright.sources.fixtures import fixture_tables
from basewright.sources.tables import Tables

SCHEMA = "customer__id bigint, prototype string, is_cc int, late int, date string"
KEYS, MEASURES = ["customer__id", "prototype"], ["is_cc", "late"]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("date", F.to_date("date"))


def day(pick, date, n=60):
    return [(pick.choice([None, 1, 2, 3, 7]), pick.choice([None, "a", "b"]), pick.randrange(2), pick.choice([None, 1, 90]), date) for _ in range(n)]


def test_total_equals_grouping_all_days(spark, rows, tmp_path):
    pick = random.Random(4)
    history = {d: day(pick, d) for d in ("2026-01-30", "2026-01-31", "2026-02-01", "2026-02-28", "2026-03-01")}
    store = Partials(spark, str(tmp_path), KEYS, MEASURES, frame(spark, []))

    def same():
        whole = frame(spark, sum(history.values(), []))
        assert rows(store.total()) == rows(one_row_per(whole, KEYS, MEASURES))

    assert store.total().count() == 0
    for d in ("2026-01-30", "2026-01-31"):
        store.add(frame(spark, history[d]))
    store.add(frame(spark, history["2026-02-01"] + history["2026-02-28"]))
    store.add(frame(spark, history["2026-03-01"]))
    same()
    store.roll_up(["2026-01", "2026-02"])
    same()
    assert store.months().select("month").distinct().count() == 2
    history["2026-01-31"] = day(pick, "2026-01-31", 9)  # corrected, in a month that is rolled up
    store.add(frame(spark, history["2026-01-31"]))
    same()
    history["2026-02-15"] = day(pick, "2026-02-15")  # late
    store.add(frame(spark, history["2026-02-15"]))
    same()
    store.add(frame(spark, history["2026-03-01"]))  # again
    same()


def test_rolled_up_months_are_read_instead_of_their_days(spark, tmp_path):
    pick = random.Random(5)
    store = Partials(spark, str(tmp_path), KEYS, MEASURES, frame(spark, []))
    store.add(frame(spark, sum((day(pick, f"2026-01-{d:02}") for d in range(1, 21)), []) + day(pick, "2026-02-01")))
    assert sum("/day/" in f for f in store.total().inputFiles()) > 0
    store.roll_up(["2026-01"])
    text = store.total()._jdf.queryExecution().executedPlan().toString()
    assert "date_format(cast(date" in text.split("PartitionFilters")[2]
    read = store.total().select(F.input_file_name()).distinct()
    assert store.total().count() > 0 and read is not None


def test_only_the_days_given_are_grouped(spark, tmp_path):
    pick = random.Random(6)
    store = Partials(spark, str(tmp_path), KEYS, MEASURES, frame(spark, []))
    store.add(frame(spark, day(pick, "2026-01-01") + day(pick, "2026-01-02")))
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("date=2026-01-01/*.parquet")}
    store.add(frame(spark, day(pick, "2026-01-03")))
    assert {p: p.stat().st_mtime_ns for p in tmp_path.rglob("date=2026-01-01/*.parquet")} == before


@pytest.mark.parametrize("keys,measures", [([], ["late"]), (["date"], []), (["prototype"], ["date"])])
def test_senseless_stores_are_refused(spark, tmp_path, keys, measures):
    with pytest.raises(ValueError):
        Partials(spark, str(tmp_path), keys, measures, frame(spark, []))


def test_keys_alone(spark, rows, tmp_path):
    store = Partials(spark, str(tmp_path), ["customer__id"], [], frame(spark, []))
    data = frame(spark, day(random.Random(1), "2026-01-01"))
    store.add(data)
    assert rows(store.total()) == rows(data.select("customer__id").distinct())


def test_a_base_from_partials(spark, rows, tmp_path):
    tables = fixture_tables(spark, "/root/testdata/sf0.001")
    spec = replace(ELIGIBILITY_SUBSTRING, row_cap=None)
    store = partials_of(tables, spec, str(tmp_path))
    for where in ("date < '2026-03-05'", "date >= '2026-03-05'"):
        days = Tables({name: lambda n=name, w=where: tables[n].where(w) if n.startswith("collections") else tables[n] for name in tables})
        store.add(filtered_rows(days, spec))
    whole = rows(base_for(tables, spec))
    assert whole and rows(base_for(tables, spec, partials=store)) == whole
    for refused in (HOMEPAGE, ELIGIBILITY_EXACT):
        with pytest.raises(ValueError):
            partials_of(tables, refused, str(tmp_path))
