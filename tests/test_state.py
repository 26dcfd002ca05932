"""The current state: definite among same-day rows, and merged with a day where it lies."""

import random
from dataclasses import replace

import pytest

from basewright.plans.build import base_for, source_rows, used_columns
from basewright.plans.spec import BaseSpec
from basewright.plans.templates import ELIGIBILITY_EXACT, HOMEPAGE
from basewright.sources.collections import advanced, collections_source, latest_state
from basewright.sources.state import merged_state, store_state
from basewright.sources.tables import Tables

SCHEMA = "collection__id bigint, date date, customer__id bigint, product__days_late int, collection__cured int, note string"


def days(pick, first, last, n=400):
    return [
        (pick.choice([None, *range(60)]), f"2026-03-{pick.randrange(first, last):02}", pick.randrange(9), pick.choice([None, 1, 7]), pick.randrange(2), pick.choice([None, "a", "b"]))
        for _ in range(n)
    ]


def frame(spark, rows, partitions=4):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame(rows, SCHEMA.replace("date date", "date string")).repartition(partitions).selectExpr(*(f"CAST(date AS date) date" if c == "date" else c for c in names))


TIES = ["collection__cured", "customer__id", "note", "product__days_late"]


@pytest.mark.parametrize("seed", [1, 2])
def test_merging_days_gives_the_latest_state_of_all(spark, rows, seed):
    pick = random.Random(seed)
    parts = [days(pick, 1, 5), days(pick, 4, 9), days(pick, 2, 12, 50), []]
    state = store_state(latest_state(frame(spark, parts[0]), ties=TIES), f"state_{seed}", 4)
    for part in parts[1:]:
        state = store_state(merged_state(state, frame(spark, part), 4, ties=TIES), f"state_{seed}", 4, dealt=True)
    whole = frame(spark, [r for p in parts for r in p])
    assert rows(state) == rows(latest_state(whole, ties=TIES).select(*state.columns))
    assert rows(advanced(latest_state(frame(spark, parts[0]), ties=TIES), frame(spark, sum(parts[1:], [])), ties=TIES)) == rows(state)


def test_the_state_is_not_shuffled(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.shuffle.partitions", "16")
    pick = random.Random(3)
    state = store_state(latest_state(frame(spark, days(pick, 1, 9)), ties=TIES), "state_in_place", 4)
    merged = merged_state(state, frame(spark, days(pick, 9, 10)).where("collection__id is not null"), 4, ties=TIES)
    text = merged._jdf.queryExecution().executedPlan().toString()
    [join] = [i for i, line in enumerate(text.splitlines()) if "SortMergeJoin" in line]
    left, right = _children(text.splitlines()[join:])
    assert "Bucketed: true" in left and "Exchange" not in left
    assert "Exchange" in right


def _children(lines):
    """The two subtrees below the first line."""
    depth = lines[0].index("SortMergeJoin")
    second = next(i for i, line in enumerate(lines[1:], 1) if line[depth:].startswith("+- "))
    return "\n".join(lines[1:second]), "\n".join(lines[second : second + 12])


def test_other_columns_are_refused(spark):
    state = frame(spark, days(random.Random(1), 1, 3))
    with pytest.raises(ValueError):
        merged_state(state, state.drop("note"), 4)


def test_earlier_states_are_dropped(spark):
    for n in range(4):
        store_state(frame(spark, days(random.Random(n), 1, 9, 20)), "state_versions", 2)
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith("state_versions_")]
    assert len(names) == 2


def test_same_day_rows_are_decided_alike_however_they_lie(spark, rows):
    """Through base_for: the greatest of the rows of the newest day, at any spread of the input."""
    pick = random.Random(7)
    data = days(pick, 1, 4, 600)
    spec = BaseSpec(credit_card=True, current=True, lateness_cutoff=5, columns=("customer__id", "lateness", "product__days_late"))
    got = []
    for partitions in (1, 3, 11):
        pick.shuffle(data)
        got.append(rows(base_for(Tables({"collections_cc": lambda p=partitions: frame(spark, data, p)}), spec)))
    assert got[0] == got[1] == got[2]
    newest = {}
    for r in data:
        rank = (r[1], r[2] is not None, r[2] or 0, r[3] is not None, r[3] or 0)
        newest[r[0]] = max(newest.get(r[0], (rank, r)), (rank, r), key=lambda x: x[0])
    wanted = [(r[2], "long" if (r[3] or 0) >= 5 else "short", r[3]) for _, r in newest.values()]
    assert sorted(got[0], key=str) == sorted(wanted, key=str)


def test_ties_read_no_more_than_a_base_uses(spark):
    assert used_columns(HOMEPAGE) == ["customer__id", "customer__type"]
    assert "product__days_late" in used_columns(ELIGIBILITY_EXACT) and "prototype" not in used_columns(ELIGIBILITY_EXACT)
    tables = Tables({"collections_cc": lambda: frame(spark, [])})
    spec = BaseSpec(credit_card=True, current=True, cured_only=True, columns=("customer__id",))
    text = source_rows(tables, spec).select("customer__id")._jdf.queryExecution().optimizedPlan().toString()
    assert "note" not in text.split("Window")[1].split("\n")[0]
    whole = collections_source(tables, credit_card=True, current=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "note" in whole.split("Window")[1].split("\n")[0]
    assert base_for(tables, replace(spec, cured_only=False)).count() == 0
