import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from basewright.operators.caps import (
    _first_in_slices,
    any_rows,
    cap_per_combo,
    combo_key,
    first_rows,
)

SCHEMA = "customer__id bigint, segment string, lateness string"


def sample(n=4000, hot=1 / 3, seed=3):
    """Rows of which a third are one customer in one combination."""
    pick = random.Random(seed)
    combos = [(s, l) for s in ("cc_only", "ll_only", "multi_debt") for l in ("short", "long")]
    return [
        (7, "cc_only", "long") if pick.random() < hot else (pick.randrange(900), *pick.choice(combos))
        for _ in range(n)
    ]


def expected(data, cap_of):
    groups = defaultdict(list)
    for row in data:
        groups[row[1:]].append(row)
    kept = []
    for combo, members in groups.items():
        kept += sorted(members)[: cap_of("_".join(combo))]
    return Counter(kept)


@pytest.mark.parametrize("slices,partitions", [((1,), 1), ((7,), 9), ((64, 8), 1), ((1024, 32), 9)])
def test_caps_per_combination_match_brute_force(spark, slices, partitions):
    data = sample()
    caps = {"cc_only_long": 900, "multi_debt_short": 3, "ll_only_long": 100_000}
    df = spark.createDataFrame(data, SCHEMA).repartition(partitions)
    got = cap_per_combo(df, 50, caps, order_by=["customer__id"], slices=slices)
    assert Counter(tuple(r) for r in got.collect()) == expected(data, lambda c: caps.get(c, 50))
    assert got.columns == df.columns


def test_small_caps_match_brute_force_and_are_cut_before_the_shuffle(spark):
    data = sample()
    df = spark.createDataFrame(data, SCHEMA).repartition(9)
    got = cap_per_combo(df, 50, {"cc_only_long": 70}, order_by=["customer__id"])
    wanted = expected(data, lambda combo: 70 if combo == "cc_only_long" else 50)
    assert Counter(tuple(r) for r in got.collect()) == wanted
    text = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    first = text.rsplit("Exchange hashpartitioning(_slice", 1)[1]
    assert "row_number(), 70, Partial" in first


@pytest.mark.parametrize("partitions", [10, 100])
def test_last_ranking_sees_a_bounded_number_of_rows(spark, partitions):
    data = [(i, "cc_only", "long") for i in range(20_000)]
    df = spark.createDataFrame(data, SCHEMA).repartition(partitions)
    rows = _first_in_slices(df, F.lit(5), 5, ("segment",), ("customer__id",), (1024, 32))
    assert 0 < rows.count() <= 32 * 5


@pytest.mark.parametrize("cap", [3, 1000, 1001, 1500])
def test_first_rows_match_brute_force(spark, cap):
    data = sample()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = first_rows(df, cap, ["customer__id"])
    assert Counter(tuple(r) for r in got.collect()) == Counter(sorted(data)[:cap])


def test_caps_larger_than_the_data_keep_everything(spark):
    data = sample(200)
    df = spark.createDataFrame(data, SCHEMA)
    assert first_rows(df, 10_000, ["customer__id"]).count() == 200
    assert cap_per_combo(df, 10_000).count() == 200
    assert any_rows(df, 10_000).count() == 200


def test_any_rows_keeps_at_most_the_cap_and_only_existing_rows(spark):
    data = sample(500)
    got = Counter(tuple(r) for r in any_rows(spark.createDataFrame(data, SCHEMA), 60).collect())
    assert sum(got.values()) == 60
    assert not got - Counter(data)


@pytest.mark.parametrize("cap", [0, -1, None, 2.5, True])
def test_senseless_caps_are_refused(spark, cap):
    df = spark.createDataFrame(sample(5), SCHEMA)
    for make in (
        lambda: any_rows(df, cap),
        lambda: first_rows(df, cap, ["customer__id"]),
        lambda: cap_per_combo(df, cap),
        lambda: cap_per_combo(df, 5, {"cc_only_long": cap}),
    ):
        with pytest.raises(ValueError):
            make()


def test_combo_keys():
    assert combo_key("multi_debt", "long") == "multi_debt_long"
    assert combo_key(None, "long") == "long"
    assert combo_key("base", "cc_only") == "base_cc_only"
