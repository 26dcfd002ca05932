"""Large caps: the same rows as brute force, with only the last buckets shuffled."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basewright.operators import cutoffs as cut
from basewright.operators.caps import any_rows, cap_per_combo, first_rows
from basewright.sinks.shared import written

SCHEMA = "k string, a int, b string, c double"


def sample(n, seed=1, values=None):
    """Rows with nulls everywhere; a third of them equal in every column."""
    pick = random.Random(seed)
    one = ("hot", 5, "same", 0.5)
    keys = ["hot", "x", None, ""]
    return [
        one
        if pick.random() < 1 / 3
        else (pick.choice(keys), pick.choice([None, pick.randrange(values or 10**6)]), pick.choice("pqr"), pick.choice([None, -0.0, 0.0, float("inf"), 1.5]))
        for _ in range(n)
    ]


def sort_key(row):
    return [(v is not None, v if v is not None else 0) for v in row]


def first_of(data, by, order, cap_of):
    groups = defaultdict(list)
    for row in data:
        groups[tuple(row[i] for i in by)].append(row)
    kept = Counter()
    for key, members in groups.items():
        members.sort(key=lambda r: sort_key([r[i] for i in order]))
        kept.update(members[: cap_of(key)])
    return kept


def collected(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("values", [3, 10**6])
def test_large_caps_match_brute_force(spark, values):
    data = sample(30_000, values=values)
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    caps = {"hot": 4000, "x": 10**6, "nobody": 9}
    got = cap_per_combo(df, 1200, caps, by=["k"], order_by=["a"])
    assert collected(got) == first_of(data, [0], [1, 2, 3], lambda k: caps.get(k[0] or "", 1200))


@pytest.mark.parametrize("cap", [1001, 5000, 29_999, 30_000, 90_000])
def test_large_first_rows_match_brute_force(spark, cap):
    data = sample(30_000, seed=2)
    got = first_rows(spark.createDataFrame(data, SCHEMA).repartition(5), cap, ["b", "a"])
    assert collected(got) == first_of(data, [], [2, 1, 0, 3], lambda _: cap)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert first_rows(none, 5000, ["a"]).count() == 0
    assert cap_per_combo(none, 5000, by=["k"], order_by=["a"]).count() == 0
    assert any_rows(none, 5000).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([None, "a", "b"]), st.integers(-3, 3) | st.none()), max_size=60), st.integers(1, 30))
def test_cuts_hold_the_cap_between_their_bounds(spark, data, cap):
    df = spark.createDataFrame([(k, a, i % 2) for i, (k, a) in enumerate(data)], "k string, a int, i int")
    stored = written(df)
    found = cut.cutoffs(stored, ["k"], ["a", "i"], F.lit(cap), enough=0)
    place = lambda r: sort_key([r["a"], r["i"]])
    for c in found.collect():
        rows = [r for r in df.collect() if r["k"] == c["_by0"]]
        at = lambda bound, none: none if bound is None else sum(place(r) <= place(bound) for r in rows)
        assert c["n_lower"] == at(c["lower"], 0) <= cap and c["n_upper"] == at(c["upper"], len(rows))
        assert c["n_upper"] >= min(cap, len(rows))


def test_only_the_last_bucket_is_shuffled(spark):
    """Of two million rows in two groups, the ranking gets the rows of a bucket only."""
    df = written(spark.range(0, 2_000_000, 1, 16).select((F.col("id") % 2).alias("k"), F.xxhash64("id").alias("a")))
    cap = 50_000
    cuts = cut.cutoffs(df, ["k"], ["a"], F.lit(cap))
    sure, last = cut.split_at(df, cuts, ["k"], ["a"])
    n_sure, n_last = sure.count(), last.count()
    assert n_sure <= 2 * cap <= n_sure + n_last
    assert n_last <= 2 * (cut.ENOUGH + cap / cut.PART_OF_CAP)
    got = cap_per_combo(df, cap, by=["k"], order_by=["a"])
    assert got.groupBy("k").count().where(f"count = {cap}").count() == 2
    ranked = [part for part in got._jdf.queryExecution().executedPlan().toString().split("Union")[1].split("Exchange")[1:]]
    assert all("_cut" in part or "Broadcast" in part for part in ranked[-2:])


def test_no_exchange_of_the_base_for_a_stable_cap(spark, conf):
    df = written(spark.range(0, 300_000, 1, 8).select(F.xxhash64("id").alias("a"), F.col("id").alias("b")))
    got = first_rows(df, 20_000, ["a"])
    text = got._jdf.queryExecution().executedPlan().toString()
    above, sure, last = text.split("Union")[0], *text.split("Union")[1].split("(unknown)")[:1], text
    assert "Exchange" not in above and "TakeOrdered" not in last
    # The branch of rows that are kept as they stream by has a scan, a filter and no exchange.
    branches = sure.split("FileScan")
    assert "Exchange" not in branches[0]
    assert got.count() == 20_000 and got.agg(F.max("a")).first()[0] == df.orderBy("a").limit(20_000).agg(F.max("a")).first()[0]


def test_a_cap_for_one_combination_leaves_the_others_whole(spark):
    data = sample(4000)
    df = spark.createDataFrame(data, SCHEMA)
    for caps in ({"hot": 10}, {"hot": 1100}):
        got = cap_per_combo(df, None, caps, by=["k"], order_by=["a"])
        assert collected(got) == first_of(data, [0], [1, 2, 3], lambda k: caps.get(k[0], 10**9))


@pytest.mark.parametrize("tasks", [1, 400])
def test_a_large_cap_is_dealt_out_over_the_tasks(spark, tasks):
    df = spark.range(0, 40_000, 1, tasks).select("id", F.lit(1).alias("x"))
    got = any_rows(df, 5000)
    ids = [r["id"] for r in got.collect()]
    assert len(ids) == len(set(ids)) == 5000 and got.columns == ["id", "x"]
    text = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Limit" not in text
    # The only exchange to a single task is that of the counts, one row for each task.
    single = [part for part in text.split("Exchange SinglePartition")[1:]]
    assert len(single) == 1 and "HashAggregate" in single[0].split("FileScan")[0]
    held = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert held <= 5000
    assert any_rows(df, 50_000).count() == 40_000


def test_rows_of_a_bucket_are_counted_without_sorting(spark):
    df = written(spark.range(0, 20_000, 1, 4).select((F.col("id") % 2).alias("k"), F.xxhash64("id").alias("a")))
    cuts = cut._counted(df, ["k"], ["a"], F.lit(5000))
    closer = cut._closer(df, cut._proposed(df, cuts, ["k"], ["a"], 1), ["k"], ["a"])
    assert {(r["cap"], r["n_lower"] <= 5000 <= r["n_upper"]) for r in closer.collect()} == {(5000, True)}
    text = closer._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in text and "SortAggregate" not in text
