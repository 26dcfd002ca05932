"""Flagged keys removed through a filter: exact rows, and only possible hits shuffled."""

from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from basewright.operators import prefilter as P
from basewright.plans.build import base_for
from basewright.plans.templates import HOMEPAGE, PDP
from basewright.queries.registry import QUERIES
from basewright.sinks.shared import written
from basewright.sources.fixtures import fixture_tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")


def test_no_flagged_key_is_missed_and_few_others_pass(spark):
    keys = spark.range(0, 50_000, 5).select((F.col("id") * 7919).alias("k"))
    words = P.words_for(10_000)
    assert words * 64 >= 160_000
    row = P.filter_of(keys, "k", words)
    asked = spark.range(50_000).select((F.col("id") * 7919).alias("k"), (F.col("id") % 5 == 0).alias("flagged"))
    counted = asked.where(P.maybe_in(F.col("k"), row, words)).groupBy("flagged").count().collect()
    counts = {r["flagged"]: r["count"] for r in counted}
    assert counts[True] == 10_000 and counts.get(False, 0) < 0.02 * 40_000


@pytest.mark.parametrize("kind", ["bigint", "string"])
@pytest.mark.parametrize("flagged_every", [0, 1, 4])
def test_same_rows_as_the_anti_join(spark, no_broadcast, kind, flagged_every):
    key = F.when(F.col("id") % 10 > 0, F.col("id") % 300).cast(kind)
    df = spark.range(5000).select(key.alias("k"), F.lit(1).alias("x"))
    flagged = spark.range(0, 1000 * bool(flagged_every), flagged_every or 1).select(F.col("id").cast(kind).alias("k"))
    stored = written(flagged.union(spark.range(1).select(F.lit(None).cast(kind).alias("k"))))
    got = P.without_keys(df, stored, "k")
    assert got.columns == ["k", "x"]
    wanted = df.join(flagged, "k", "leftanti")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, wanted.collect()))


def test_the_size_is_bounded():
    assert P.words_for(0) == P.LEAST_WORDS and P.words_for(10**12) == P.MOST_WORDS
    assert P.is_worthwhile(10**7) and not P.is_worthwhile(10**9) and not P.is_worthwhile(0)


def test_only_possible_hits_are_shuffled(spark, no_broadcast):
    """A million rows, a hundredth of them flagged: about as many rows meet the exact join."""
    df = written(spark.range(0, 1_000_000, 1, 8).select((F.col("id") % 100_000).alias("customer__id"), F.lit("p").alias("x")))
    flagged = written(spark.range(0, 1000).select(F.col("id").alias("customer__id")))
    got = P.without_keys(df, flagged, "customer__id")
    plan = got._jdf.queryExecution().executedPlan()
    assert got.count() == 990_000
    plan.executeCollect()
    clear, hits = plan.toString().split("== Initial Plan ==")[0].split("FileScan")[0], plan.toString()
    assert "Exchange" not in clear.split("Union")[1].split("Join")[0]
    words = P.words_for(1000)
    possible = df.where(P.maybe_in(F.col("customer__id"), P.filter_of(flagged, "customer__id", words), words)).count()
    assert 10_000 <= possible < 30_000 and "LeftAnti" in hits


@pytest.mark.parametrize("name", ["base_pdp", "base_homepage", "base_pdp_own_needles"])
def test_bases_are_the_same_without_broadcast(spark, no_broadcast, rows, name, conf):
    got = rows(QUERIES[name](spark, SF_DIR))
    conf("spark.sql.autoBroadcastJoinThreshold", "10MB")
    assert got and got == rows(QUERIES[name](spark, SF_DIR))


def test_the_filter_is_used_where_only_flagged_keys_are_looked_up(spark, no_broadcast):
    tables = fixture_tables(spark, SF_DIR)
    text = base_for(tables, replace(PDP, row_cap=None))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in text and "xxhash64" in text and "scalar-subquery" in text
    # Attributes have to be joined for every row, so no filter helps there.
    text = base_for(tables, replace(HOMEPAGE, row_cap=None))._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" not in text
