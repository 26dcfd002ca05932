"""Any number of needles or listed tags: the same rows as testing each, in a plan of bounded size."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basewright.functions.columns import FEW_NEEDLES, any_tag_contains
from basewright.functions.patterns import alternation
from basewright.functions.vocabulary import TAG_NEEDLES
from basewright.operators.tags import FEW_TAGS, forbidden_by_exact_tag, forbidden_by_substring
from basewright.plans.build import base_for
from basewright.plans.spec import BaseSpec
from basewright.sources.tables import Tables

SCHEMA = "customer__id bigint, customer__tags array<string>"


def as_python(pattern):
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab.[]\\|^-é\U0001f600 ", max_size=4), max_size=12), st.text("ab.[]\\|^-é\U0001f600 ", max_size=9))
def test_a_pattern_is_found_where_a_needle_is(needles, text):
    pattern = alternation(needles)
    assert (pattern is not None and re.search(as_python(pattern), text) is not None) == any(n in text for n in needles)


def test_common_beginnings_are_merged():
    assert alternation(["abc", "abd", "ab"]) == "ab"
    assert alternation(["abc", "abd", "xyz"]) == "(?:xyz|ab[cd])" or alternation(["abc", "abd", "xyz"]) == "(?:ab[cd]|xyz)"
    assert alternation([]) is None and alternation(["", "a"]) == ""
    assert len(alternation(["y" * 5000, "y" * 4999 + "z"])) < 5010


def needles(n, seed=1):
    pick = random.Random(seed)
    return ["".join(pick.choices("abcdefghij .*+(", k=pick.randrange(4, 9))) for _ in range(n)]


def test_ten_thousand_needles_flag_the_same_customers(spark, rows):
    many = needles(10_000) + list(TAG_NEEDLES) + ["UPPER"]
    pick = random.Random(2)
    tags = [[f"x {pick.choice(many).upper()} y", "ok"] if i % 3 == 0 else ["fine", None] if i % 3 == 1 else None for i in range(600)] + [["upper"], ["\U0001f600 Fraud_id"]]
    df = spark.createDataFrame(list(enumerate(tags)), SCHEMA)
    got = rows(forbidden_by_substring(df, many))
    usable = [n for n in many if n == n.lower()]
    wanted = [(i,) for i, t in enumerate(tags) if any(n in tag.lower() for tag in t or [] if tag for n in usable)]
    assert got == sorted(wanted, key=str) and len(got) > 150
    folded = rows(forbidden_by_substring(df, many, fold_needles=True))
    assert (600,) in folded and (600,) not in got
    plan = forbidden_by_substring(df, many)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("contains(") == 0 and plan.count("RLIKE") + plan.count("rlike") == 1


@pytest.mark.parametrize("n", [FEW_NEEDLES, FEW_NEEDLES + 1])
def test_both_forms_agree_on_nulls(spark, n):
    many = [*needles(n - 1), "zz"]
    df = spark.createDataFrame([(0, None), (1, []), (2, [None]), (3, [None, "azz"]), (4, ["b", None])], SCHEMA)
    got = [r[0] for r in df.orderBy("customer__id").select(any_tag_contains("customer__tags", many)).collect()]
    assert got == [None, False, None, True, None]


def test_needles_that_can_never_match(spark):
    df = spark.createDataFrame([(0, ["A"])], SCHEMA)
    assert forbidden_by_substring(df, [f"A{i}" for i in range(99)]).count() == 0


def test_listed_tags_as_a_table(spark, rows):
    listed = [f"tag {i}" for i in range(10_000)]
    tags = [[f"tag {i * 37}", "tag 1x"] if i % 2 else ["Tag 5", None] for i in range(600)] + [None, ["tag 5"] * 3]
    df = spark.createDataFrame(list(enumerate(tags)), SCHEMA)
    wanted = sorted(((i,) for i, t in enumerate(tags) if any(x in set(listed) for x in t or [])), key=str)
    assert len(listed) > FEW_TAGS
    table = spark.createDataFrame([(t,) for t in listed] + [(None,), ("tag 1",)], "name string")
    for given_list in (listed, table):
        assert rows(forbidden_by_exact_tag(df, given_list)) == wanted
    assert len(forbidden_by_exact_tag(df, listed)._jdf.queryExecution().optimizedPlan().toString()) < 5000


def test_a_spec_can_name_a_table_of_tags(spark, rows):
    tables = Tables({
        "collections_cc": lambda: spark.range(6).select(F.col("id").alias("customer__id"), F.lit("p").alias("prototype")),
        "customers": lambda: spark.createDataFrame([(1, ["bad"]), (2, ["worse", "ok"]), (3, ["ok"]), (None, ["bad"])], SCHEMA),
        "not_now": lambda: spark.createDataFrame([("bad",), ("worse",)], "tag string"),
    })
    spec = BaseSpec(credit_card=True, tag_rule="exact", tag_list="not_now", columns=("customer__id",))
    assert rows(base_for(tables, spec)) == [(0,), (3,), (4,), (5,)]
    for bad in ({"tag_rule": "substring"}, {"forbidden_tags": ("x",)}, {"tag_rule": None}):
        with pytest.raises(ValueError):
            BaseSpec(**{"tag_rule": "exact", "tag_list": "not_now", **bad})
