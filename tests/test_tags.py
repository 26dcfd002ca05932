from hypothesis import given, settings
from hypothesis import strategies as st

from basewright.functions.columns import live_needles
from basewright.functions.vocabulary import EXACT_TAGS, TAG_NEEDLES
from basewright.operators.tags import (
    exploded_tags,
    forbidden_by_exact_tag,
    forbidden_by_substring,
    without_forbidden,
)

SCHEMA = "customer__id bigint, customer__tags array<string>"


def tagged(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), SCHEMA)


def test_list_sizes():
    assert len(set(EXACT_TAGS)) == 27
    assert len(set(TAG_NEEDLES)) == 36


def test_exact_rule_wants_the_whole_tag_as_written(spark, rows):
    df = tagged(spark, ["AML"], ["aml"], ["fraud_id_2"], ["ok", "pep"], None, [], [None, "óbito"])
    assert rows(forbidden_by_exact_tag(df)) == [(0,), (3,), (6,)]


def test_flagged_customers_appear_once(spark, rows):
    df = spark.createDataFrame([(1, ["pep"]), (1, ["pep", "beta"]), (1, ["ok"])], SCHEMA)
    assert rows(forbidden_by_exact_tag(df)) == [(1,)]
    assert rows(forbidden_by_substring(df)) == [(1,)]


def test_substring_rule_folds_tags_but_not_needles(spark, rows):
    df = tagged(
        spark,
        ["Beta tester"],  # 0: tag is lowercased
        ["Customer_group_owner"],  # 1: needle has a capital, so it never matches
        ["my embaixador-nu"],  # 2: the same
        ["AML"],  # 3: the list also has it in lower case
        ["pepsi"],  # 4: any substring counts
        None,  # 5
        [None, "ok"],  # 6
        [None, "BLOCKED by court"],  # 7
        [],  # 8
    )
    assert rows(forbidden_by_substring(df)) == [(0,), (3,), (4,), (7,)]
    folded = forbidden_by_substring(df, fold_needles=True)
    assert rows(folded) == [(0,), (1,), (2,), (3,), (4,), (7,)]


def test_no_usable_needle_flags_nobody(spark, rows):
    assert rows(forbidden_by_substring(tagged(spark, ["ok"]), needles=["OK"])) == []


def test_explode_drops_null_and_empty_arrays(spark, rows):
    df = tagged(spark, ["a", "b"], None, [], [None])
    assert rows(exploded_tags(df)) == [(0, "a"), (0, "b"), (3, None)]


def test_rows_without_a_key_survive_the_anti_join(spark, rows):
    base = spark.createDataFrame([(1,), (1,), (2,), (None,)], "customer__id bigint")
    forbidden = spark.createDataFrame([(1,), (None,)], "customer__id bigint")
    for one_per_key in (False, True):
        kept = without_forbidden(base, forbidden, one_per_key=one_per_key)
        assert rows(kept) == [(2,), (None,)]


pieces = st.sampled_from([*TAG_NEEDLES, *EXACT_TAGS, "ok", "-", " ", "Fraud", "bloq", "ff_"])
texts = st.lists(pieces | st.text(max_size=4), max_size=4).map("".join)


@settings(max_examples=400, deadline=None)
@given(texts, st.booleans())
def test_dropping_implied_needles_changes_nothing(tag, fold):
    needles = [n.lower() for n in TAG_NEEDLES] if fold else TAG_NEEDLES
    low = tag.lower()
    kept = live_needles(TAG_NEEDLES, fold)
    assert any(n in low for n in kept) == any(n in low for n in needles)
