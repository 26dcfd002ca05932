"""One query per operator, over the fixture views of a data folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce, wraps
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.vocabulary import COLUMN_NAMES, CUSTOMER, PROTOTYPE, TAGS
from ..operators import caps, checks, filters, grouping, lookups, tags
from ..operators.partials import Partials
from ..operators.prefilter import without_keys
from ..plans import build
from ..plans.save import save_base
from ..plans.spec import BaseSpec
from ..plans.stages import stage_counts as count_stages
from ..plans.templates import ELIGIBILITY_EXACT, ELIGIBILITY_SUBSTRING, HOMEPAGE, PDP, TEMPLATES
from ..sinks import tables as sinks
from ..sinks.shared import new_path, written
from ..sources.collections import advanced, collections_source, latest_state
from ..sources.fixtures import fixture_tables
from ..sources.naming import renamed
from ..sources.state import merged_state, store_state
from ..sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEGMENT_COLUMNS = ("customer__id", "lateness", "segment")
COLLECTION_COLUMNS = ("collection__id", "customer__id", "date")
CAPS = {"multi_debt_long": 40, "cc_only_short": 25}
DEFAULT_CAP = 60


def query(function: Callable[..., DataFrame], name: str | None = None) -> Callable:
    """Register a function of the fixture tables under its own name; `on` takes any tables."""

    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(fixture_tables(spark, sf_dir))

    run.on = function
    QUERIES[name or function.__name__] = run
    return function


def _union(t: Tables) -> DataFrame:
    return collections_source(t, credit_card=True, lending=True)


def _grouped(t: Tables) -> DataFrame:
    """The flagship's base before its lookups: one labelled row per customer."""
    return build.build_base(t, ELIGIBILITY_EXACT)


# --- sources ------------------------------------------------------------------------


@query
def scan_cc_daily(t: Tables) -> DataFrame:
    return t["collections_cc"]


@query
def scan_ll_daily(t: Tables) -> DataFrame:
    return t["collections_ll"]


@query
def current_snapshot(t: Tables) -> DataFrame:
    return latest_state(t["collections_daily"])


@query
def current_snapshot_advanced(t: Tables) -> DataFrame:
    """The state before the newest day, written, brought forward by the rows of that day."""
    daily = t["collections_daily"]
    newest = daily.select(F.max("date")).scalar()
    stored = written(latest_state(daily.where(F.col("date") < newest)), "current")
    return advanced(stored, daily.where(F.col("date") == newest))


@query
def current_snapshot_bucketed(t: Tables) -> DataFrame:
    """The same with the state stored in buckets, which the newest day is merged into where it lies."""
    daily = t["collections_daily"]
    newest = daily.select(F.max("date")).scalar()
    stored = store_state(latest_state(daily.where(F.col("date") < newest)), "current_in_buckets", 8)
    return merged_state(stored, daily.where(F.col("date") == newest), 8)


@query
def customer_tags_scan(t: Tables) -> DataFrame:
    joined = F.array_join(TAGS, "|", "<null>")
    return t["customers"].select(CUSTOMER, PROTOTYPE, joined.alias("tags"))


@query
def source_cc_only(t: Tables) -> DataFrame:
    return collections_source(t, credit_card=True)


@query
def source_ll_only(t: Tables) -> DataFrame:
    return collections_source(t, lending=True)


@query
def source_union(t: Tables) -> DataFrame:
    return _union(t)


@query
def source_current_union(t: Tables) -> DataFrame:
    """Both products' latest states, derived from the daily tables."""
    return collections_source(t, credit_card=True, lending=True, current=True)


@query
def rename_columns(t: Tables) -> DataFrame:
    logical = _union(t).select(
        "collection__id",
        "date",
        F.col("product__days_late").alias("days_late"),
        F.col("collection__cured").alias("cured"),
        F.col("is_cc").alias("iscc"),
        F.col("is_ll").alias("isll"),
    )
    return renamed(logical, COLUMN_NAMES)


@query
def project_columns(t: Tables) -> DataFrame:
    return build.project(_union(t), ("customer__id", "prototype", "collection__status"))


# --- filters ------------------------------------------------------------------------


@query
def filter_snapshot_date(t: Tables) -> DataFrame:
    return _union(t).where(filters.on_date("2026-03-03")).select(*COLLECTION_COLUMNS)


@query
def filter_customer_type(t: Tables) -> DataFrame:
    return (
        _union(t).where(filters.of_type("company")).select(*COLLECTION_COLUMNS, "customer__type")
    )


@query
def filter_open(t: Tables) -> DataFrame:
    return _union(t).where(filters.is_open()).select(*COLLECTION_COLUMNS, "collection__status")


@query
def filter_cured(t: Tables) -> DataFrame:
    return (
        _union(t)
        .where(filters.is_cured())
        .select(*COLLECTION_COLUMNS, "collection__cured", "collection__end")
    )


@query
def filter_days_late(t: Tables) -> DataFrame:
    return (
        _union(t)
        .where(filters.days_late_between(5, 365))
        .select(*COLLECTION_COLUMNS, "product__days_late")
    )


@query
def filter_segment(t: Tables) -> DataFrame:
    spec = replace(
        ELIGIBILITY_EXACT,
        tag_rule=None,
        attributes=(),
        segment="multi_debt",
        columns=SEGMENT_COLUMNS,
        row_cap=None,
    )
    return build.base_for(t, spec)


@query
def recency_filter(t: Tables) -> DataFrame:
    return lookups.recent_income(t["income_segments"], t["collections_cc"])


# --- grouping -----------------------------------------------------------------------


@query
def group_customer(t: Tables) -> DataFrame:
    return grouping.one_row_per(_union(t), [CUSTOMER], ["is_cc", "is_ll", "product__days_late"])


@query
def group_customer_partials(t: Tables) -> DataFrame:
    """From maxima stored by day: all days but the newest, then the newest."""
    measures = ["is_cc", "is_ll", "product__days_late"]
    rows = _union(t).select(CUSTOMER, *measures, "date")
    store = Partials(rows.sparkSession, new_path(rows.sparkSession, "partials"), [CUSTOMER], measures, rows)
    newest = rows.select(F.max("date")).scalar()
    store.add(rows.where(F.col("date") < newest))
    store.add(rows.where(F.col("date") == newest))
    return store.total()


@query
def group_customer_prototype(t: Tables) -> DataFrame:
    measures = ["is_cc", "is_ll", "product__days_late"]
    return grouping.one_row_per(_union(t), [CUSTOMER, PROTOTYPE], measures)


@query
def group_keys_only(t: Tables) -> DataFrame:
    return grouping.one_row_per(_union(t), [CUSTOMER])


@query
def latest_date(t: Tables) -> DataFrame:
    return lookups.latest_date(t["collections_cc"])


# --- labels -------------------------------------------------------------------------


@query
def lateness(t: Tables) -> DataFrame:
    return _union(t).select(
        *COLLECTION_COLUMNS, "product__days_late", C.lateness(65).alias("lateness")
    )


@query
def segment(t: Tables) -> DataFrame:
    grouped = grouping.one_row_per(_union(t), [CUSTOMER], ["is_cc", "is_ll"])
    return grouped.withColumn("segment", C.product_segment())


@query
def segment_ungrouped(t: Tables) -> DataFrame:
    """Without grouping a row has one product, so no row is 'multi_debt'."""
    return _union(t).select(*COLLECTION_COLUMNS, C.product_segment().alias("segment"))


# --- tags ---------------------------------------------------------------------------


@query
def explode_tags(t: Tables) -> DataFrame:
    return tags.exploded_tags(t["customers"])


@query
def lower_tags(t: Tables) -> DataFrame:
    joined = F.array_join(C.lowered(TAGS), "|", "<null>")
    return t["customers"].select(CUSTOMER, joined.alias("lowered_tags"))


@query
def forbidden_exact(t: Tables) -> DataFrame:
    return tags.forbidden_by_exact_tag(t["customers"])


@query
def forbidden_substring(t: Tables) -> DataFrame:
    return tags.forbidden_by_substring(t["tags_daily"])


@query
def forbidden_substring_folded(t: Tables) -> DataFrame:
    return tags.forbidden_by_substring(t["tags_daily"], fold_needles=True)


@query
def forbidden_exact_listed(t: Tables) -> DataFrame:
    """The list is a table: all tags of customers that have an underscore."""
    listed = tags.exploded_tags(t["customers"]).where(F.contains("tag", F.lit("_"))).select("tag")
    return tags.forbidden_by_exact_tag(t["customers"], listed)


#: Thousands of needles from a rule: all strings of three of these letters.
MANY_NEEDLE_LETTERS = "adefgilmnoprstuw"


@query
def forbidden_substring_many(t: Tables) -> DataFrame:
    needles = ["".join(letters) for letters in product(MANY_NEEDLE_LETTERS, repeat=3)]
    return tags.forbidden_by_substring(t["tags_daily"], needles)


@query
def anti_forbidden(t: Tables) -> DataFrame:
    forbidden = tags.forbidden_by_exact_tag(t["customers"])
    return tags.without_forbidden(_grouped(t), forbidden, one_per_key=True).select(*SEGMENT_COLUMNS)


# --- lookups ------------------------------------------------------------------------


@query
def dedup_customers(t: Tables) -> DataFrame:
    return lookups.attributes_by_customer(t["customers"], [PROTOTYPE])


@query
def enrich_inner(t: Tables) -> DataFrame:
    base = _grouped(t).select(*SEGMENT_COLUMNS)
    return lookups.with_attributes(base, t["customers"], [PROTOTYPE], one_per_key=True)


@query
def distinct_tier(t: Tables) -> DataFrame:
    return lookups.members(t["tier_roxinho"])


def _tiers(t: Tables, *names: str) -> DataFrame:
    base = _grouped(t).select(*SEGMENT_COLUMNS)
    return reduce(
        lambda df, name: lookups.in_tier(df, t[f"tier_{name}"], name, one_per_key=True), names, base
    )


query(lambda t: _tiers(t, "roxinho"), "tier_roxinho")
query(lambda t: _tiers(t, "uv"), "tier_uv")
query(lambda t: _tiers(t, "nu_plus"), "tier_nu_plus")
query(lambda t: _tiers(t, "u18"), "tier_u18")
query(lambda t: _tiers(t, "roxinho", "uv"), "tier_multi_and")


@query
def tier_flag(t: Tables) -> DataFrame:
    base = _grouped(t).select(*SEGMENT_COLUMNS)
    return lookups.flag_tier(base, t["tier_uv"], "uv", one_per_key=True)


@query
def dedup_income(t: Tables) -> DataFrame:
    recent = lookups.recent_income(t["income_segments"], t["collections_cc"])
    return lookups.income_by_customer(recent)


def _income(t: Tables, *values: str) -> DataFrame:
    recent = lookups.recent_income(t["income_segments"], t["collections_cc"])
    income = lookups.income_by_customer(recent)
    base = _grouped(t).select(*SEGMENT_COLUMNS)
    return lookups.with_income(base, income, values, one_per_key=True)


query(lambda t: _income(t, "mass_market"), "income_one")
query(lambda t: _income(t, "mass_market", "high_income"), "income_two")
query(lambda t: _income(t, "mass_market", "super_core", "high_income"), "income_all")

ALL_LOOKUPS = replace(
    ELIGIBILITY_EXACT,
    tiers=("roxinho",),
    income=("mass_market", "super_core"),
    columns=(*SEGMENT_COLUMNS, "prototype", "roxinho", "income_segments"),
    row_cap=None,
)
TAGS_AND_INCOME = BaseSpec(
    lending=True,
    current=True,
    cured_only=True,
    tag_rule="substring",
    income=("mass_market", "super_core", "high_income"),
    columns=("collection__id", "customer__id", "is_ll", "income_segments"),
    row_cap=None,
)


@query
def base_all_lookups(t: Tables) -> DataFrame:
    """Tags, attributes, a tier and an income subset on one grouped base."""
    return build.base_for(t, ALL_LOOKUPS)


@query
def base_tags_and_income(t: Tables) -> DataFrame:
    """Cured loans in their latest state, without tagged customers, with income."""
    return build.base_for(t, TAGS_AND_INCOME)


# --- whole bases --------------------------------------------------------------------
# Without their row caps, so that results stay whole and comparable at any size; the
# capped form is `base_homepage_capped`.

for _name, _spec in TEMPLATES.items():
    query(lambda t, spec=replace(_spec, row_cap=None): build.base_for(t, spec), f"base_{_name}")


@query
def base_pdp_staged(t: Tables) -> DataFrame:
    """The same base with its lookup written first, so that its size decides the join."""
    return build.base_for(t, replace(PDP, row_cap=None), staged=True)


@query
def base_pdp_prefiltered(t: Tables) -> DataFrame:
    """The same with a filter over the flagged keys before the exact anti-join, however few they are."""
    flagged = written(build.forbidden_customers(t, PDP), "lookup")
    return build.project(without_keys(build.build_base(t, PDP), flagged, CUSTOMER), PDP.columns)


@query
def base_eligibility_partials(t: Tables) -> DataFrame:
    """The grouped base over all days, from partial results stored by day."""
    spec = replace(ELIGIBILITY_SUBSTRING, row_cap=None)
    store = build.partials_of(t, spec, new_path(t["customers"].sparkSession, "partials"))
    store.add(build.filtered_rows(t, spec))
    return build.base_for(t, spec, partials=store)


@query
def base_pdp_own_needles(t: Tables) -> DataFrame:
    return build.base_for(t, replace(PDP, row_cap=None, needles=("spect", "owner")))


@query
def base_eligibility_renamed(t: Tables) -> DataFrame:
    """The flagship over a lake with other column names, mapped at load."""
    there = {CUSTOMER: "client_id", "product__days_late": "days_overdue", TAGS: "labels"}
    lake = Tables({name: lambda n=name: t[n].withColumnsRenamed(there) for name in t})
    here = {name: there_name for there_name, name in there.items()}
    daily = {c: here[c] for c in ("client_id", "days_overdue")}
    names = {"collections_cc": daily, "collections_ll": daily}
    names["customers"] = {c: here[c] for c in ("client_id", "labels")}
    return build.base_for(lake.with_column_names(names), replace(ELIGIBILITY_EXACT, row_cap=None))


@query
def base_homepage_capped(t: Tables) -> DataFrame:
    return build.base_for(t, HOMEPAGE)


# --- caps ---------------------------------------------------------------------------


@query
def limit_rows(t: Tables) -> DataFrame:
    return caps.any_rows(_grouped(t).select(*SEGMENT_COLUMNS), 100)


@query
def limit_rows_check(t: Tables) -> DataFrame:
    """Which rows `limit_rows` keeps is open, but not how many, nor that they are the base's."""
    base = _grouped(t).select(*SEGMENT_COLUMNS)
    both = base.withColumn("kept", F.lit(0)).unionByName(
        caps.any_rows(base, 100).withColumn("kept", F.lit(1))
    )
    kept, there = F.count_if(F.col("kept") == 1), F.count_if(F.col("kept") == 0)
    counted = both.groupBy(*SEGMENT_COLUMNS).agg(kept.alias("kept"), there.alias("there"))
    return counted.agg(
        F.lit(100).alias("cap"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("rows_kept"),
        F.coalesce(F.sum(F.least("kept", "there")), F.lit(0)).alias("rows_of_base"),
    )


@query
def limit_stable(t: Tables) -> DataFrame:
    return caps.first_rows(_grouped(t).select(*SEGMENT_COLUMNS), 100, [CUSTOMER])


@query
def limit_per_combo(t: Tables) -> DataFrame:
    rows = _grouped(t).select(*SEGMENT_COLUMNS)
    return caps.cap_per_combo(rows, DEFAULT_CAP, CAPS, order_by=[CUSTOMER])


@query
def limit_stable_large(t: Tables) -> DataFrame:
    return caps.first_rows(_grouped(t).select(*SEGMENT_COLUMNS), 1200, [CUSTOMER])


@query
def limit_per_combo_large(t: Tables) -> DataFrame:
    rows = collections_source(t, True, True).select(CUSTOMER, "customer__type", "date")
    return caps.cap_per_combo(rows, 1500, {}, by=["customer__type"], order_by=[CUSTOMER, "date"])


@query
def limit_stable_whole(t: Tables) -> DataFrame:
    """A large cap on ungrouped rows, by day and customer."""
    rows = _union(t).select("date", CUSTOMER, "collection__id", "product__days_late")
    return caps.first_rows(rows, 3000, ["date", CUSTOMER])


@query
def limit_per_combo_named(t: Tables) -> DataFrame:
    """A cap for companies only; persons stay whole."""
    rows = _union(t).select(CUSTOMER, "customer__type", "date", "collection__id")
    return caps.cap_per_combo(rows, None, {"company": 1100}, by=["customer__type"], order_by=["date"])


@query
def limit_rows_large_check(t: Tables) -> DataFrame:
    """Arbitrary rows under a large cap: how many, and that each is a row of the base."""
    base = _union(t).select("collection__id", "date")
    kept = caps.any_rows(base, 2500).withColumn("kept", F.lit(1))
    both = base.withColumn("kept", F.lit(0)).unionByName(kept)
    counted = both.groupBy("collection__id", "date").agg(
        F.count_if(F.col("kept") == 1).alias("kept"), F.count_if(F.col("kept") == 0).alias("there")
    )
    return counted.agg(
        F.lit(2500).alias("cap"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("rows_kept"),
        F.coalesce(F.sum(F.least("kept", "there")), F.lit(0)).alias("rows_of_base"),
    )


# --- sinks --------------------------------------------------------------------------

UNCAPPED = replace(ELIGIBILITY_EXACT, row_cap=None)


@query
def save_roundtrip(t: Tables) -> DataFrame:
    folder = new_path(t["customers"].sparkSession, "save")
    return save_base(t, UNCAPPED, "eligibility_base", folder=folder)["eligibility_base"]


@query
def save_replaced(t: Tables) -> DataFrame:
    """A saved base replaced by a part of itself: read and written under one name."""
    spark = t["customers"].sparkSession
    folder = new_path(spark, "save")
    saved = save_base(t, UNCAPPED, "replaced_base", folder=folder)["replaced_base"]
    return sinks.save_table(saved.where("lateness = 'long'"), "replaced_base", folder)


@query
def csv_roundtrip(t: Tables) -> DataFrame:
    spark = t["customers"].sparkSession
    folder = new_path(spark, "save")
    saved = save_base(t, UNCAPPED, "eligibility_csv_base", folder=folder)
    [path] = sinks.export_csv(spark, list(saved), new_path(spark, "csv"))
    [table] = saved.values()
    return spark.read.schema(table.schema).option("header", "true").csv(path)


def _split(t: Tables, mode: str, row_cap: int | None = None, **options) -> DataFrame:
    """All tables of a split, read back, each row with the table it was saved in."""
    folder = new_path(t["customers"].sparkSession, "save")
    spec = replace(ELIGIBILITY_EXACT, row_cap=row_cap)
    saved = save_base(t, spec, f"base_by_{mode}", split=mode, folder=folder, **options)
    marked = [table.withColumn("saved_as", F.lit(name)) for name, table in saved.items()]
    return reduce(DataFrame.unionByName, marked)


query(lambda t: _split(t, "segment"), "split_by_segment")
query(lambda t: _split(t, "lateness"), "split_by_lateness")
query(lambda t: _split(t, "segment_lateness"), "split_cross")


@query
def split_cross_capped(t: Tables) -> DataFrame:
    return _split(
        t,
        "segment_lateness",
        segments=("cc_only", "multi_debt"),
        row_cap=DEFAULT_CAP,
        caps=CAPS,
        order_by=[CUSTOMER],
    )


@query
def split_replaced(t: Tables) -> DataFrame:
    """A capped split replaced by the whole one, all tables at once."""
    spark = t["customers"].sparkSession
    folder = new_path(spark, "save")
    for row_cap in (5, None):
        saved = save_base(t, replace(ELIGIBILITY_EXACT, row_cap=row_cap), "replaced", split="lateness", folder=folder)
    marked = [table.withColumn("saved_as", F.lit(name)) for name, table in saved.items()]
    return reduce(DataFrame.unionByName, marked)


# --- checks -------------------------------------------------------------------------


@query
def check_unique_key(t: Tables) -> DataFrame:
    recent = lookups.recent_income(t["income_segments"], t["collections_cc"])
    inputs = {
        "customers": t["customers"],
        "customers_deduplicated": lookups.attributes_by_customer(t["customers"], [PROTOTYPE]),
        "income": recent,
        "income_deduplicated": lookups.income_by_customer(recent),
        "tier": t["tier_roxinho"],
        "tier_deduplicated": lookups.members(t["tier_roxinho"]),
    }
    counted = [checks.key_uniqueness(df, name) for name, df in inputs.items()]
    return reduce(DataFrame.unionByName, counted)


@query
def check_repeated_keys(t: Tables) -> DataFrame:
    return checks.repeated_keys(t["customers"])


@query
def check_cured_open(t: Tables) -> DataFrame:
    return checks.cured_and_open(_union(t))


@query
def segment_counts(t: Tables) -> DataFrame:
    return checks.segment_counts(_grouped(t))


@query
def stage_counts(t: Tables) -> DataFrame:
    return count_stages(t, ELIGIBILITY_EXACT)


@query
def stage_counts_ungrouped(t: Tables) -> DataFrame:
    return count_stages(t, HOMEPAGE)
