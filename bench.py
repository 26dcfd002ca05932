"""Time the headline queries; prints one JSON line.

Each query is built from scratch and run into Spark's `noop` sink (or, for the
saving query, into the shared folder). One untimed run warms the JVM, then the
best of `BENCH_RUNS` runs counts, building the plan included.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.functions.columns import any_tag_contains
from basewright.functions.vocabulary import EXACT_TAGS, TAG_NEEDLES, TAGS
from basewright.operators.tags import exploded_tags, forbidden_by_exact_tag
from basewright.queries.registry import QUERIES
from basewright.sources.fixtures import fixture_tables
from basewright.sources.tables import Tables

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = (
    "base_eligibility_exact",
    "base_eligibility_substring",
    "base_homepage",
    "base_pdp",
    "base_open_only",
    "base_all_lookups",
    "current_snapshot",
    "group_customer",
    "forbidden_exact",
    "forbidden_substring",
    "income_all",
    "limit_per_combo",
    "stage_counts",
    "split_cross",
)
#: Queries that are also timed on stored tables, collections by day, without the fixture's own work.
ON_STORED = (
    "base_eligibility_exact",
    "base_eligibility_substring",
    "base_homepage",
    "base_pdp",
    "base_all_lookups",
    "group_customer",
    "forbidden_exact",
    "limit_per_combo",
    "limit_per_combo_large",
    "limit_stable_whole",
    "limit_rows_large_check",
    "split_cross",
)


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("basewright-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="basewright-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stored_tables(spark: SparkSession) -> Tables:
    """The fixture views written out as a cluster would hold them: collections by day."""
    root, paths = tempfile.mkdtemp(prefix="basewright-bench-"), {}
    fixtures = fixture_tables(spark, SF_DIR)
    for name in fixtures:
        writer = fixtures[name].write
        if name.startswith("collections_"):
            writer = writer.partitionBy("date")
        paths[name] = f"{root}/{name}"
        writer.parquet(paths[name])
    return Tables.from_parquet(spark, paths)


def copies(df: DataFrame, times: int = 50) -> DataFrame:
    """More rows of the same kind, so that matching tags outweighs starting a job."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def comparisons(spark: SparkSession, tables: Tables) -> dict:
    """The rewritten forms next to the forms they replace, on the same stored rows."""
    root = tempfile.mkdtemp(prefix="basewright-bench-")
    copies(tables["customers"]).repartition(int(CPUS)).write.parquet(f"{root}/customers")
    many = spark.read.parquet(f"{root}/customers")
    key = "customer__id"

    def filter_then_distinct():
        return forbidden_by_exact_tag(many)

    def group_then_filter():
        flag = F.max(F.col("tag").isin(*EXACT_TAGS).cast("int")).alias("flag")
        return exploded_tags(many).groupBy(key).agg(flag).where("flag = 1")

    def substring():
        return many.where(any_tag_contains(TAGS, TAG_NEEDLES)).select(key).distinct()

    return {
        "tags_exact_x50": filter_then_distinct,
        "tags_exact_grouped_x50": group_then_filter,
        "tags_substring_x50": substring,
    }


def controls(spark: SparkSession) -> dict:
    """Two fixed jobs whose code never changes, so that runs on machines of other speeds can be compared."""

    def control_scan():
        return spark.read.parquet(f"{SF_DIR}/lineitem.parquet").agg(F.sum(F.xxhash64("*").bitwiseAND(1023)).alias("x"))

    def control_shuffle():
        return spark.range(0, 4_000_000, 1, 16).groupBy(F.xxhash64("id").bitwiseAND(262143).alias("k")).agg(F.max("id").alias("m"))

    return {"control_scan": control_scan, "control_shuffle": control_shuffle}


def seconds(make) -> float:
    def once() -> float:
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    once()
    return round(min(once() for _ in range(RUNS)), 3)


def scale_factor(folder: str) -> float | str:
    name = os.path.basename(folder.rstrip("/"))
    try:
        return float(name.removeprefix("sf"))
    except ValueError:
        return name


def main() -> None:
    spark = session()
    times = {name: seconds(lambda q=QUERIES[name]: q(spark, SF_DIR)) for name in HEADLINE}
    total = round(sum(times.values()), 3)
    tables = stored_tables(spark)
    extra = {f"stored_{name}": lambda q=QUERIES[name].on: q(tables) for name in ON_STORED}
    extra |= comparisons(spark, tables) | controls(spark)
    times |= {name: seconds(make) for name, make in extra.items()}
    result = {
        "metric": "headline_queries_total",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": scale_factor(SF_DIR),
        "cpus": int(CPUS),
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
