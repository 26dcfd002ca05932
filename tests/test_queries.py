"""Every registered query against its SQL twin in another engine."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from basewright.queries.oracle import oracle_queries
from basewright.queries.registry import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DATE": "date"}


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    yield connection
    connection.close()


def _sorted(values):
    return sorted(values, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(oracle_queries()))
def test_same_rows_as_sql(spark, sql, name):
    got = QUERIES[name](spark, SF_DIR)
    expected = sql.execute(oracle_queries()[name])
    columns = [c[0] for c in expected.description]
    types = {c[0]: TYPES[str(c[1])] for c in expected.description}
    assert dict(got.dtypes) == types
    order = [columns.index(c) for c in got.columns]
    wanted = [tuple(row[i] for i in order) for row in expected.fetchall()]
    assert wanted, "the fixture should exercise the query"
    assert _sorted(tuple(r) for r in got.collect()) == _sorted(wanted)


def test_queries_without_sql_only_keep_arbitrary_rows(spark):
    assert set(QUERIES) - set(oracle_queries()) == {
        "limit_rows",
        "base_homepage_capped",
    }
    base = {tuple(r) for r in contract.queries()["segment_counts"](spark, SF_DIR).collect()}
    total = sum(count for _, count in base)
    limited = contract.queries()["limit_rows"](spark, SF_DIR)
    assert limited.count() == min(100, total)


def test_entry_has_rows_and_a_stable_schema(spark):
    df = contract.entry(spark)
    assert df.columns == ["customer__id", "lateness", "segment", "prototype"]
    assert df.count() > 0
