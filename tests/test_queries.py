"""Every registered query against its comparison SQL, at the smallest scale."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from ledgerloom.plans import catalogue  # noqa: E402

SF = "/root/testdata/sf0.001"
JOBS, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for table in compare.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(JOBS) == set(SQL)


@pytest.mark.parametrize("name", sorted(JOBS))
def test_matches(spark, con, name):
    verdict, _, _ = compare.compare(spark, con, name, JOBS[name], SQL[name], SF)
    assert verdict == "ok", verdict


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["team", "BillingCurrency", "row_count", "effective_cost_consumption"]
    frame.collect()
