"""Every registered query against its SQL, on whole tables."""

import os

import pytest
from oracle import differences, sql_connection

import __spark_entry__ as entry_points
from millrace.plans.registry import REGISTRY

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {name: entry_points.queries()[name] for name in REGISTRY}


@pytest.fixture(scope="module")
def connection():
    return sql_connection(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry_points.oracle_sql())


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.columns == ["window_start", "window_end", "event_type", "event_count", "total_quantity", "avg_price"]
    assert result.count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_query_gives_the_rows_of_its_sql(spark, connection, name):
    assert differences(QUERIES[name](spark, SF_DIR), entry_points.oracle_sql()[name], connection) == ""
