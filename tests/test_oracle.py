"""Every registered query against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from compare import connect, differences
from texelyard.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_statement():
    assert set(QUERIES) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches(spark, con, name):
    found = differences(con, entry_points.oracle_sql()[name], entry_points.queries()[name](spark, SF))
    assert found is None, found


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
