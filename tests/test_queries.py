"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_point
from tests.check_oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query(spark, con, name):
    problem = compare(spark, con, name, entry_point.queries()[name], entry_point.oracle_sql()[name], SF_DIR)
    assert problem is None


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
