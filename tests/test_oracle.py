"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    diff, _ = compare(spark, con, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert diff is None, diff


def test_entry(spark):
    assert entry.entry(spark).columns
