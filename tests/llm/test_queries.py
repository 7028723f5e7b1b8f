"""Registered queries with a SQL twin, on the smallest tables."""

import pytest

from tests.oracle_check import compare, connect
from vacantis.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    diff, rows = compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF)
    assert diff is None and rows
