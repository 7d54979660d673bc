"""Registered queries against their SQL on the smallest tables. tests/oracle_check.py does the same at any scale."""

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from relvec.registry.oracle import ORACLE


@pytest.fixture(scope="module")
def con():
    return connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, small, name):
    assert compare(queries()[name](spark, small), con, oracle_sql()[name]) is None


def test_entry_and_names(spark):
    assert entry(spark).count() == 1000
    assert set(oracle_sql()) <= set(queries())
