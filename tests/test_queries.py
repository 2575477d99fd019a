"""Every registered query against its SQL on the same tables."""

import os

import pytest
from oracle_check import connect, differences

import __spark_entry__ as driver
from trailpack.plans.catalogue import QUERIES
from trailpack.plans.oracle import ORACLE

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= driver.queries().items() and ORACLE.items() <= driver.oracle_sql().items()
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    found = differences(QUERIES[name](spark, SF), con, ORACLE[name])
    if name == "leak_count":
        assert QUERIES[name](spark, SF).first().leaks == 0
    assert found == []
