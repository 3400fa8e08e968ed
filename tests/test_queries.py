"""Registered queries against their DuckDB twins at the smallest scale."""

import pytest

import __spark_entry__ as driver
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
TWINS = driver.oracle_sql()
# A query of each kind; `python -m tests.check 0.01` runs all of them.
SOME = [n for i, n in enumerate(sorted(TWINS)) if i % 6 == 0]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(driver.queries())


@pytest.mark.parametrize("name", SOME)
def test_query(spark, con, name):
    note = compare(driver.queries()[name](spark, SF), con, TWINS[name])
    assert note in (None, "both empty"), note


def test_entry(spark):
    assert driver.entry(spark).count() == 4
