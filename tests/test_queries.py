"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as entry
from stratiform.suite import load
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(load()))
def test_query_matches_its_sql(spark, con, name):
    ok, text = compare(spark, con, FOLDER, load()[name])
    assert ok or text == "both sides are empty", text


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "c_custkey"
