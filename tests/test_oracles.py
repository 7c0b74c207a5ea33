"""Every query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checks import catalog
from checks.run import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, name, catalog.QUERIES[name], catalog.ORACLES.get(name), SF_DIR, con)
    assert ok, note


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
