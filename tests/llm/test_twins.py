"""The operators with an SQL twin, on the smallest tables."""

import pytest

from checks.run import compare, connect
from vulnlake.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    ok, note = compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], SF_DIR, connect(SF_DIR))
    assert ok, note


def test_every_operator_is_registered():
    assert {name.split("_")[0] for name in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
