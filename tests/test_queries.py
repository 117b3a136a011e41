"""Every registered query against its SQL, on the smallest test data."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from catalogue import QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    from check_queries import connect

    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    from check_queries import compare

    assert compare(spark, con, SF, name) is None


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, name):
    """No pair of all rows with all rows, and no Python, in any plan."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert operator not in plan
