"""Every registered query against its SQL on the small tables, and without quadratic joins."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare, connect

FOLDER = os.environ.get("EBBFLOW_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not available")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    verdict, _, _ = compare(spark, duck, FOLDER, name, df)
    assert verdict in ("ok", "rows-only"), verdict


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
