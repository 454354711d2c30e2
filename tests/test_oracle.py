"""Every registered query: its result against SQL in another engine, and its plan."""

import pytest

import __spark_entry__ as entry
from hazardlens.plans.catalog import QUERIES
from tools import compare


ORACLE = entry.oracle_sql()
FORBIDDEN = [
    "CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas", "InArrow",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan]
    problems = compare.differences(frame, con, ORACLE.get(name))
    # At the smallest scale both engines may agree on an empty result.
    problems = [p for p in problems if p != "no rows"]
    assert not problems, "\n".join(problems)


def test_every_sql_text_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5
