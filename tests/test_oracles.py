"""Every registered query against its SQL statement, and its plan against forms that do not scale."""

import compare
import pytest

import __spark_entry__ as entry_module

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    return compare.connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    names, rows = compare.spark_rows(df)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert rows
    if name in ORACLES:
        assert (names, rows) == compare.duck_rows(duck, ORACLES[name])
        assert compare.type_differences(df, duck, ORACLES[name]) == []


def test_entry(spark):
    assert set(entry_module.entry(spark).columns) == {"query_id", "mode", "block", "text", "source", "confidence"}
