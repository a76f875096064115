"""Every registered query: equal to its SQL where there is one, some rows otherwise."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference
from tests.conftest import SF

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "BatchEvalPython" not in plan
    if name in ORACLE:
        assert difference(df, con, ORACLE[name]) is None
    else:
        assert df.count() > 0


def test_entry_has_rows_and_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.schema == entry.entry(spark).schema
