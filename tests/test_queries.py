"""Every query of the library against its SQL, over whole tables."""

import pytest

from oracle import assert_same, connect
from runlake.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, tiny, con, name):
    assert_same(QUERIES[name](spark, tiny), con, ORACLE[name])


def test_vectors_have_length_one(spark, tiny):
    rows = QUERIES["kb_vectorise"](spark, tiny).collect()
    assert len(rows) == 200 and {r["length"] for r in rows} == {4096} and {r["norm"] for r in rows} <= {0.0, 1.0}


def test_queries_use_no_nested_loops(spark, tiny):
    for name in ("classify_errors", "retry_policy", "retry_once_policy", "duplicate_guard", "rerun_outcome", "new_failures", "daily_summary", "fact_salesorder"):
        plan = QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan, name


def test_filters_and_columns_reach_the_scan(spark, tiny):
    plan = QUERIES["failed_runs"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[1]
    plan = QUERIES["pipeline_items"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_type,ECONOMY)" in plan
