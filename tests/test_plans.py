"""Scale guards on the physical plans of the registered queries.

No registered query may contain a cartesian product or a nested-loop join
(anchors are applied by slot expressions, never by joins), and the headline
label plan must prune columns and push its time range into the scan.
"""
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

MODEL = {"predict_churn", "predict_ltv", "explain_top_features", "holdout_validation",
         "predictions_by_segment", "rank_predictions", "predict_batch", "stream_activity_counts"}
QUERIES = E.queries()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODEL))
def test_no_cross_or_nested_loop_join(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_churn_scan_prunes_and_pushes_time_range(spark):
    plan = QUERIES["label_user_churn"](spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
    # the union of the label windows reaches the orders scan as a plain time range
    assert "o_orderdate" in plan and "GreaterThan" in plan and "LessThanOrEqual" in plan
    # lineitem contributes only its join key to the churn label
    assert "l_quantity" not in plan and "l_extendedprice" not in plan
