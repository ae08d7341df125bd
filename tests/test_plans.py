"""Plan properties that matter at scale, checked on every registered query.

No query may pair rows through a cartesian product or a nested-loop join, or
evaluate Python in the plan; the transaction view must read only the columns it
uses from the fact table.
"""

import pytest

import __spark_entry__ as E
from basketcast.plans.queries import QUERIES
from conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")
# The model-based queries train boosted trees; their plans are covered by the forecast tests.
# ``_multi`` queries are the same plans over another product column.
PLANNED = sorted(q for q in set(QUERIES) - E.NO_SQL if not q.endswith("_multi"))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_pairing_or_python_in_plan(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert not [op for op in FORBIDDEN if op in plan]


def test_fact_scan_reads_only_used_columns(spark):
    plan = _plan(E.queries()["daily_sales"](spark, SF_SMALL))
    assert "l_quantity" in plan
    for unused in ("l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate", "o_totalprice"):
        assert unused not in plan


@pytest.mark.parametrize("name,scans", [("demand_stats", 1), ("safety_stock", 1), ("scenario_forecast", 0), ("inventory_plan", 0),
                                        ("forecast_report", 0), ("actual_vs_forecast", 0)])
def test_fact_table_is_read_once(spark, name, scans):
    # forecasts and what follows from them read the daily table, which is written once
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert plan.count("lineitem.parquet") <= scans
