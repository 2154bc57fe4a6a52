"""What the executed plans must and must not contain."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orefold.operators import incremental as I
from orefold.operators import quality as Q
from orefold.operators.roles import ColumnRole
from orefold.sources.csv import RAGGED, read_with_ragged_flag
from registry import QUERIES
from registry.views import sales_orders, table

SF_DIR = "/root/testdata/sf0.001"
LAZY = (
    "simple_aggregate",
    "gold_group_stats",
    "gold_group_stats_spread",
    "gold_distinct_counts",
    "column_stats",
    "schema_discovery",
    "dq_report",
    "validation_verdict",
    "role_transform",
    "monthly_series",
    "growth_trend",
    "yoy_growth",
    "ranking",
    "breakdown",
    "cross_breakdown",
    "contribution",
    "contributors",
    "question_intent",
    "question_filters",
    "question_filters_spread",
    "reasoning_summary",
    "step_status_log",
)
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas")


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_no_python(spark, name):
    plan = executed(QUERIES[name](spark, SF_DIR))
    assert not [node for node in FORBIDDEN if node in plan]


@pytest.mark.parametrize("name", ["breakdown", "cross_breakdown", "dq_report"])
def test_shared_grouping_is_shuffled_once(spark, name):
    final = executed(QUERIES[name](spark, SF_DIR))
    assert "ReusedExchange" in final


def test_tail_filter_reaches_the_scan(spark):
    plan = executed(I.tail_after(sales_orders(spark, SF_DIR), "order_id", 100))
    assert "GreaterThan(o_orderkey,100)" in plan


def test_only_needed_columns_are_read(spark):
    plan = executed(QUERIES["monthly_series"](spark, SF_DIR))
    assert "l_extendedprice" in plan and "l_tax" not in plan and "l_returnflag" not in plan


def test_percentiles_never_gather_a_group(spark):
    from orefold.operators.gold import group_stats

    lines = table(spark, SF_DIR, "lineitem")
    plan = executed(group_stats(lines, ["l_returnflag"], ["l_quantity"]))
    assert "percentile(" not in plan.replace("percentiles", "")


def test_ragged_rows_fail_the_consistency_check(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("id,v\n1,a\n2,b,c\n3\n2,b\n")
    raw = read_with_ragged_flag(spark, str(path))
    row = Q.quality_counters(raw, [ColumnRole("id", "integer", "KEY"), ColumnRole("v")], RAGGED).first()
    assert (row.row_count, row.inconsistent_rows, row.null_values, row.duplicate_ids) == (4, 1, 1, 1)
    assert (row.empty_rows, row.duplicate_rows) == (0, 0)
    assert raw.filter(F.col(RAGGED)).count() == 1
    assert [tuple(r) for r in raw.select("id", RAGGED).collect()] == [
        ("1", False), ("2", True), ("3", False), ("2", False)
    ]
