"""Every registered query against its SQL on the smallest tables, and the shape of some plans."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tools.check_queries import compare, connect  # noqa: E402

FOLDER = os.environ.get("HAULMARK_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_entry(spark):
    assert entry.entry(spark).count() > 1


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql().get(name), FOLDER).startswith(("ok", "rows only"))


def plan_of(spark, name):
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_validation_is_one_narrow_pass(spark):
    plan = plan_of(spark, "load_stats")
    assert plan.count("Exchange") == 1 and "SinglePartition" in plan and "Python" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(spark, "scan_where")
    assert "PushedFilters: [IsNotNull(o_orderstatus), IsNotNull(o_custkey), EqualTo(o_orderstatus,F), GreaterThan(o_" in plan
    assert "o_totalprice" not in plan


def test_no_window_over_a_key_where_sums_do(spark):
    for name in ("unique_violations", "unique_rows", "layered_fallback", "latest_state", "overlay", "reconcile"):
        plan = plan_of(spark, name)
        assert "Window" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_first_lines_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(spark, "tsv_first_row")
