"""Physical plans: what reaches the scan, what is shuffled, what stays on the JVM."""

from __future__ import annotations

import datetime as dt
import re

import pytest

from gridtally.operators import dedupe, filters, kpis, quality, rollups
from gridtally.plans.queries import QUERIES
from gridtally.plans.tables import PAYMENTS, READINGS, payments, readings, stored, typed_payments

SF = "/root/testdata/sf0.001"


def scans(plan: str) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan)


@pytest.fixture(scope="module")
def table(spark):
    """Typed payments as the stored table that jobs read."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return stored(typed_payments(spark, SF))


def test_filters_reach_the_scan(table, plan_of):
    wanted = filters.PaymentFilter(
        full_datetime_only=True, date_range=(dt.date(2024, 1, 3), dt.date(2024, 1, 9)), categorycode=["click"],
        measure_range=(1.0, 2.0), hours=[8],
    )
    plan = plan_of(filters.filter_payments(table, PAYMENTS, wanted).select("meterno"))
    pushed = re.search(r"PushedFilters: \[(.*)\], ReadSchema", plan).group(1)
    for column in ("issuedate_parse_status", "vend_date", "categorycode", "transactionamount", "analysis_hour"):
        assert column in pushed
    assert "Exchange" not in plan


def test_integer_key_filter_is_pushed_without_a_cast(spark, plan_of):
    plan = plan_of(filters.drill_down(readings(spark, SF), "mtrid", "7"))
    assert "EqualTo(l_suppkey,7)" in plan


def test_top_k_is_a_per_task_top_k(spark, plan_of):
    plan = plan_of(rollups.top_entities(readings(spark, SF), READINGS))
    assert "TakeOrderedAndProject" in plan
    assert scans(plan) == ["l_suppkey:bigint,l_quantity:double"]


def test_rollup_reads_two_columns_and_shuffles_once(spark, plan_of):
    plan = plan_of(rollups.total_by(readings(spark, SF), "source_file", "kwh_consumption", 2))
    assert scans(plan) == ["l_quantity:double,l_linestatus:string"]
    assert plan.count("Exchange hashpartitioning") == 1


def test_kpis_do_not_expand_rows(spark, plan_of):
    plan = plan_of(kpis.payments_kpis(payments(spark, SF), PAYMENTS))
    assert "Expand" not in plan and "Join" not in plan
    assert "o_custkey:bigint" in scans(plan)


def test_duplicate_search_never_shuffles_the_table(table, plan_of):
    again = table.unionByName(table.where("event_id % 10 = 0"))
    plan = plan_of(dedupe.drop_copies(again))
    assert "LeftAnti, BuildRight" in plan and "LeftSemi, BuildRight" in plan and "SortMergeJoin" not in plan
    # Only the suspects are shuffled, to be grouped on the full row.
    assert plan.count("Exchange hashpartitioning") == 1


def test_keeping_one_row_per_key_is_an_aggregate(spark, plan_of):
    plan = plan_of(dedupe.keep_one(payments(spark, SF), ["meterno"], "last", ["payment_id"]))
    assert "Window" not in plan and "partial_max_by" in plan


def test_quality_counts_are_one_scan(table, plan_of):
    plan = plan_of(quality.missing_summary(table.select("meterno", "categorycode")))
    assert len(scans(plan)) == 1


# Footers of files are read in Python: `stored_columns` gets names of files there, and no rows.
@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"csv_ingest", "file_inventory", "incremental_ingest", "stored_columns"}))
def test_no_python_and_no_cross_join_in_queries(spark, plan_of, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for word in ("PythonUDF", "ArrowEval", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_preview_bounds_the_scan_of_whole_rows(table, plan_of):
    df = rollups.preview(table, 100, ["event_id"])
    assert df.count() == 100
    plan = plan_of(df)
    assert "TakeOrderedAndProject(limit=100" in plan
    # The subquery that places the last row reads the order column alone.
    assert "event_id:bigint" in scans(plan)
