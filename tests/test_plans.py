"""What the physical plans must and must not contain, whatever the sizes."""

import re

import pytest

from __spark_entry__ import QUERIES, queries

DIRECTORY = "/root/testdata/sf0.001"
# These run jobs of their own while they are built.
EAGER = {"stream_latest_state", "stream_burst_collapse", "stream_outbox", "reconcile_runs", "delivery_run", "content_scan",
         "stream_dedupe_records", "migration_run", "audit_run", "stream_failed_batches", "stream_state_by_batch", "content_scan_whole", "stream_first_arrival", "stream_late_rows", "stream_file_attribution", "stream_process_state", "stream_handle_resolution"}


def plan(spark, name):
    return queries()[name](spark, DIRECTORY)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(params=["10485760", "-1"])
def broadcast_limit(spark, request):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_plan_forms_pairs_or_gathers_everything(spark, broadcast_limit):
    bad = {}
    for name in sorted(set(QUERIES) - EAGER):
        found = re.findall(r"NestedLoopJoin|CartesianProduct|SinglePartition|PythonUDF|ArrowEvalPython", plan(spark, name))
        if found:
            bad[name] = found
    assert bad == {}


def test_comparison_needs_one_shuffle(spark):
    text = plan(spark, "snapshot_diff")
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_scans_read_only_what_is_needed(spark):
    text = plan(spark, "lifecycle_conformance")
    columns = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert {c.split(":")[0] for schema in columns for c in schema.split(",")} == {"o_orderkey", "o_custkey", "o_orderstatus"}
    assert "l_linestatus" in plan(spark, "generation_retention") and "l_extendedprice" not in plan(spark, "generation_retention")


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [In(event_type, [error,signup])]" in plan(spark, "unresolved_gaps") or "EqualTo(event_type" in plan(spark, "unresolved_gaps")


def test_top_n_is_limited_before_the_shuffle(spark):
    for name in ("outbox_ready", "generation_retention", "pending_batch"):
        assert "WindowGroupLimit" in plan(spark, name)


def test_ordered_scan_moves_full_rows_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark, "settings_changes")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The window's partitioning also serves the join with what earlier chunks carry over.
    top = text.split("SortMergeJoin")[1]
    assert top.index("Window") < top.index("Exchange")
