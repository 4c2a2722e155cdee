"""Shape of the physical plans: pushdown, pruning, no cross joins, Python only where it is meant to be."""

import re

import pytest

from logtide.plans import catalog

QUERIES = catalog.queries()  # the corpus queries run jobs while they build their result and have tests of their own
# Queries that fit a model or run a stream while they build their result.
EAGER = {n for n in QUERIES if n.startswith(("stream_", "iforest_", "model_"))} | {
    "detect_and_dedup", "detect_and_dedup_fixed", "write_read_daily", "export_ndjson", "eval_report", "read_eval_csv", "scale_features",
}
PYTHON = {"dedup", "history", "stats_unique", "unique_alerts", "sent_by_channel", "suppression", "outbox", "mail", "chat", "serialise"}


def plan(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_plan(spark, small_dir, name):
    text = plan(spark, small_dir, name)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if re.search(r"ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas", text):
        assert any(p in name for p in PYTHON), name


def test_time_filter_reaches_the_scan(spark, small_dir):
    text = plan(spark, small_dir, "search_logs")
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts,2024-01-05", text)


def test_scan_reads_only_needed_columns(spark, small_dir):
    text = plan(spark, small_dir, "rolling_request_count")
    assert all("value" not in schema for schema in re.findall(r"ReadSchema: (struct<[^>]*>)", text))


def test_top_k_is_not_a_full_sort(spark, small_dir):
    assert "TakeOrderedAndProject" in plan(spark, small_dir, "latest_logs")


def test_counts_combine_before_the_shuffle(spark, small_dir):
    assert "partial_count" in plan(spark, small_dir, "count_by_service")
    assert "partial_count" in plan(spark, small_dir, "rolling_request_count")
