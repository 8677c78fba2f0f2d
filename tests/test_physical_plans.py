"""What must not be in the plans, and what must."""

import re

import pytest

from fleetstats.catalog import ORACLES, QUERIES, views
from fleetstats.plans import waits

SF = "/root/testdata/sf0.001"
# Queries whose plan is worth a look, without those that run jobs while they are built.
LAZY = [
    "wait_pareto", "top_waits", "reads_by_database", "costly_by_io", "most_expensive_worker_time",
    "worst_procedures", "missing_index_plans", "page_query_stats", "cache_pollution_details",
    "lowest_plan_reuse", "missing_indexes_with_rows", "index_used_flag", "fragmented_indexes",
    "partitioned_tables", "buffer_by_object", "disk_usage_by_index", "last_backup",
    "share_of_segment", "top_orders_per_customer", "aggregate_locks", "oldest_transaction",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_no_python_and_no_window_over_everything(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, bad
    # A window in a single partition is only fine above a limit.
    for m in re.finditer(r"Window \[", plan):
        below = plan[m.start():]
        if "SinglePartition" in below and "hashpartitioning" not in below:
            assert "TakeOrderedAndProject" in below


def test_top_n_is_pruned_before_the_shuffle(spark):
    plan = plan_of(QUERIES["top_orders_per_customer"](spark, SF))
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")


def test_only_needed_columns_and_filters_reach_the_scan(spark):
    from pyspark.sql import functions as F

    plan = plan_of(QUERIES["privileged_logins"](spark, SF))
    assert "c_acctbal" in plan and "PushedFilters" in plan
    read = re.search(r"ReadSchema: (struct<[^>]*>)", plan_of(QUERIES["buffer_by_database"](spark, SF)))[1]
    assert read == "struct<l_suppkey:bigint>"
    snap = views.fleet(spark, SF)
    narrowed = snap.with_tables(wait_stats=snap["wait_stats"].filter(F.col("server_id") == "A"))
    plan = plan_of(waits.wait_pareto(narrowed))
    assert "EqualTo(l_returnflag,A)" in plan


def test_pages_are_counted_per_unit_before_the_joins(spark):
    plan = plan_of(QUERIES["buffer_by_object"](spark, SF))
    lowest_join = max(plan.rfind("SortMergeJoin"), plan.rfind("BroadcastHashJoin"))
    assert "partial_count" in plan[plan.index("lineitem") - 4000 if "lineitem" in plan else lowest_join:]


def test_registry_is_consistent():
    assert set(ORACLES) == set(QUERIES)


def test_texts_and_plans_are_sorted_only_on_demand(spark):
    from fleetstats.plans import plancache, queries

    snap, fleet = views.plan_cache(spark, SF), views.fleet(spark, SF)
    for ordered in (True, False):
        for df in (plancache.cached_queries(snap, ordered=ordered), queries.procedure_profile(fleet, 2, ordered=ordered)):
            assert ("rangepartitioning" in plan_of(df)) == ordered


def test_least_used_plans_learn_from_handles_that_a_text_exists(spark):
    from fleetstats.plans import plancache

    plan = plan_of(plancache.lowest_plan_reuse(views.plan_cache(spark, SF)))
    assert "LeftSemi" in plan


def test_index_details_shuffles_its_indexes_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES["index_details"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # key columns twice, for their types and for their table; tables twice, for their database and for the rest
    assert plan.count("Exchange hashpartitioning") <= 8


def test_disk_usage_by_index_shuffles_its_indexes_once_before_they_are_told_apart(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES["disk_usage_by_index"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # as index_details, and once to tell equal rows
    assert plan.count("Exchange hashpartitioning") <= 9


def test_least_used_plans_are_joined_and_ranked_before_their_statements(spark):
    from fleetstats.plans import plancache

    plan = plan_of(plancache.lowest_plan_reuse(views.plan_cache(spark, SF)))
    assert "min(statement_start_offset" in plan
