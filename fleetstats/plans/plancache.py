"""What the plan cache holds, and what it wastes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import idiv, int_avg, statement_text
from ..operators import conditional_rollup, lookup, top_n
from .common import database_name, pick, report, scope_of

_MB = 1024.0 * 1024.0


@report
def cache_pollution(snap, *, scope=None) -> DataFrame:
    """Per object type: plans, megabytes, and how much of them was used only once."""
    scope = scope_of(snap, scope)
    rolled = conditional_rollup(
        snap["cached_plans"], [*scope, "objtype"], "size_in_bytes", "usecounts",
        F.col("usecounts") == 1,
    )
    return rolled.select(
        *scope,
        F.col("objtype").alias("cache_type"),
        F.col("n").alias("total_plans"),
        (F.col("amount") / F.lit(_MB)).alias("total_mbs"),
        F.col("avg_uses").alias("avg_use_count"),
        (F.col("amount_if") / F.lit(_MB)).alias("total_mbs_use_1"),
        F.col("n_if").alias("total_plans_use_1"),
        F.col("pct_if").alias("percent_wasted"),
    ).orderBy(*scope, F.desc("total_mbs_use_1"))


@report
def cache_pollution_details(snap, like: str = "%", not_like: str = "%dm_exec%", *, scope=None,
                            order_by: str = "example_statement_text") -> DataFrame:
    """Per object type and query and plan hash: memory, CPU and an example.

    A plan is counted once per statement in it, as its size comes through the join
    with the statements. ``order_by`` may also be ``total_cost``.
    """
    scope = scope_of(snap, scope)
    text = snap["query_text"].filter(F.col("text").like(like) & ~F.col("text").like(not_like))
    stats = snap["query_stats"].select(
        *snap.keys_, "sql_handle", "plan_handle", "query_hash", "query_plan_hash",
        "statement_start_offset", "statement_end_offset", "total_worker_time", "execution_count",
    )
    said = lookup(stats, text, {"sql_handle": "sql_handle"}, {"text": "text"}, snap.keys_, "inner")
    said = said.withColumn(
        "statement", statement_text("text", "statement_start_offset", "statement_end_offset")
    ).drop("text")
    held = lookup(said, snap["cached_plans"], {"plan_handle": "plan_handle"},
                  {"objtype": "objtype", "size_in_bytes": "size_in_bytes"}, snap.keys_, "inner")
    groups = held.groupBy(*snap.keys_, "objtype", "query_hash", "query_plan_hash").agg(
        (F.sum("size_in_bytes") / F.lit(_MB)).alias("total_mb"),
        int_avg(F.sum("total_worker_time"), F.sum("execution_count")).alias("avg_cpu_time"),
        F.sum("execution_count").alias("execution_total"),
        F.sum("total_worker_time").alias("total_cost"),
        F.min("statement").alias("example_statement_text"),
        F.min("plan_handle").alias("plan_handle"),
        F.min("statement_start_offset").alias("statement_start_offset"),
    )
    out = lookup(groups, snap["query_plan"], {"plan_handle": "plan_handle"},
                 {"query_plan": "query_plan"}, snap.keys_, "inner")
    order = F.desc(order_by) if order_by == "total_cost" else F.asc(order_by)
    out = out.orderBy(*scope, order, "objtype", "query_hash", "query_plan_hash")
    return pick(out, snap, *groups.columns[len(snap.keys_):], "query_plan")


@report
def one_time_queries(snap, *, scope=None, n: int = 100) -> DataFrame:
    """Largest ad hoc plans that were used once, cursor fetches left out. Sizes are
    whole kilobytes, and ranked as such."""
    scope = scope_of(snap, scope)
    once = snap["cached_plans"].filter(
        (F.col("cacheobjtype") == "Compiled Plan")
        & (F.col("objtype") == "Adhoc")
        & (F.col("usecounts") == 1)
    ).select(*snap.keys_, "plan_handle", "refcounts", "usecounts",
             idiv("size_in_bytes", 1024).alias("size_kb"))
    text = snap["query_text"].filter(~F.col("text").like("FETCH API_CURSOR%"))
    told = lookup(once, text, {"plan_handle": "plan_handle"}, {}, snap.keys_, "left_semi")
    top = top_n(told, [F.desc("size_kb"), F.asc("plan_handle")], n, scope)
    out = lookup(top, snap["query_text"], {"plan_handle": "plan_handle"}, {"text": "text"},
                 snap.keys_, "inner").orderBy(*scope, F.desc("size_kb"), "plan_handle")
    return pick(out, snap, "refcounts", "usecounts", "size_kb", "text")


@report
def cached_queries(snap, *, scope=None, ordered: bool = True) -> DataFrame:
    """Every cached plan with text and plan, most referenced and largest first.

    The sort moves every text and plan; without ``ordered`` the rows come as they lie, which
    suits a report that is written to a table.
    """
    plans = snap["cached_plans"].select(
        *snap.keys_, "plan_handle", "refcounts", "size_in_bytes", "cacheobjtype"
    )
    on = {"plan_handle": "plan_handle"}
    out = lookup(plans, snap["query_text"], on, {"encrypted": "encrypted", "text": "text"},
                 snap.keys_, "inner")
    out = lookup(out, snap["query_plan"], on, {"query_plan": "query_plan"}, snap.keys_, "inner")
    if ordered:
        out = out.orderBy(*scope_of(snap, scope), F.desc("refcounts"), F.desc("size_in_bytes"),
                          "plan_handle")
    return pick(out, snap, "refcounts", "size_in_bytes", "cacheobjtype", "encrypted", "text",
                "query_plan")


@report
def lowest_plan_reuse(snap, *, scope=None, n: int = 100) -> DataFrame:
    """Statements whose plan was used least."""
    scope = scope_of(snap, scope)
    stats = snap["query_stats"].select(
        *snap.keys_, "sql_handle", "plan_handle", "statement_start_offset", "statement_end_offset"
    )
    # the first n statements are among those of the first n plans, told by their earliest statement:
    # plans are joined and ranked, and only those that are left ask for their statements
    handles = stats.groupBy(*snap.keys_, "sql_handle", "plan_handle").agg(
        F.max(F.col("statement_start_offset").isNull()).alias("_none"), F.min("statement_start_offset").alias("_first"))
    # that a text exists is learnt per handle, not per statement
    told = lookup(handles, snap["query_text"], {"sql_handle": "sql_handle"}, {}, snap.keys_, "left_semi")
    held = lookup(told, snap["cached_plans"], {"plan_handle": "plan_handle"},
                  {"usecounts": "plan_usage", "cacheobjtype": "cacheobjtype"}, snap.keys_, "inner")
    order = [F.asc("plan_usage"), "sql_handle", "plan_handle"]
    least = top_n(held, [*order, F.desc("_none"), "_first"], n, scope).drop("_none", "_first")
    offsets = ("statement_start_offset", "statement_end_offset")
    said = lookup(least, stats, {"sql_handle": "sql_handle", "plan_handle": "plan_handle"},
                  {c: c for c in offsets}, snap.keys_, "inner")
    top = top_n(said, [*order, "statement_start_offset"], n, scope)
    out = lookup(top, snap["query_text"], {"sql_handle": "sql_handle"},
                 {"text": "parent_query", "dbid": "dbid"}, snap.keys_, "inner")
    out = database_name(out, snap, "dbid").withColumn(
        "individual_query",
        statement_text("parent_query", "statement_start_offset", "statement_end_offset"),
    ).orderBy(*scope, "plan_usage", "sql_handle", "plan_handle", "statement_start_offset")
    return pick(out, snap, "plan_usage", "individual_query", "parent_query", "database_name",
                "cacheobjtype")
