"""Which statements cost most.

Ranking needs only counters and the narrow columns of the text table, so the
reports rank first and fetch the wide text and plan of the rows that are left.
``query_text`` has one row per handle that was looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import (
    account, idiv, index_hints, int_avg, statement_text,
)
from ..operators import lookup, page, top_n
from .common import database_name, only_database, pick, report, scope_of

_IDENTITY = ("sql_handle", "plan_handle", "statement_start_offset")
_OFFSETS = ("statement_start_offset", "statement_end_offset")


def _with_text_ids(df: DataFrame, snap, *extra, on: str = "sql_handle",
                   text: DataFrame | None = None) -> DataFrame:
    """Rows whose handle has a text, with its database and other narrow columns."""
    take = {c: c for c in ("dbid", *extra)}
    return lookup(df, snap["query_text"] if text is None else text, {on: on}, take,
                  snap.keys_, "inner")


def _with_text(df: DataFrame, snap, name: str = "text", on: str = "sql_handle",
               how: str = "inner") -> DataFrame:
    return lookup(df, snap["query_text"], {on: on}, {"text": name}, snap.keys_, how)


def _statements(ranked: DataFrame, snap, scope, order, *cols, named: bool = False) -> DataFrame:
    """Fetch text for ranked rows and lay out the usual columns."""
    out = _with_text(ranked, snap, "parent_query")
    out = out.withColumn("individual_query", statement_text("parent_query", *_OFFSETS))
    if not named:
        out = database_name(out, snap, "dbid")
    out = out.orderBy(*scope_of(snap, scope), order, *_IDENTITY)
    return pick(out, snap, *cols, "individual_query", "parent_query", "database_name")


def _by_database(snap, scope, counter: str, name: str, n: int) -> DataFrame:
    scope = scope_of(snap, scope)
    # Per handle first: a handle has as many rows as statements and plans.
    per_text = snap["query_stats"].groupBy(*snap.keys_, "sql_handle").agg(
        F.sum(counter).alias(name), F.sum("execution_count").alias("execution_count")
    )
    named = database_name(_with_text_ids(per_text, snap), snap, "dbid")
    sums = named.groupBy(*scope, "database_name").agg(
        F.sum(name).alias(name), F.sum("execution_count").alias("execution_count")
    )
    order = [F.desc(name), F.asc_nulls_first("database_name")]
    return pick(
        top_n(sums, order, n, scope), scope, name, "execution_count", "database_name"
    ).orderBy(*scope, *order)


@report
def reads_by_database(snap, *, scope=None, n: int = 10) -> DataFrame:
    """Logical reads per database; statements without one form their own group."""
    return _by_database(snap, scope, "total_logical_reads", "total_reads", n)


@report
def writes_by_database(snap, *, scope=None, n: int = 10) -> DataFrame:
    """Logical writes per database."""
    return _by_database(snap, scope, "total_logical_writes", "total_writes", n)


def _ranked(snap, scope, df: DataFrame, order: Column, n: int) -> DataFrame:
    return top_n(_with_text_ids(df, snap), [order, *_IDENTITY], n, scope_of(snap, scope))


@report
def costly_by_io(snap, *, scope=None, n: int = 100, order_by: str = "average_io") -> DataFrame:
    """Statements by logical reads and writes per execution."""
    stats = (
        snap["query_stats"]
        .withColumn("total_io", F.col("total_logical_reads") + F.col("total_logical_writes"))
        .withColumn("average_io", int_avg("total_io", "execution_count"))
        .withColumn("total_reads", F.col("total_logical_reads"))
        .withColumn("total_writes", F.col("total_logical_writes"))
        .select(*snap.keys_, *_IDENTITY, "statement_end_offset", "average_io", "total_io",
                "total_reads", "total_writes", "execution_count")
    )
    order = F.desc(order_by)
    top = _ranked(snap, scope, stats, order, n)
    return _statements(top, snap, scope, order, "average_io", "total_io", "total_reads", "total_writes", "execution_count"
    )


@report
def costly_by_cpu(snap, *, scope=None, n: int = 50, order_by: str = "total_cpu") -> DataFrame:
    """Statements by CPU time; ``order_by`` may also be ``average_cpu``."""
    stats = (
        snap["query_stats"]
        .withColumn("total_cpu", F.col("total_worker_time"))
        .withColumn("average_cpu", int_avg("total_worker_time", "execution_count"))
        .select(*snap.keys_, *_IDENTITY, "statement_end_offset", "average_cpu", "total_cpu",
                "execution_count")
    )
    order = F.desc(order_by)
    top = _ranked(snap, scope, stats, order, n)
    return _statements(top, snap, scope, order, "average_cpu", "total_cpu", "execution_count")


@report
def costly_clr(snap, *, scope=None, n: int = 100) -> DataFrame:
    """Statements by time in managed code per execution."""
    stats = (
        snap["query_stats"].filter(F.col("total_clr_time") != 0)
        .withColumn("average_clr_time", int_avg("total_clr_time", "execution_count"))
        .select(*snap.keys_, *_IDENTITY, "statement_end_offset", "average_clr_time",
                "total_clr_time", "execution_count")
    )
    order = F.desc("average_clr_time")
    top = _ranked(snap, scope, stats, order, n)
    return _statements(top, snap, scope, order, "average_clr_time", "total_clr_time", "execution_count")


@report
def most_executed(snap, *, scope=None, n: int = 10) -> DataFrame:
    """Statements by executions, of databases with a name other than msdb."""
    stats = snap["query_stats"].select(
        *snap.keys_, *_IDENTITY, "statement_end_offset", "execution_count"
    )
    named = database_name(_with_text_ids(stats, snap), snap, "dbid").filter(
        ~F.coalesce(F.col("database_name"), F.lit("")).isin("", "msdb")
    )
    order = F.desc("execution_count")
    top = top_n(named, [order, *_IDENTITY], n, scope_of(snap, scope))
    return _statements(top, snap, scope, order, "dbid", "execution_count", named=True)


@report
def most_blocked(snap, *, scope=None, n: int = 100) -> DataFrame:
    """Statements by the time they neither ran nor were finished, per execution."""
    stats = (
        snap["query_stats"]
        .withColumn("total_time_blocked", F.col("total_elapsed_time") - F.col("total_worker_time"))
        .withColumn("average_time_blocked", int_avg("total_time_blocked", "execution_count"))
        .select(*snap.keys_, *_IDENTITY, "statement_end_offset", "average_time_blocked",
                "total_time_blocked", "execution_count")
    )
    order = F.desc("average_time_blocked")
    top = _ranked(snap, scope, stats, order, n)
    return _statements(top, snap, scope, order, "average_time_blocked", "total_time_blocked", "execution_count"
    )


@report
def most_expensive(snap, *, scope=None, n: int = 10, by: str = "logical_reads") -> DataFrame:
    """Statements by total ``logical_reads``, ``logical_writes`` or ``worker_time``,
    with their plan. Statements without a text or plan are left out."""
    if by not in ("logical_reads", "logical_writes", "worker_time"):
        raise ValueError(f"cannot rank by {by}")
    counters = [
        f"{part}_{what}"
        for what in ("logical_reads", "logical_writes", "worker_time")
        for part in ("total", "last")
    ]
    stats = snap["query_stats"].select(
        *snap.keys_, *_IDENTITY, "statement_end_offset", "execution_count", *counters,
        idiv("total_elapsed_time", 1_000_000).alias("total_elapsed_time_s"),
        idiv("last_elapsed_time", 1_000_000).alias("last_elapsed_time_s"),
        "last_execution_time",
    )
    planned = lookup(
        stats, snap["query_plan"], {"plan_handle": "plan_handle"}, {}, snap.keys_, "left_semi"
    )
    top = _ranked(snap, scope, planned, F.desc(f"total_{by}"), n)
    out = lookup(
        _with_text(top, snap), snap["query_plan"], {"plan_handle": "plan_handle"},
        {"query_plan": "query_plan"}, snap.keys_, "inner",
    ).withColumn("statement_text", statement_text("text", *_OFFSETS)).orderBy(
        *scope_of(snap, scope), F.desc(f"total_{by}"), *_IDENTITY
    )
    return pick(
        out, snap, "statement_text", "execution_count", *counters, "total_elapsed_time_s",
        "last_elapsed_time_s", "last_execution_time", "query_plan",
    )


@report
def worst_procedures(snap, *, scope=None, database_id=None, n: int = 100) -> DataFrame:
    """Statements of known objects by average CPU time, the first ``n`` of each
    database. Times are in milliseconds: per execution first, then by 1000."""
    scope = scope_of(snap, scope)

    def millis(col):
        return idiv(col, 1000)

    stats = snap["query_stats"].select(
        *snap.keys_, *_IDENTITY, "statement_end_offset", "creation_time", "last_execution_time",
        millis("total_worker_time").alias("total_cpu_time"),
        millis(int_avg("total_worker_time", "execution_count")).alias("avg_cpu_time"),
        millis("min_worker_time").alias("min_cpu_time"),
        millis("max_worker_time").alias("max_cpu_time"),
        millis("last_worker_time").alias("last_cpu_time"),
        millis("total_elapsed_time").alias("total_time_elapsed"),
        millis(int_avg("total_elapsed_time", "execution_count")).alias("avg_time_elapsed"),
        millis("min_elapsed_time").alias("min_time_elapsed"),
        millis("max_elapsed_time").alias("max_time_elapsed"),
        int_avg("total_physical_reads", "execution_count").alias("avg_physical_reads"),
        int_avg("total_logical_reads", "execution_count").alias("avg_logical_reads"),
        "execution_count",
        int_avg("total_worker_time", "execution_count").alias("_avg_cpu"),
    )
    text = only_database(snap["query_text"], database_id, "dbid")
    known = lookup(
        _with_text_ids(stats, snap, "objectid", text=text),
        only_database(snap["objects"], database_id),
        {"dbid": "database_id", "objectid": "object_id"}, {"name": "object_name"},
        snap.keys_, "inner",
    )
    top = top_n(known, [F.desc("_avg_cpu"), *_IDENTITY], n, [*scope, "dbid"])
    out = database_name(_with_text(top, snap), snap, "dbid").withColumn(
        "statement_text", statement_text("text", *_OFFSETS)
    ).orderBy(*scope, "database_name", F.desc("_avg_cpu"), *_IDENTITY)
    cols = [c for c in stats.columns
            if c not in (*_IDENTITY, *_OFFSETS, *snap.keys_, "_avg_cpu")]
    return pick(out, snap, "database_name", "object_name", *cols, "statement_text")


@report
def procedure_profile(snap, database_id=None, *, scope=None, object_name: str | None = None,
                      ordered: bool = True) -> DataFrame:
    """Smallest, largest, average and last value of each counter per statement of
    one database, slowest first, or as they lie without ``ordered``, which spares a sort of all texts."""
    counters = ("worker_time", "physical_reads", "logical_reads", "logical_writes", "elapsed_time")
    profile = []
    for c in counters:
        profile += [
            F.col(f"min_{c}"), F.col(f"max_{c}"),
            int_avg(f"total_{c}", "execution_count").alias(f"avg_{c}"), F.col(f"last_{c}"),
        ]
    stats = snap["query_stats"].select(
        *snap.keys_, "sql_handle", *_OFFSETS, "execution_count", *profile
    )
    text = only_database(snap["query_text"], database_id, "dbid")
    out = lookup(
        _with_text_ids(stats, snap, "objectid", "text", text=text), snap["objects"],
        {"dbid": "database_id", "objectid": "object_id"}, {"name": "object_name"}, snap.keys_,
    )
    if object_name is not None:
        out = out.filter(F.col("object_name") == object_name)
    out = out.withColumn("sql_stmt", statement_text("text", *_OFFSETS, zero_end_is_open=True))
    if ordered:
        out = out.orderBy(*scope_of(snap, scope), F.desc("avg_elapsed_time"), "sql_handle", *_OFFSETS)
    names = [f"{p}_{c}" for c in counters for p in ("min", "max", "avg", "last")]
    return pick(out, snap, "execution_count", "object_name", *names, "sql_stmt")


def _has(name: str):
    return lambda hint: hint[name].isNotNull()


@report
def missing_index_plans(snap, *, scope=None) -> DataFrame:
    """Statements whose plan asks for an index in a database other than "m", by
    impact times executions. Plans are parsed before the join, not once for each statement."""
    documents = snap["query_plan"].filter(F.contains(F.col("query_plan"), F.lit("MissingIndex")))
    # a generator keeps what was parsed apart from the filter, which would parse again
    plans = documents.select(
        *snap.keys_, "plan_handle", F.explode(F.array(index_hints("query_plan"))).alias("_hints")
    ).filter(F.exists("_hints", lambda h: h["database"] != "m"))
    first = {c: F.get(F.filter("_hints", _has(c)), F.lit(0))[c] for c in ("impact", "database", "table")}
    plans = plans.withColumns(first).drop("_hints")
    stats = snap["query_stats"].select(
        *snap.keys_, "sql_handle", "plan_handle", *_OFFSETS, "execution_count",
        int_avg("total_worker_time", "execution_count").alias("avg_cpu"),
        int_avg("total_elapsed_time", "execution_count").alias("avg_duration"),
        int_avg(
            F.col("total_logical_reads") + F.col("total_physical_reads"), "execution_count"
        ).alias("avg_reads"),
    )
    hinted = lookup(
        stats, plans, {"plan_handle": "plan_handle"},
        {c: c for c in first}, snap.keys_, "inner",
    )
    # the documents of the statements that are left come last
    hinted = lookup(_with_text(hinted, snap), documents, {"plan_handle": "plan_handle"}, {"query_plan": "query_plan"},
                    snap.keys_, "inner")
    out = (
        hinted
        .withColumn("statement_text", statement_text("text", *_OFFSETS))
        .withColumn("total_impact", F.col("impact") * F.col("execution_count"))
        .orderBy(*scope_of(snap, scope), F.desc("total_impact"), "sql_handle", "plan_handle", *_OFFSETS)
    )
    return pick(
        out, snap, "query_plan", "avg_cpu", "avg_duration", "avg_reads", "execution_count",
        "statement_text", "total_impact", "database", "table",
    )


def cached_text(snap) -> DataFrame:
    """Executions and elapsed time next to every text that is not encrypted."""
    text = snap["query_text"].filter(~F.col("encrypted"))
    stats = snap["query_stats"].select(
        *snap.keys_, "sql_handle", "execution_count", "total_elapsed_time"
    )
    out = lookup(stats, text, {"sql_handle": "sql_handle"}, {"text": "text"}, snap.keys_, "inner")
    return pick(out, snap, "execution_count", "text", "total_elapsed_time")


@report
def page_query_stats(snap, *, scope=None, page_number: int = 2, size: int = 10,
                     details: bool = False) -> DataFrame:
    """One page of query statistics, newest plan first, with row number and total.
    ``details`` adds the counters and the statement."""
    scope = scope_of(snap, scope)
    counters = ["last_execution_time", "total_physical_reads", "total_logical_reads",
                "total_logical_writes", "execution_count", "total_worker_time",
                "total_elapsed_time"]
    narrow = [*snap.keys_, *_IDENTITY, "creation_time"]
    stats = snap["query_stats"].select(
        *narrow, *(["statement_end_offset", *counters] if details else [])
    )
    rows = page(
        _with_text_ids(stats, snap), [F.desc("creation_time"), *_IDENTITY], page_number, size, scope
    )
    if not details:
        return pick(rows, snap, "creation_time", "row_number", "total_hits")
    rows = (
        _with_text(rows, snap)
        .withColumn("avg_elapsed_time", int_avg("total_elapsed_time", "execution_count"))
        .withColumn("statement_text", statement_text("text", *_OFFSETS))
    )
    return pick(rows, snap, "creation_time", "row_number", "total_hits", *counters,
                "avg_elapsed_time", "statement_text")


@report
def running_queries(snap, exclude_session=None, *, scope=None) -> DataFrame:
    """Requests in progress with text and plan, longest first, without the
    collector's own session."""
    req = snap["requests"]
    if exclude_session is not None:
        req = req.filter(F.col("session_id") != exclude_session)
    req = req.select(
        *snap.keys_, "session_id", "database_id", F.col("command"), F.col("status"), "cpu_time",
        F.col("total_elapsed_time").alias("elapsed_time"), "sql_handle", "plan_handle",
    )
    ses = lookup(
        req, snap["sessions"].withColumn("user", account("nt_domain", "nt_user_name")),
        {"session_id": "session_id"},
        {"host_name": "host", "user": "user", "deadlock_priority": "deadlock_priority"},
        snap.keys_, "inner",
    )
    out = _with_text(ses, snap, "sql_text")
    out = lookup(out, snap["query_plan"], {"plan_handle": "plan_handle"},
                 {"query_plan": "query_plan"}, snap.keys_, "inner")
    out = database_name(out, snap).orderBy(
        *scope_of(snap, scope), F.desc("elapsed_time"), F.desc("cpu_time"), "session_id"
    )
    return pick(out, snap, "session_id", "database_name", "host", "user", "command", "status",
                "deadlock_priority", "cpu_time", "elapsed_time", "sql_text", "query_plan")
