"""Where servers spend their waiting time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dec2, idiv
from ..operators import pareto, share_of_total, top_n
from .common import pick, report, scope_of

# Wait types of idle background work.
IDLE_WAITS = (
    "CLR_SEMAPHORE", "LAZYWRITER_SLEEP", "RESOURCE_QUEUE", "SLEEP_TASK", "SLEEP_SYSTEMTASK",
    "SQLTRACE_BUFFER_FLUSH", "WAITFOR", "LOGMGR_QUEUE", "CHECKPOINT_QUEUE",
    "REQUEST_FOR_DEADLOCK_SEARCH", "XE_TIMER_EVENT", "BROKER_TO_FLUSH", "BROKER_TASK_STOP",
    "CLR_MANUAL_EVENT", "CLR_AUTO_EVENT", "DISPATCHER_QUEUE_SEMAPHORE",
    "FT_IFTS_SCHEDULER_IDLE_WAIT", "XE_DISPATCHER_WAIT", "XE_DISPATCHER_JOIN",
)
MORE_IDLE_WAITS = IDLE_WAITS + (
    "SQLTRACE_INCREMENTAL_FLUSH_SLEEP", "ONDEMAND_TASK_QUEUE", "BROKER_EVENTHANDLER",
    "SLEEP_BPOOL_FLUSH",
)


def _by_type(waits: DataFrame, scope) -> DataFrame:
    """One row per wait type and scope. Wait types are a fixed vocabulary of the
    server, so what a window over a scope sees afterwards is bounded."""
    return waits.groupBy(*scope, "wait_type").agg(F.sum("wait_time_ms").alias("wait_time_ms"))


@report
def wait_pareto(snap, *, scope=None, threshold: float = 99, exclude=MORE_IDLE_WAITS) -> DataFrame:
    """Wait types that make up ``threshold`` percent of the time, the crossing one
    included. Percentages are of what is left after the exclusions."""
    scope = scope_of(snap, scope)
    waits = snap["wait_stats"].filter(~F.col("wait_type").isin(*exclude))
    kept = pareto(
        _by_type(waits, scope), "wait_time_ms", ["wait_type"], threshold, scope, small_scopes=True
    )
    return kept.select(
        *scope, "wait_type",
        dec2(F.col("wait_time_ms").cast("decimal(20,0)") / 1000, digits=20).alias("wait_time_s"),
        dec2("pct").alias("pct"),
        dec2("running_pct").alias("running_pct"),
    ).orderBy(*scope, "running_pct", F.desc("pct"), "wait_type")


@report
def wait_pareto_short(snap, *, scope=None, threshold: float = 95, exclude=IDLE_WAITS) -> DataFrame:
    """The same with the shorter exclusion list and a lower cutoff."""
    return wait_pareto(snap, scope=scope, threshold=threshold, exclude=exclude)


@report
def top_waits(snap, *, scope=None, n: int = 10, not_like: str = "%SLEEP%") -> DataFrame:
    """Longest waits with their share of all rows the filter leaves."""
    scope = scope_of(snap, scope)
    waits = _by_type(snap["wait_stats"].filter(~F.col("wait_type").like(not_like)), scope)
    top = top_n(
        share_of_total(waits, "wait_time_ms", scope, "pct_waiting"),
        [F.desc("wait_time_ms"), F.asc("wait_type")], n, scope,
    )
    return pick(
        top.withColumn("wait_time_s", idiv("wait_time_ms", 1000))
        .withColumn("pct_waiting", dec2("pct_waiting"))
        .orderBy(*scope, F.desc("wait_time_ms"), "wait_type"),
        scope, "wait_type", "wait_time_s", "pct_waiting",
    )
