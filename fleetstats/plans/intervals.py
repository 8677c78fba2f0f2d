"""What happened between collections: the growth of counters that servers add up since their start."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import idiv
from ..operators import deltas, top_n
from .common import scope_of

_WORK = ("total_worker_time", "total_elapsed_time", "total_physical_reads", "total_logical_reads",
         "total_logical_writes")
#: Of each table: what tells its counters apart beside the server, the counters, and whether a
#: restart of the server resets all of them, or single ones are reset, as for a plan that is compiled again.
COUNTERS = {
    "wait_stats": (("wait_type",), ("wait_time_ms",), True),
    "file_io_stats": (("database_id", "file_id"),
                      ("num_of_reads", "num_of_writes", "io_stall_read_ms", "io_stall_write_ms"), True),
    "index_usage": (("database_id", "object_id", "index_id"),
                    ("user_seeks", "user_scans", "user_lookups", "user_updates", "system_updates"), True),
    "query_stats": (("sql_handle", "plan_handle", "statement_start_offset", "statement_end_offset"),
                    ("execution_count", *_WORK), False),
}


def per_interval(snap, table: str) -> DataFrame:
    """A table's counters by interval: from one collection of a counter to the next."""
    names, counters, at_once = COUNTERS[table]
    server = [k for k in snap.keys_ if k != "snapshot_ts"]
    return deltas(snap[table], [*server, *names], "snapshot_ts", counters, together=server if at_once else None)


def waits_per_interval(snap, *, n: int | None = None) -> DataFrame:
    """Waiting time of each interval, of all wait types or the ``n`` longest, in ms and per second."""
    grown = per_interval(snap, "wait_stats").filter(F.col("wait_time_ms") > 0)
    if n is not None:
        server = [k for k in snap.keys_ if k != "snapshot_ts"]
        grown = top_n(grown, [F.desc("wait_time_ms"), "wait_type"], n, [*server, "since", "snapshot_ts"])
    return grown.withColumn("wait_ms_per_s", F.col("wait_time_ms") / F.col("seconds"))


def io_per_interval(snap) -> DataFrame:
    """Reads and writes of each file in each interval and how long one took, truncated; without I/O, NULL."""
    grown = per_interval(snap, "file_io_stats")
    return grown.withColumn("avg_read_ms", F.when(F.col("num_of_reads") > 0, idiv("io_stall_read_ms", "num_of_reads"))).withColumn(
        "avg_write_ms", F.when(F.col("num_of_writes") > 0, idiv("io_stall_write_ms", "num_of_writes")))


def queries_per_interval(snap, *, scope=None, n: int = 10, order_by: str = "total_worker_time") -> DataFrame:
    """Statements that cost most in each interval."""
    grown = per_interval(snap, "query_stats").filter(F.col("execution_count") > 0)
    order = [F.desc(order_by), *COUNTERS["query_stats"][0]]
    return top_n(grown, order, n, scope_of(snap, scope))


def index_usage_per_interval(snap) -> DataFrame:
    """Indexes that were read or written in each interval."""
    used = sum((F.col(c) for c in COUNTERS["index_usage"][1]), F.lit(0))
    return per_interval(snap, "index_usage").filter(used > 0)
