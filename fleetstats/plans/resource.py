"""Resource percentages of cloud databases over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import row_max
from ..operators import fit_ratio, top_n
from .common import pick, report, scope_of

FIT_COLUMNS = {
    "avg_cpu_percent": "cpu_fit",
    "avg_log_write_percent": "log_write_fit",
    "avg_data_io_percent": "data_read_fit",
}


def _recent(df: DataFrame, minutes: int | None, now) -> DataFrame:
    """Rows that ended in the last ``minutes`` before ``now`` (a literal or column)."""
    if minutes is None:
        return df
    now = F.col("snapshot_ts") if now is None else F.lit(now)
    since = F.timestamp_add("MINUTE", F.lit(-minutes), now.cast("timestamp"))
    return df.filter(F.col("end_time") >= since)


@report
def latest_resource(snap, *, scope=None, n: int = 10, last_minutes: int | None = None,
                    now=None) -> DataFrame:
    """Newest ``n`` rows, optionally of the last minutes only."""
    scope = scope_of(snap, scope)
    df = _recent(snap["db_resource_stats"], last_minutes, now)
    others = [c for c in df.columns if c not in ("end_time", *scope)]
    order = [F.desc("end_time"), *others]
    return top_n(df, order, n, scope).orderBy(*scope, *order)


@report
def resource_fit(snap, *, scope=None, limit: float = 80, last_minutes: int | None = None,
                 now=None) -> DataFrame:
    """Fraction, 0 to 1, of the rows in which CPU, log writes and data reads stayed
    within ``limit`` percent."""
    df = _recent(snap["db_resource_stats"], last_minutes, now)
    return fit_ratio(df, FIT_COLUMNS, limit, scope_of(snap, scope))


@report
def dtu_percent(snap, database: str | None = None, *, scope=None) -> DataFrame:
    """The highest of the three percentages in each row of a database, newest first."""
    df = snap["resource_stats"]
    if database is not None:
        df = df.filter(F.col("database_name") == database)
    out = df.withColumn(
        "avg_dtu_percent",
        row_max("avg_cpu_percent", "avg_data_io_percent", "avg_log_write_percent"),
    ).orderBy(*scope_of(snap, scope), F.desc("end_time"), "start_time", "database_name")
    return pick(out, snap, "start_time", "end_time", "avg_dtu_percent")
