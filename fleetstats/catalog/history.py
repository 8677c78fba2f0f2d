"""Reports over several collections: names as of the counters' time, and growth between collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import intervals as iv, locks as lk, queries as qs
from ..sources import Store, land, publish_landed, scratch_dir
from ..streaming import deltas_stream
from .registry import query
from .reports import stmt, top
from .views import drifting, drifting_sessions, series, spark_view

_TEXT = "ASOF JOIN text_versions t ON t.server_id = s.server_id AND t.sql_handle = s.sql_handle AND s.snapshot_ts >= t.snapshot_ts"
_DATABASE = "ASOF LEFT JOIN database_versions d ON d.server_id = s.server_id AND d.database_id = s.{id} AND s.snapshot_ts >= d.snapshot_ts"
_STATS = ["stats_series", "text_versions", "database_versions"]
_AT_THE_TIME = f"""
    , t AS (SELECT s.*, t.dbid, t.text FROM stats_series s {_TEXT}),
    j AS (SELECT s.*, d.name AS database_name FROM t s {_DATABASE.format(id='dbid')})"""
_ID = "sql_handle, plan_handle, statement_start_offset"
_EACH = "server_id, snapshot_ts"


def _plain_times(df, *more):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("snapshot_ts", *more)})


# --- names as of the counters' time ---------------------------------------------------


@query(_AT_THE_TIME + f"""
    SELECT server_id, snapshot_ts, (total_logical_reads + total_logical_writes) // execution_count AS average_io,
        total_logical_reads + total_logical_writes AS total_io, total_logical_reads AS total_reads,
        total_logical_writes AS total_writes, execution_count, {stmt()} AS individual_query, text AS parent_query, database_name
    FROM j {top(100, f'(total_logical_reads + total_logical_writes) // execution_count DESC, {_ID}', _EACH)}""", _STATS)
def costly_by_io_as_of(spark, sf_dir):
    return _plain_times(qs.costly_by_io(drifting(spark, sf_dir)))


@query(_AT_THE_TIME + f"""
    SELECT * FROM (SELECT server_id, snapshot_ts, sum(total_logical_reads)::BIGINT AS total_reads,
        sum(execution_count)::BIGINT AS execution_count, database_name FROM j GROUP BY ALL) AS g
    {top(10, 'total_reads DESC, database_name NULLS FIRST', _EACH)}""", _STATS)
def reads_by_database_as_of(spark, sf_dir):
    return _plain_times(qs.reads_by_database(drifting(spark, sf_dir)))


_LOCK_VIEWS = ["tran_locks", "waiting_tasks", "sessions", "requests",
               *[f"{v} AS all_{v}" for v in ("text_versions", "plan_versions", "database_versions")]]


@query(f"""
    SELECT d.name AS database_name, s.* EXCLUDE (server_id, snapshot_ts) FROM tran_locks s
    {_DATABASE.format(id='resource_database_id')}""", ["tran_locks", "database_versions AS all_database_versions"])
def examine_locks_as_of(spark, sf_dir):
    return lk.examine_locks(drifting_sessions(spark, sf_dir)).drop("server_id", "snapshot_ts")


@query(f"""
    , q AS (SELECT s.*, t.text, p.query_plan FROM requests s {_TEXT}
        ASOF JOIN plan_versions p ON p.server_id = s.server_id AND p.plan_handle = s.plan_handle AND s.snapshot_ts >= p.snapshot_ts)
    SELECT d.name AS database, s.request_status AS status, bs.host_name AS blocking_host,
        bs.nt_domain || '\\' || bs.nt_user_name AS blocking_user, w.wait_duration_ms / 1000.0 AS wait_s,
        b.text AS blocking_sql_text, b.query_plan AS blocking_query_plan,
        e.text AS executing_sql_text, e.query_plan AS executing_query_plan, s.resource_type,
        s.resource_subtype AS resource_sub_type, s.resource_description, s.request_mode, s.request_type, w.wait_type
    FROM tran_locks s
    JOIN waiting_tasks w ON w.resource_address = s.lock_owner_address
    JOIN sessions bs ON bs.session_id = w.blocking_session_id
    JOIN sessions es ON es.session_id = w.session_id
    JOIN q b ON b.session_id = w.blocking_session_id JOIN q e ON e.session_id = w.session_id
    {_DATABASE.format(id='resource_database_id')}""", _LOCK_VIEWS)
def current_locks_as_of(spark, sf_dir):
    return lk.current_locks(drifting_sessions(spark, sf_dir)).drop("server_id", "snapshot_ts")


# --- growth between collections ---------------------------------------------------------


def _deltas_sql(table, names, counters, at_once):
    """Rows d with each counter's growth since the collection before."""
    by = ", ".join(["server_id", *names])
    fell = " OR ".join(f"{c} < was_{c}" for c in counters)
    restarted = f"bool_or({fell}) OVER (PARTITION BY server_id, snapshot_ts)" if at_once else f"({fell})"
    was = ", ".join(f"lag({c}) OVER w AS was_{c}" for c in counters)
    return f"""
    , l AS (SELECT *, lag(snapshot_ts) OVER w AS since, {was} FROM {table}
        WINDOW w AS (PARTITION BY {by} ORDER BY snapshot_ts)),
    r AS (SELECT *, {restarted} AS restarted FROM l WHERE since IS NOT NULL),
    d AS (SELECT {by}, since, snapshot_ts, epoch(snapshot_ts) - epoch(since) AS seconds, restarted::INT::BIGINT AS restarted,
        {', '.join(f'{c} - CASE WHEN restarted THEN 0 ELSE was_{c} END AS {c}' for c in counters)} FROM r)"""


@query(_deltas_sql("wait_series", *iv.COUNTERS["wait_stats"]) + """
    SELECT *, wait_time_ms / seconds AS wait_ms_per_s FROM d WHERE wait_time_ms > 0""", ["wait_series"])
def waits_per_interval(spark, sf_dir):
    return _plain_times(iv.waits_per_interval(series(spark, sf_dir)), "since")


@query(_deltas_sql("wait_series", *iv.COUNTERS["wait_stats"]) + f"""
    SELECT *, wait_time_ms / seconds AS wait_ms_per_s FROM d WHERE wait_time_ms > 0
    {top(3, 'wait_time_ms DESC, wait_type', 'server_id, since, snapshot_ts')}""", ["wait_series"])
def top_waits_per_interval(spark, sf_dir):
    return _plain_times(iv.waits_per_interval(series(spark, sf_dir), n=3), "since")


@query(_deltas_sql("io_series", *iv.COUNTERS["file_io_stats"]) + """
    SELECT *, CASE WHEN num_of_reads > 0 THEN io_stall_read_ms // num_of_reads END AS avg_read_ms,
        CASE WHEN num_of_writes > 0 THEN io_stall_write_ms // num_of_writes END AS avg_write_ms FROM d""", ["io_series"])
def io_per_interval(spark, sf_dir):
    return _plain_times(iv.io_per_interval(series(spark, sf_dir)), "since")


@query(_deltas_sql("stats_series", *iv.COUNTERS["query_stats"]) + f"""
    SELECT * FROM d WHERE execution_count > 0
    {top(10, f"total_worker_time DESC, {', '.join(iv.COUNTERS['query_stats'][0])}", _EACH)}""", ["stats_series"])
def queries_per_interval(spark, sf_dir):
    return _plain_times(iv.queries_per_interval(series(spark, sf_dir)), "since")


@query(_deltas_sql("usage_series", *iv.COUNTERS["index_usage"]) + """
    SELECT * FROM d WHERE user_seeks + user_scans + user_lookups + user_updates + system_updates > 0""", ["usage_series"])
def index_usage_per_interval(spark, sf_dir):
    return _plain_times(iv.index_usage_per_interval(series(spark, sf_dir)), "since")


@query(_deltas_sql("wait_series", *iv.COUNTERS["wait_stats"]) + """
    SELECT * FROM d WHERE wait_time_ms > 0""", ["wait_series"], "waits_per_interval_stream")
def _waits_per_interval_stream(spark, sf_dir):
    """The collections one after the other, the second twice."""
    waits, out = series(spark, sf_dir)["wait_stats"], scratch_dir(spark, "wait-stream")
    times = [r[0] for r in waits.select("snapshot_ts").distinct().orderBy("snapshot_ts").collect()]
    for at in [*times[:2], *times[1:]]:
        waits.filter(F.col("snapshot_ts") == F.lit(at)).coalesce(1).write.mode("append").parquet(f"{out}/in")
    stream = spark.readStream.schema(waits.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    grown = deltas_stream(stream, ["server_id", "wait_type"], "snapshot_ts", ["wait_time_ms"]).filter("wait_time_ms > 0")
    (grown.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}/state")
     .option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination())
    return _plain_times(spark.read.schema(grown.schema).parquet(f"{out}/rows"), "since")


# --- files of differing columns -----------------------------------------------------------


@query("""
    SELECT server_id, count(*) FILTER (wait_type NOT LIKE '%3') AS n_rows,
        sum(wait_time_ms) FILTER (wait_type NOT LIKE '%3')::BIGINT AS wait_time_ms,
        count(*) FILTER (wait_type LIKE '%3') AS n_rejects, count(*) FILTER (wait_type LIKE '%1') AS n_extras
    FROM wait_stats GROUP BY server_id""", ["wait_stats"])
def landed_waits(spark, sf_dir):
    """A collector that names columns in its own way, adds one, and cannot tell some times."""
    waits, base = spark_view(spark, sf_dir, "wait_stats"), scratch_dir(spark, "landing")
    sent = waits.select(
        F.col("server_id").alias("Server"), F.lit("2024-01-01 12:00:00").alias("SNAPSHOT_TS"), F.col("wait_type").alias("Wait_Type"),
        F.when(F.col("wait_type").like("%3"), "n/a").otherwise(F.col("wait_time_ms").cast("string")).alias("wait_time_ms"),
        F.when(F.col("wait_type").like("%1"), 1).alias("signal_wait_time_ms"))
    publish_landed(spark, {"wait_stats": land(sent, "wait_stats", {"Server": "server_id"})}, base, "first")
    rows = Store(spark, base).frame("wait_stats").groupBy("server_id").agg(F.count("*").alias("n_rows"), F.sum("wait_time_ms").alias("wait_time_ms"))
    aside = f"{base}/aside/first/wait_stats"
    rejects = (spark.read.schema("reasons array<string>, row string").parquet(f"{aside}/rejects")
               .groupBy(F.get_json_object("row", "$.Server").alias("server_id")).agg(F.count("*").alias("n_rejects")))
    extras = spark.read.schema("server_id string, row string").parquet(f"{aside}/extras").groupBy("server_id").agg(F.count("*").alias("n_extras"))
    return rows.join(rejects, "server_id", "left").join(extras, "server_id", "left").fillna(0, ["n_rejects", "n_extras"])
