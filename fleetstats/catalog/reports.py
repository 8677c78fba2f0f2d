"""Waits, queries, plan cache, indexes, files, memory, disk, backups, resources."""

from __future__ import annotations


from ..plans import (
    backups as bk, indexes as ix, inventory as inv, memory_io as mem, plancache as pc,
    queries as qs, resource as rs, storage as st, waits as wt,
)
from .registry import query
from .views import backups, collections, fleet, plan_cache

_IDLE = ("Brand#3", "Brand#14", "Brand#25")


def stmt(text="text", start="statement_start_offset", end="statement_end_offset") -> str:
    return (
        f"substr({text}, {start} // 2 + 1, "
        f"((CASE WHEN {end} = -1 THEN 2 * length({text}) ELSE {end} END) - {start}) // 2 + 1)"
    )


def pct(part, whole) -> str:
    return f"CAST({part} AS DOUBLE) * CAST(100 AS DOUBLE) / CAST({whole} AS DOUBLE)"


def top(n: int, order: str, per: str = "server_id") -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY {per} ORDER BY {order}) <= {n}"


# --- waits ---------------------------------------------------------------------


def _pareto_sql(threshold, extra=""):
    return f"""
    SELECT server_id, wait_type, (wait_time_ms + 5) // 10 / 100.0 AS wait_time_s,
        round({pct('wait_time_ms', 'total')}, 2) AS pct, round({pct('run', 'total')}, 2) AS running_pct
    FROM (SELECT *, sum(wait_time_ms) OVER (PARTITION BY server_id) AS total,
              sum(wait_time_ms) OVER (PARTITION BY server_id ORDER BY wait_time_ms DESC, wait_type
                  ROWS UNBOUNDED PRECEDING) AS run
          FROM wait_stats {extra}) AS r
    WHERE {pct('run - wait_time_ms', 'total')} < {threshold}"""


@query(_pareto_sql(99, f"WHERE wait_type NOT IN {_IDLE}"), ["wait_stats"])
def wait_pareto(spark, sf_dir):
    return wt.wait_pareto(fleet(spark, sf_dir), exclude=_IDLE)


@query(_pareto_sql(95), ["wait_stats"])
def wait_pareto_short(spark, sf_dir):
    return wt.wait_pareto_short(fleet(spark, sf_dir))


def _named(spark, sf_dir):
    snap = fleet(spark, sf_dir)
    return snap.with_tables(wait_stats=snap["named_waits"])


@query(_pareto_sql(99, f"WHERE wait_type NOT IN {wt.MORE_IDLE_WAITS}"), ["wait_stats AS named_waits"])
def wait_pareto_idle_left_out(spark, sf_dir):
    return wt.wait_pareto(_named(spark, sf_dir))


@query(_pareto_sql(95, f"WHERE wait_type NOT IN {wt.IDLE_WAITS}"), ["wait_stats AS named_waits"])
def wait_pareto_short_idle_left_out(spark, sf_dir):
    return wt.wait_pareto_short(_named(spark, sf_dir))


@query(f"""
    SELECT server_id, wait_type, wait_time_ms // 1000 AS wait_time_s,
        round({pct('wait_time_ms', 'sum(wait_time_ms) OVER (PARTITION BY server_id)')}, 2)
            AS pct_waiting
    FROM wait_stats WHERE wait_type NOT LIKE '%2%'
    {top(10, 'wait_time_ms DESC, wait_type')}""", ["wait_stats"])
def top_waits(spark, sf_dir):
    return wt.top_waits(fleet(spark, sf_dir), not_like="%2%")


@query(_pareto_sql(99, f"WHERE wait_type NOT IN {_IDLE}"), ["wait_stats"])
def wait_pareto_newest(spark, sf_dir):
    return wt.wait_pareto(collections(spark, sf_dir), scope=["server_id"], exclude=_IDLE)


@query(f"""
    SELECT wait_type, sum(wait_time_ms)::BIGINT // 1000 AS wait_time_s,
        round({pct('sum(wait_time_ms)', 'sum(sum(wait_time_ms)) OVER ()')}, 2) AS pct_waiting
    FROM wait_stats WHERE wait_type NOT LIKE '%2%' GROUP BY wait_type
    ORDER BY sum(wait_time_ms) DESC, wait_type LIMIT 10""", ["wait_stats"])
def top_waits_fleet(spark, sf_dir):
    return wt.top_waits(collections(spark, sf_dir), scope=(), not_like="%2%")


# --- queries -------------------------------------------------------------------

_STATS = ["query_stats", "query_text", "databases"]
_JOINED = """, j AS (
    SELECT s.*, t.dbid, t.objectid, t.text, t.encrypted, d.name AS database_name
    FROM query_stats s JOIN query_text t ON s.server_id = t.server_id AND s.sql_handle = t.sql_handle
    LEFT JOIN databases d ON d.server_id = t.server_id AND d.database_id = t.dbid)
"""
_ID = "sql_handle, plan_handle, statement_start_offset"
_QUERY = f"{stmt()} AS individual_query, text AS parent_query, database_name"


def _by_db(counter, name):
    return _JOINED + f"""
    SELECT * FROM (SELECT server_id, sum({counter})::BIGINT AS {name},
        sum(execution_count)::BIGINT AS execution_count, database_name
        FROM j GROUP BY server_id, database_name) AS g
    {top(10, f'{name} DESC, database_name NULLS FIRST')}"""


@query(_by_db("total_logical_reads", "total_reads"), _STATS)
def reads_by_database(spark, sf_dir):
    return qs.reads_by_database(fleet(spark, sf_dir))


@query(_by_db("total_logical_reads", "total_reads"), _STATS)
def reads_by_database_newest(spark, sf_dir):
    return qs.reads_by_database(collections(spark, sf_dir), scope=["server_id"])


@query(_by_db("total_logical_writes", "total_writes"), _STATS)
def writes_by_database(spark, sf_dir):
    return qs.writes_by_database(fleet(spark, sf_dir))


@query(_JOINED + f"""
    SELECT server_id, (total_logical_reads + total_logical_writes) // execution_count AS average_io,
        total_logical_reads + total_logical_writes AS total_io, total_logical_reads AS total_reads,
        total_logical_writes AS total_writes, execution_count, {_QUERY}
    FROM j {top(100, f'(total_logical_reads + total_logical_writes) // execution_count DESC, {_ID}')}""",
    _STATS)
def costly_by_io(spark, sf_dir):
    return qs.costly_by_io(fleet(spark, sf_dir))


@query(_JOINED + f"""
    SELECT server_id, (total_logical_reads + total_logical_writes) // execution_count AS average_io,
        total_logical_reads + total_logical_writes AS total_io, total_logical_reads AS total_reads,
        total_logical_writes AS total_writes, execution_count, {_QUERY}
    FROM j {top(100, f'total_logical_reads + total_logical_writes DESC, {_ID}')}""", _STATS)
def costly_by_total_io(spark, sf_dir):
    return qs.costly_by_io(fleet(spark, sf_dir), order_by="total_io")


@query(_JOINED + f"""
    SELECT server_id, total_worker_time // execution_count AS average_cpu,
        total_worker_time AS total_cpu, execution_count, {_QUERY}
    FROM j {top(50, f'total_worker_time // execution_count DESC, {_ID}')}""", _STATS)
def costly_by_average_cpu(spark, sf_dir):
    return qs.costly_by_cpu(fleet(spark, sf_dir), order_by="average_cpu")


@query(_JOINED + f"""
    SELECT server_id, total_worker_time // execution_count AS average_cpu,
        total_worker_time AS total_cpu, execution_count, {_QUERY}
    FROM j {top(50, f'total_worker_time DESC, {_ID}')}""", _STATS)
def costly_by_cpu(spark, sf_dir):
    return qs.costly_by_cpu(fleet(spark, sf_dir))


@query(_JOINED + f"""
    SELECT server_id, total_clr_time // execution_count AS average_clr_time, total_clr_time,
        execution_count, {_QUERY}
    FROM j WHERE total_clr_time <> 0
    {top(100, f'total_clr_time // execution_count DESC, {_ID}')}""", _STATS)
def costly_clr(spark, sf_dir):
    return qs.costly_clr(fleet(spark, sf_dir))


@query(_JOINED + f"""
    SELECT server_id, dbid, execution_count, {_QUERY}
    FROM j WHERE coalesce(database_name, '') NOT IN ('', 'msdb')
    {top(10, f'execution_count DESC, {_ID}')}""", _STATS)
def most_executed(spark, sf_dir):
    return qs.most_executed(fleet(spark, sf_dir))


@query(_JOINED + f"""
    SELECT server_id, (total_elapsed_time - total_worker_time) // execution_count
            AS average_time_blocked,
        total_elapsed_time - total_worker_time AS total_time_blocked, execution_count, {_QUERY}
    FROM j {top(100, f'(total_elapsed_time - total_worker_time) // execution_count DESC, {_ID}')}""",
    _STATS)
def most_blocked(spark, sf_dir):
    return qs.most_blocked(fleet(spark, sf_dir))


def _most_expensive_sql(by):
    return _JOINED + f"""
    SELECT j.server_id, {stmt()} AS statement_text, execution_count, total_logical_reads,
        last_logical_reads, total_logical_writes, last_logical_writes, total_worker_time,
        last_worker_time, total_elapsed_time // 1000000 AS total_elapsed_time_s,
        last_elapsed_time // 1000000 AS last_elapsed_time_s, last_execution_time, p.query_plan
    FROM j JOIN query_plan p ON p.server_id = j.server_id AND p.plan_handle = j.plan_handle
    {top(10, f'total_{by} DESC, j.sql_handle, j.plan_handle, statement_start_offset', 'j.server_id')}"""


for _by in ("logical_reads", "logical_writes", "worker_time"):
    query(_most_expensive_sql(_by), [*_STATS, "query_plan"], f"most_expensive_{_by}")(
        lambda spark, sf_dir, by=_by: qs.most_expensive(fleet(spark, sf_dir), by=by)
    )


@query(_JOINED + f"""
    SELECT j.server_id, database_name, o.name AS object_name, creation_time, last_execution_time,
        total_worker_time // 1000 AS total_cpu_time,
        total_worker_time // execution_count // 1000 AS avg_cpu_time,
        min_worker_time // 1000 AS min_cpu_time, max_worker_time // 1000 AS max_cpu_time,
        last_worker_time // 1000 AS last_cpu_time,
        total_elapsed_time // 1000 AS total_time_elapsed,
        total_elapsed_time // execution_count // 1000 AS avg_time_elapsed,
        min_elapsed_time // 1000 AS min_time_elapsed, max_elapsed_time // 1000 AS max_time_elapsed,
        total_physical_reads // execution_count AS avg_physical_reads,
        total_logical_reads // execution_count AS avg_logical_reads, execution_count,
        {stmt()} AS statement_text
    FROM j JOIN objects o
        ON o.server_id = j.server_id AND o.database_id = j.dbid AND o.object_id = j.objectid
    {top(100, f'total_worker_time // execution_count DESC, {_ID}', 'j.server_id, dbid')}""",
    [*_STATS, "objects"])
def worst_procedures(spark, sf_dir):
    return qs.worst_procedures(fleet(spark, sf_dir))


_PROFILE = ", ".join(
    f"min_{c}, max_{c}, total_{c} // execution_count AS avg_{c}, last_{c}"
    for c in ("worker_time", "physical_reads", "logical_reads", "logical_writes", "elapsed_time")
)


@query(_JOINED + f"""
    SELECT j.server_id, execution_count, o.name AS object_name, {_PROFILE}, {stmt()} AS sql_stmt
    FROM j LEFT JOIN objects o
        ON o.server_id = j.server_id AND o.database_id = j.dbid AND o.object_id = j.objectid
    WHERE dbid = 2""", [*_STATS, "objects"])
def procedure_profile(spark, sf_dir):
    return qs.procedure_profile(fleet(spark, sf_dir), 2)


@query(_JOINED + f"""
    , p AS (
        SELECT server_id, plan_handle, query_plan,
            regexp_extract(query_plan, 'Impact="([^"]*)"', 1) AS impact,
            regexp_extract(query_plan, 'Database="([^"]*)"', 1) AS "database",
            regexp_extract(query_plan, 'Table="([^"]*)"', 1) AS "table"
        FROM query_plan WHERE query_plan LIKE '%</ShowPlanXML>')
    SELECT j.server_id, query_plan, total_worker_time // execution_count AS avg_cpu,
        total_elapsed_time // execution_count AS avg_duration,
        (total_logical_reads + total_physical_reads) // execution_count AS avg_reads,
        execution_count, {stmt()} AS statement_text,
        CAST(CAST(impact AS DECIMAL(18, 4)) * execution_count AS DOUBLE) AS total_impact,
        "database", "table"
    FROM j JOIN p ON p.server_id = j.server_id AND p.plan_handle = j.plan_handle
    WHERE "database" NOT IN ('', 'm')""", [*_STATS, "query_plan"])
def missing_index_plans(spark, sf_dir):
    return qs.missing_index_plans(fleet(spark, sf_dir))


@query(_JOINED + """
    SELECT server_id, execution_count, text, total_elapsed_time FROM j WHERE NOT encrypted""",
    _STATS)
def cached_text(spark, sf_dir):
    return qs.cached_text(fleet(spark, sf_dir))


_PAGED = """
    SELECT server_id, creation_time, row_number, total_hits FROM (
        SELECT *, row_number() OVER ({per} ORDER BY creation_time DESC, sql_handle, plan_handle,
                statement_start_offset) AS row_number,
            count(*) OVER ({per}) AS total_hits FROM j) AS r
    WHERE row_number BETWEEN {first} AND {last}"""


@query(_JOINED + _PAGED.format(per="PARTITION BY server_id", first=11, last=20), _STATS)
def page_query_stats(spark, sf_dir):
    return qs.page_query_stats(fleet(spark, sf_dir))


@query(_JOINED + _PAGED.format(per="PARTITION BY server_id", first=11, last=20).replace("total_hits FROM (", f"""total_hits,
        last_execution_time, total_physical_reads, total_logical_reads, total_logical_writes, execution_count,
        total_worker_time, total_elapsed_time, total_elapsed_time // execution_count AS avg_elapsed_time,
        {stmt()} AS statement_text FROM (""", 1), _STATS)
def page_query_stats_details(spark, sf_dir):
    return qs.page_query_stats(fleet(spark, sf_dir), details=True)


@query(_JOINED + _PAGED.format(per="", first=101, last=150), _STATS)
def page_query_stats_fleet(spark, sf_dir):
    return qs.page_query_stats(fleet(spark, sf_dir), scope=(), page_number=3, size=50)


# --- plan cache ----------------------------------------------------------------

_CACHE = ["cached_plans AS order_plans", "query_stats AS order_stats", "query_text AS order_text",
          "query_plan AS order_plan_xml", "databases"]


@query(f"""
    SELECT server_id, objtype AS cache_type, count(*) AS total_plans,
        sum(size_in_bytes)::BIGINT / 1048576.0 AS total_mbs,
        sum(usecounts)::BIGINT // count(*) AS avg_use_count,
        sum(CASE WHEN usecounts = 1 THEN size_in_bytes ELSE 0 END)::BIGINT / 1048576.0
            AS total_mbs_use_1,
        count(CASE WHEN usecounts = 1 THEN 1 END) AS total_plans_use_1,
        {pct('sum(CASE WHEN usecounts = 1 THEN size_in_bytes ELSE 0 END)', 'sum(size_in_bytes)')}
            AS percent_wasted
    FROM cached_plans GROUP BY server_id, objtype""", _CACHE[:1])
def cache_pollution(spark, sf_dir):
    return pc.cache_pollution(plan_cache(spark, sf_dir))


@query(f"""
    , q AS MATERIALIZED (
        SELECT q.*, {stmt()} AS statement FROM query_stats q
        JOIN query_text t ON t.server_id = q.server_id AND t.sql_handle = q.sql_handle
        WHERE text LIKE '%member%' AND text NOT LIKE '%dm_exec%'),
    s AS (
        SELECT q.*, c.objtype, c.size_in_bytes FROM q
        JOIN cached_plans c ON c.server_id = q.server_id AND c.plan_handle = q.plan_handle),
    g AS (
        SELECT server_id, objtype, query_hash, query_plan_hash,
            sum(size_in_bytes)::BIGINT / 1048576.0 AS total_mb,
            sum(total_worker_time)::BIGINT // sum(execution_count)::BIGINT AS avg_cpu_time,
            sum(execution_count)::BIGINT AS execution_total,
            sum(total_worker_time)::BIGINT AS total_cost,
            min(statement) AS example_statement_text, min(plan_handle) AS plan_handle,
            min(statement_start_offset) AS statement_start_offset
        FROM s GROUP BY server_id, objtype, query_hash, query_plan_hash)
    SELECT g.*, p.query_plan FROM g
    JOIN query_plan p ON p.server_id = g.server_id AND p.plan_handle = g.plan_handle""", _CACHE)
def cache_pollution_details(spark, sf_dir):
    return pc.cache_pollution_details(plan_cache(spark, sf_dir), "%member%")


@query(f"""
    SELECT c.server_id, refcounts, usecounts, size_in_bytes // 1024 AS size_kb, text
    FROM cached_plans c
    JOIN query_text t ON t.server_id = c.server_id AND t.plan_handle = c.plan_handle
    WHERE cacheobjtype = 'Compiled Plan' AND objtype = 'Adhoc' AND usecounts = 1
        AND text NOT LIKE 'FETCH API_CURSOR%'
    {top(100, 'size_in_bytes // 1024 DESC, c.plan_handle', 'c.server_id')}""", _CACHE)
def one_time_queries(spark, sf_dir):
    return pc.one_time_queries(plan_cache(spark, sf_dir))


@query("""
    SELECT c.server_id, refcounts, size_in_bytes, cacheobjtype, encrypted::BIGINT AS encrypted,
        text, query_plan
    FROM cached_plans c
    JOIN query_text t ON t.server_id = c.server_id AND t.plan_handle = c.plan_handle
    JOIN query_plan p ON p.server_id = c.server_id AND p.plan_handle = c.plan_handle""", _CACHE)
def cached_queries(spark, sf_dir):
    return pc.cached_queries(plan_cache(spark, sf_dir))


@query(f"""
    , q AS MATERIALIZED (
        SELECT q.*, t.text, t.dbid FROM query_stats q
        JOIN query_text t ON t.server_id = q.server_id AND t.sql_handle = q.sql_handle)
    SELECT q.server_id, usecounts AS plan_usage, {stmt()} AS individual_query,
        text AS parent_query, d.name AS database_name, cacheobjtype
    FROM q
    JOIN cached_plans c ON c.server_id = q.server_id AND c.plan_handle = q.plan_handle
    LEFT JOIN databases d ON d.server_id = q.server_id AND d.database_id = q.dbid
    {top(100, 'usecounts, q.sql_handle, q.plan_handle, statement_start_offset', 'q.server_id')}""",
    _CACHE)
def lowest_plan_reuse(spark, sf_dir):
    return pc.lowest_plan_reuse(plan_cache(spark, sf_dir))


# --- indexes -------------------------------------------------------------------

_HINT_VIEWS = ["missing_index_groups", "missing_index_group_stats", "missing_index_details",
               "partition_stats", "databases", "objects", "schemas"]
_HINTS = """, h AS (
    SELECT s.server_id, s.avg_user_impact, s.user_seeks, s.unique_compiles, s.last_user_seek,
        s.last_user_scan, g.index_group_handle, d.*,
        round(s.avg_total_user_cost * s.avg_user_impact * (s.user_seeks + s.user_scans), 0)
            AS total_cost
    FROM missing_index_group_stats s
    JOIN missing_index_groups g
        ON g.server_id = s.server_id AND g.index_group_handle = s.group_handle
    JOIN (SELECT * EXCLUDE (server_id), server_id AS srv FROM missing_index_details) d
        ON d.srv = s.server_id AND d.index_handle = g.index_handle)
"""


@query(_HINTS + """
    SELECT server_id, total_cost, avg_user_impact, user_seeks, unique_compiles, last_user_seek,
        last_user_scan, split_part(statement, '.', 1) AS database_name,
        substr(statement, instr(statement, '.') + 1) AS table_name,
        equality_columns AS equality_usage, inequality_columns AS inequality_usage,
        included_columns AS include_columns,
        'CREATE INDEX [missing_index_' || index_group_handle || '_' || index_handle || '_'
            || left(replace(replace(split_part(statement, '.', 3), '[', ''), ']', ''), 32)
            || '] ON ' || statement || ' (' || concat_ws(',', equality_columns, inequality_columns)
            || ')' || coalesce(' INCLUDE (' || included_columns || ')', '')
            AS create_index_statement
    FROM h""", _HINT_VIEWS)
def missing_indexes(spark, sf_dir):
    return ix.missing_indexes(fleet(spark, sf_dir))


_SIZED = _HINTS + """, r AS (
    SELECT server_id, database_id, object_id, sum(row_count)::BIGINT AS row_count
    FROM partition_stats WHERE index_id IN (0, 1) GROUP BY ALL),
    z AS (
    SELECT h.*, coalesce(r.row_count, 0) AS row_count, d.name AS database_name
    FROM h LEFT JOIN r ON r.server_id = h.server_id AND r.database_id = h.database_id
            AND r.object_id = h.object_id
        LEFT JOIN databases d ON d.server_id = h.server_id AND d.database_id = h.database_id
    WHERE avg_user_impact >= 90 AND coalesce(r.row_count, 0) > 10000)
"""


@query(_SIZED + """
    SELECT z.server_id, z.database_id, z.object_id, total_cost, avg_user_impact, user_seeks,
        unique_compiles, row_count, database_name, s.name AS schema_name, o.name AS table_name,
        equality_columns AS equality_usage, inequality_columns AS inequality_usage,
        included_columns AS include_columns, last_user_seek
    FROM z LEFT JOIN objects o ON o.server_id = z.server_id AND o.database_id = z.database_id
            AND o.object_id = z.object_id
        LEFT JOIN schemas s ON s.server_id = z.server_id AND s.database_id = z.database_id
            AND s.schema_id = o.schema_id""", _HINT_VIEWS)
def missing_indexes_with_rows(spark, sf_dir):
    return ix.missing_indexes_with_rows(fleet(spark, sf_dir)).drop("recorded_at")


@query(_SIZED + """
    SELECT server_id, database_name, count(*) AS missing_index_count FROM z
    GROUP BY server_id, database_name""", _HINT_VIEWS)
def missing_index_count_by_db(spark, sf_dir):
    return ix.missing_index_count_by_db(fleet(spark, sf_dir))


@query("""
    SELECT m.server_id, left(d.name, 30) AS database_name, count(*) AS missing_index_count
    FROM missing_index_details m
    LEFT JOIN databases d ON d.server_id = m.server_id AND d.database_id = m.database_id
    GROUP BY m.server_id, left(d.name, 30)""", ["missing_index_details", "databases"])
def missing_index_count(spark, sf_dir):
    return ix.missing_index_count(fleet(spark, sf_dir))


_INDEX_VIEWS = ["indexes", "index_usage", "index_physical_stats", "objects", "schemas", "databases",
                "partition_stats"]
_USED = """, u AS (
    SELECT u.*, i.name AS index_name, i.type_desc, o.name AS table_name, o.schema_id,
        d.name AS database_name, user_updates + system_updates AS maintenance_cost,
        user_seeks + user_scans + user_lookups AS retrieval_usage
    FROM index_usage u
    JOIN indexes i ON i.server_id = u.server_id AND i.database_id = u.database_id
        AND i.object_id = u.object_id AND i.index_id = u.index_id
    JOIN objects o ON o.server_id = u.server_id AND o.database_id = u.database_id
        AND o.object_id = u.object_id
    LEFT JOIN databases d ON d.server_id = u.server_id AND d.database_id = u.database_id
    WHERE i.name IS NOT NULL AND NOT o.is_ms_shipped)
"""
_IX = "database_id, object_id, index_id"


@query("""
    SELECT i.server_id, i.database_id, o.name AS object_name,
        coalesce(i.name, '(heap)') AS index_name, i.type_desc AS type,
        coalesce(user_seeks, 0) AS seeks, coalesce(user_scans, 0) AS scans,
        coalesce(user_lookups, 0) AS lookups, coalesce(user_updates, 0) AS updates
    FROM indexes i
    JOIN objects o ON o.server_id = i.server_id AND o.database_id = i.database_id
        AND o.object_id = i.object_id
    LEFT JOIN index_usage u ON u.server_id = i.server_id AND u.database_id = i.database_id
        AND u.object_id = i.object_id AND u.index_id = i.index_id
    WHERE o.type <> 'S'""", _INDEX_VIEWS)
def index_usage(spark, sf_dir):
    return ix.index_usage(fleet(spark, sf_dir))


@query(_USED + """
    SELECT u.server_id, database_name, s.name AS schema_name, table_name, index_name, type_desc,
        user_updates, user_seeks, user_scans, user_lookups, system_updates,
        CASE WHEN retrieval_usage > 0 THEN 1 ELSE 0 END AS index_is_used, 0 AS drop_index
    FROM u LEFT JOIN schemas s ON s.server_id = u.server_id AND s.database_id = u.database_id
        AND s.schema_id = u.schema_id""", _INDEX_VIEWS)
def index_used_flag(spark, sf_dir):
    return ix.index_used_flag(fleet(spark, sf_dir)).drop("recorded_at")


@query(_USED + f"""
    SELECT server_id, maintenance_cost, retrieval_usage, user_updates, system_updates, user_seeks,
        user_scans, user_lookups, database_name, table_name, index_name
    FROM u WHERE maintenance_cost > 0 {top(10, f'maintenance_cost DESC, {_IX}')}""", _INDEX_VIEWS)
def costly_used_indexes(spark, sf_dir):
    return ix.costly_used_indexes(fleet(spark, sf_dir))


@query(_USED + f"""
    SELECT server_id, retrieval_usage AS usage, database_name, table_name, index_name
    FROM u WHERE retrieval_usage > 0 {top(10, f'retrieval_usage DESC, {_IX}')}""", _INDEX_VIEWS)
def most_used_indexes(spark, sf_dir):
    return ix.most_used_indexes(fleet(spark, sf_dir))


@query(f"""
    SELECT p.server_id, d.name AS database_name, o.name AS table_name, i.name AS index_name,
        fill_factor, is_padded::BIGINT AS is_padded, i.type_desc,
        round(avg_fragmentation_in_percent, 2) AS fragmentation_pct
    FROM index_physical_stats p
    JOIN indexes i ON i.server_id = p.server_id AND i.database_id = p.database_id
        AND i.object_id = p.object_id AND i.index_id = p.index_id
    JOIN objects o ON o.server_id = p.server_id AND o.database_id = p.database_id
        AND o.object_id = p.object_id
    LEFT JOIN databases d ON d.server_id = p.server_id AND d.database_id = p.database_id
    WHERE p.database_id = 3 AND i.name IS NOT NULL AND NOT o.is_ms_shipped
    {top(10, 'avg_fragmentation_in_percent DESC, p.object_id, p.index_id, index_level',
         'p.server_id')}""", _INDEX_VIEWS)
def fragmented_indexes(spark, sf_dir):
    return ix.fragmented_indexes(fleet(spark, sf_dir), database_id=3)


@query("""
    SELECT p.server_id, o.name AS "table", p.index_id, i.name AS "index", used_page_count, row_count
    FROM partition_stats p
    JOIN objects o ON o.server_id = p.server_id AND o.database_id = p.database_id
        AND o.object_id = p.object_id
    JOIN indexes i ON i.server_id = p.server_id AND i.database_id = p.database_id
        AND i.object_id = p.object_id AND i.index_id = p.index_id""", _INDEX_VIEWS)
def index_sizes(spark, sf_dir):
    return ix.index_sizes(fleet(spark, sf_dir))


@query("""
    SELECT p.server_id, p.index_id, i.name AS "index", p.index_type_desc, index_depth, index_level,
        page_count, record_count
    FROM index_physical_stats p
    JOIN objects o ON o.server_id = p.server_id AND o.database_id = p.database_id
        AND o.object_id = p.object_id
    JOIN indexes i ON i.server_id = p.server_id AND i.database_id = p.database_id
        AND i.object_id = p.object_id AND i.index_id = p.index_id
    WHERE p.index_id = 4""", _INDEX_VIEWS)
def index_depth(spark, sf_dir):
    return ix.index_depth(fleet(spark, sf_dir), index_id=4)


_PARTITION_VIEWS = [
    "partitions", "indexes", "partition_schemes", "partition_functions", "partition_range_values",
    "destination_data_spaces", "partition_parameters", "types", "data_spaces", "allocation_units",
    "objects",
]


def _db_join(table, alias, on, how="JOIN"):
    return (f"{how} {table} {alias} ON {alias}.server_id = p.server_id "
            f"AND {alias}.database_id = p.database_id AND {on}")


@query(f"""
    SELECT p.server_id, o.name AS table_name, pf.name AS pf_name, ps.name AS ps_name,
        ds.name AS fg_name, pv.value,
        CASE WHEN boundary_value_on_right THEN 'Range Right' ELSE 'Range Left' END AS type,
        t.name AS data_type, max_length, precision, scale, is_default::BIGINT AS is_default,
        pv.parameter_id, fanout AS partition_count, p.index_id, p.partition_number,
        p.rows AS approx_row_count, au.total_pages
    FROM partitions p
    {_db_join('indexes', 'i', 'i.object_id = p.object_id AND i.index_id = p.index_id')}
    {_db_join('partition_schemes', 'ps', 'ps.data_space_id = i.data_space_id')}
    {_db_join('partition_functions', 'pf', 'pf.function_id = ps.function_id')}
    {_db_join('partition_range_values', 'pv', 'pv.function_id = pf.function_id '
              'AND pv.boundary_id = p.partition_number', 'LEFT JOIN')}
    {_db_join('destination_data_spaces', 'dd', 'dd.partition_scheme_id = ps.data_space_id '
              'AND dd.destination_id = p.partition_number')}
    {_db_join('partition_parameters', 'pp', 'pp.function_id = pf.function_id')}
    {_db_join('types', 't', 't.system_type_id = pp.system_type_id AND t.user_type_id = 56')}
    {_db_join('data_spaces', 'ds', 'ds.data_space_id = dd.data_space_id')}
    {_db_join('(SELECT server_id, database_id, container_id, '
              'sum(total_pages)::BIGINT AS total_pages FROM allocation_units GROUP BY ALL)',
              'au', 'au.container_id = p.partition_id')}
    {_db_join('objects', 'o', 'o.object_id = p.object_id', 'LEFT JOIN')}""", _PARTITION_VIEWS)
def partitioned_tables(spark, sf_dir):
    return ix.partitioned_tables(fleet(spark, sf_dir))


# --- memory, files, disk, backups -----------------------------------------------


def _rating(ms):
    return (f"CASE WHEN {ms} < CASE WHEN file_id = 2 THEN 5 ELSE 10 END THEN 'Good' "
            f"WHEN {ms} < CASE WHEN file_id = 2 THEN 15 ELSE 20 END THEN 'Acceptable' "
            "ELSE 'Unacceptable' END")


@query(f"""
    SELECT f.server_id, d.name AS database_name,
        CASE WHEN file_id = 2 THEN 'Log' ELSE 'Data' END AS file_type,
        size_on_disk_bytes // 1024 / 1024.0 AS size_on_disk_mb,
        io_stall_read_ms // num_of_reads AS avg_read_ms,
        {_rating('io_stall_read_ms // num_of_reads')} AS read_rating,
        io_stall_write_ms // num_of_writes AS avg_write_ms,
        {_rating('io_stall_write_ms // num_of_writes')} AS write_rating
    FROM file_io_stats f
    LEFT JOIN databases d ON d.server_id = f.server_id AND d.database_id = f.database_id
    WHERE num_of_reads > 0 AND num_of_writes > 0""", ["file_io_stats", "databases"])
def file_latency(spark, sf_dir):
    return mem.file_latency(fleet(spark, sf_dir))


_BUFFER_VIEWS = ["buffer_pages", "allocation_units", "partitions", "objects", "indexes", "databases"]


@query(f"""
    SELECT * FROM (
        SELECT b.server_id, b.database_id, o.name AS object_name, i.name AS index_name, i.type_desc,
            count(*) AS buffered_page_count, count(*) * 8192 // 1048576 AS buffer_mb
        FROM buffer_pages b
        JOIN allocation_units a ON a.server_id = b.server_id AND a.database_id = b.database_id
            AND a.allocation_unit_id = b.allocation_unit_id AND a.type IN (1, 2, 3)
        JOIN partitions p ON p.server_id = b.server_id AND p.database_id = b.database_id
            AND p.hobt_id = a.container_id
        LEFT JOIN objects o ON o.server_id = b.server_id AND o.database_id = b.database_id
            AND o.object_id = p.object_id
        LEFT JOIN indexes i ON i.server_id = b.server_id AND i.database_id = b.database_id
            AND i.object_id = p.object_id AND i.index_id = p.index_id
        GROUP BY b.server_id, b.database_id, o.name, p.index_id, i.name, i.type_desc) AS g
    {top(100, 'buffered_page_count DESC, object_name, index_name', 'server_id, database_id')}""",
    _BUFFER_VIEWS)
def buffer_by_object(spark, sf_dir):
    return mem.buffer_by_object(fleet(spark, sf_dir))


@query("""
    SELECT b.server_id,
        left(CASE WHEN b.database_id = 32767 THEN 'ResourceDb' ELSE d.name END, 20)
            AS database_name,
        count(*) AS buffered_page_count, count(*) * 8192 // 1048576 AS buffer_pool_mb
    FROM buffer_pages b
    LEFT JOIN databases d ON d.server_id = b.server_id AND d.database_id = b.database_id
    GROUP BY b.server_id, b.database_id, d.name""", _BUFFER_VIEWS)
def buffer_by_database(spark, sf_dir):
    return mem.buffer_by_database(fleet(spark, sf_dir))


@query("""
    SELECT b.server_id,
        left(CASE WHEN b.database_id = 32767 THEN 'ResourceDb' ELSE d.name END, 20)
            AS database_name,
        count(*) AS buffered_page_count, count(*) * 8192 // 1048576 AS buffer_pool_mb
    FROM buffer_pages b
    LEFT JOIN databases d ON d.server_id = b.server_id AND d.database_id = b.database_id
    GROUP BY b.server_id, b.database_id, d.name""", _BUFFER_VIEWS)
def buffer_by_database_newest(spark, sf_dir):
    return mem.buffer_by_database(collections(spark, sf_dir), scope=["server_id"])


@query("""
    SELECT server_id, table_name, rows_cnt::BIGINT AS row_count,
        split_part(data, ' ', 1)::BIGINT AS data_kb, split_part(index_size, ' ', 1)::BIGINT AS index_kb,
        split_part(data, ' ', 1)::BIGINT + split_part(index_size, ' ', 1)::BIGINT AS total_kb
    FROM space_used""", ["space_used"])
def disk_usage_by_table(spark, sf_dir):
    return st.disk_usage_by_table(fleet(spark, sf_dir))


_LEGACY = ["sys_databases", "sys_objects_legacy", "sys_indexes", "sys_index_keys", "sys_columns",
           "sys_types"]
_LEGACY_JOIN = """
    FROM sys_databases d
    JOIN sys_indexes i ON i.server_id = d.server_id AND i.database_id = d.dbid
    JOIN sys_objects_legacy o ON o.server_id = i.server_id AND o.database_id = i.database_id
        AND o.id = i.id
    JOIN sys_index_keys k ON k.server_id = i.server_id AND k.database_id = i.database_id
        AND k.id = i.id AND k.indid = i.indid
    JOIN sys_columns c ON c.server_id = k.server_id AND c.database_id = k.database_id
        AND c.id = k.id AND c.colid = k.colid
    JOIN sys_types t ON t.server_id = c.server_id AND t.database_id = c.database_id
        AND t.xtype = c.xtype
    WHERE d.name NOT IN ('northwind', 'pubs') AND d.dbid > 4 AND d.status & 33760 = 0
        AND o.xtype <> 'S' AND i.name NOT LIKE '_wa_sys_%'"""


@query(f"""
    SELECT DISTINCT d.server_id, d.name AS db_name, o.name AS table_name, i.name AS index_name,
        CASE WHEN i.status & 16 = 0 THEN 0 ELSE 1 END AS clustered, rowcnt AS est_row_count,
        reserved * 8 // 1024 AS reserved_mb {_LEGACY_JOIN}""", _LEGACY)
def disk_usage_by_index(spark, sf_dir):
    return st.disk_usage_by_index(fleet(spark, sf_dir))


def _bit(mask, name):
    return f"CASE WHEN i.status & {mask} = 0 THEN 0 ELSE 1 END AS {name}"


@query(f"""
    SELECT DISTINCT d.server_id, d.name AS db_name, o.name AS table_name, i.name AS index_name, i.indid,
        {_bit(2048, 'is_primary')}, {_bit(16, 'clustered')}, {_bit(2, 'is_unique')},
        {_bit(1, 'ignore_dup_key')}, {_bit(4, 'ignore_dup_row')},
        {_bit(16777216, 'no_recompute')}, origfillfactor AS fill_factor, rowcnt AS est_row_count,
        reserved * 8 AS reserved_kb, used * 8 AS used_kb {_LEGACY_JOIN}""", _LEGACY)
def index_details(spark, sf_dir):
    return st.index_details(fleet(spark, sf_dir))


@query(f"""
    SELECT d.server_id, d.name AS db_name, o.name AS table_name, i.name AS index_name, i.indid,
        keyno AS key_number, c.name AS column_name, t.name AS data_type, xprec AS "precision", xscale AS scale,
        iscomputed AS is_computed, isnullable AS is_nullable, "collation" {_LEGACY_JOIN}""", _LEGACY)
def index_columns(spark, sf_dir):
    return st.index_columns(fleet(spark, sf_dir))


_BACKUP_VIEWS = ["databases AS backup_databases", "backup_sets", "backup_media"]


@query("""
    SELECT d.server_id, d.name, max(backup_finish_date) AS last_backup_finish_date,
        CASE WHEN max(backup_finish_date) IS NULL THEN 'No Backup' END AS label
    FROM databases d
    LEFT JOIN backup_sets b ON b.server_id = d.server_id AND b.database_name = d.name
        AND b.type = 'D'
    WHERE d.database_id <> 2 GROUP BY d.server_id, d.name""", _BACKUP_VIEWS)
def last_backup(spark, sf_dir):
    return bk.last_backup(backups(spark, sf_dir))


@query("SELECT DISTINCT server_id, physical_device_name FROM backup_media", _BACKUP_VIEWS)
def backup_locations(spark, sf_dir):
    return bk.backup_locations(backups(spark, sf_dir))


# --- resources -----------------------------------------------------------------

_RESOURCE_ORDER = ("end_time DESC, start_time, database_name, avg_cpu_percent, "
                   "avg_data_io_percent, avg_log_write_percent")


@query(f"SELECT * FROM resource_stats {top(10, _RESOURCE_ORDER)}", ["resource_stats"])
def latest_resource(spark, sf_dir):
    return rs.latest_resource(fleet(spark, sf_dir))


def _fit(col, name, limit=80):
    return (f"(count(*) - count(CASE WHEN {col} > {limit} THEN 1 END))::DOUBLE / count(*) "
            f"AS {name}")


_FITS = ", ".join(_fit(c, n) for c, n in rs.FIT_COLUMNS.items())


@query(f"SELECT server_id, {_FITS} FROM resource_stats GROUP BY server_id", ["resource_stats"])
def resource_fit(spark, sf_dir):
    return rs.resource_fit(fleet(spark, sf_dir))


@query(f"""
    SELECT server_id, {_FITS} FROM resource_stats
    WHERE end_time >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 60 MINUTE
    GROUP BY server_id""", ["resource_stats"])
def resource_fit_recent(spark, sf_dir):
    return rs.resource_fit(fleet(spark, sf_dir), last_minutes=60, now="2024-01-10 00:00:00")


@query("""
    SELECT server_id, start_time, end_time,
        greatest(avg_cpu_percent, avg_data_io_percent, avg_log_write_percent) AS avg_dtu_percent
    FROM resource_stats WHERE database_name = 'db2'""", ["resource_stats"])
def dtu_percent(spark, sf_dir):
    return rs.dtu_percent(fleet(spark, sf_dir), "db2")


# --- inventory -----------------------------------------------------------------


@query("""
    SELECT f.server_id, d.name AS database_name, f.name, f.type_desc, f.physical_name
    FROM master_files f
    LEFT JOIN databases d ON d.server_id = f.server_id AND d.database_id = f.database_id""",
    ["master_files", "databases"])
def database_files(spark, sf_dir):
    return inv.database_files(fleet(spark, sf_dir))


@query("SELECT server_id, name, compatibility_level, recovery_model_desc, state_desc FROM databases",
       _BACKUP_VIEWS)
def databases(spark, sf_dir):
    return inv.databases(backups(spark, sf_dir))


@query("SELECT * FROM filegroups", ["filegroups"])
def filegroups(spark, sf_dir):
    return inv.filegroups(fleet(spark, sf_dir))


@query("SELECT * FROM configurations", ["configurations"])
def configuration(spark, sf_dir):
    return inv.configuration(fleet(spark, sf_dir))


@query("""
    SELECT server_id, name, denylogin, isntname, isntgroup, isntuser
    FROM logins WHERE sysadmin = 1 OR securityadmin = 1""", ["logins"])
def privileged_logins(spark, sf_dir):
    return inv.privileged_logins(fleet(spark, sf_dir))
