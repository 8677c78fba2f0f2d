"""Telemetry-shaped views over the sales tables of the test data.

Each view is one SELECT in the part of SQL that Spark and DuckDB share, so the
reports and their oracles start from the same rows. ``{lineitem}`` and the like
stand for a table, ``{each_n}`` for "n rows of k = 0 .. n-1 per row".
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.waits import MORE_IDLE_WAITS
from ..sources.snapshot import Snapshot, as_of

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _srv(key: str, n: int = 3) -> str:
    return f"'srv' || CAST({key} % {n} AS STRING)"


_PART_SRV, _PART_DB = _srv("p_partkey"), "CAST(p_partkey % 5 AS INT)"
_SUPP_SRV, _SUPP_DB = _srv("s_suppkey"), "CAST(s_suppkey % 5 AS INT)"


def _spread(name: str, expr: str) -> str:
    """total, min, max and last (the largest) of a counter."""
    return (
        f"CAST(sum({expr}) AS BIGINT) AS total_{name}, CAST(min({expr}) AS BIGINT) AS min_{name}, "
        f"CAST(max({expr}) AS BIGINT) AS max_{name}, CAST(max({expr}) AS BIGINT) AS last_{name}"
    )


_COUNTERS = ", ".join([
    _spread("worker_time", "w"), _spread("elapsed_time", "w + 137 * l_linenumber"),
    _spread("physical_reads", "l_linenumber"), _spread("logical_reads", "q"),
    _spread("logical_writes", "l_linenumber"),
])
_LINES = (
    "(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_returnflag, "
    "l_linestatus, CAST(floor(l_extendedprice) AS BIGINT) * 1000 AS w, "
    "CAST(floor(l_quantity) AS BIGINT) AS q FROM {lineitem})"
)

# A wait-for edge per customer: cycles of three, tails leading to them, a tree for
# the rest, idle customers, and a second blocker for some.
_EDGE = """
    SELECT c, b FROM (
        SELECT c, CASE WHEN m = 99 THEN c - 2 WHEN m IN (97, 98) THEN c + 1
                       WHEN c % 7 = 0 THEN NULL WHEN m >= 90 THEN c + 1
                       ELSE CAST(floor(c / 3.0) AS BIGINT) END AS b
        FROM (SELECT c_custkey AS c, c_custkey % 100 AS m FROM {customer}) AS x
        UNION ALL
        SELECT c, CASE WHEN c % 50 = 10 AND c % 7 <> 0 THEN c - 9 END AS b
        FROM (SELECT c_custkey AS c FROM {customer}) AS y
    ) AS e WHERE b IS NOT NULL AND b <> c"""

_LOCKS = """
    SELECT 'srv0' AS server_id, TIMESTAMP '2024-01-01 12:00:00' AS snapshot_ts,
        CAST(l_suppkey AS INT) AS request_session_id,
        CAST(CASE WHEN l_linenumber = 1 THEN l_partkey ELSE l_suppkey END % 5 AS INT)
            AS resource_database_id,
        CASE l_linenumber WHEN 1 THEN 2000000 + l_partkey WHEN 2 THEN l_suppkey * 100
             WHEN 3 THEN l_suppkey * 100 WHEN 6 THEN l_suppkey * 10 + l_partkey % 5
             WHEN 7 THEN l_partkey ELSE 0 END AS resource_associated_entity_id,
        CASE l_returnflag WHEN 'A' THEN 'S' WHEN 'N' THEN 'X' ELSE 'U' END AS request_mode,
        'LOCK' AS request_type,
        CASE WHEN l_linestatus = 'O' AND l_linenumber = 2 THEN 'WAIT' ELSE 'GRANT' END
            AS request_status,
        CASE WHEN l_quantity > 25 THEN 'TRANSACTION' ELSE 'SHARED_TRANSACTION_WORKSPACE' END
            AS request_owner_type,
        CASE l_linenumber WHEN 1 THEN 'OBJECT' WHEN 2 THEN 'KEY' WHEN 3 THEN 'PAGE'
             WHEN 4 THEN 'DATABASE' WHEN 5 THEN 'APPLICATION' WHEN 6 THEN 'ALLOCATION_UNIT'
             ELSE 'METADATA' END AS resource_type,
        '' AS resource_subtype,
        CASE WHEN l_partkey % 10 = 0 THEN '' ELSE 'app' || CAST(l_partkey % 10 AS STRING) END
            AS resource_description,
        'o' || CAST(l_suppkey AS STRING) AS lock_owner_address
    FROM {lineitem}"""

VIEWS = {
    "wait_stats": """
        SELECT l_returnflag AS server_id, p_brand AS wait_type,
            CAST(sum(floor(l_quantity)) AS BIGINT) AS wait_time_ms
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY l_returnflag, p_brand""",
    "query_stats": f"""
        SELECT {_srv('l_partkey')} AS server_id, CAST(l_partkey AS STRING) AS sql_handle,
            CAST(l_partkey AS STRING) AS plan_handle,
            CAST(2 * (l_partkey % 4) AS INT) AS statement_start_offset,
            CAST(CASE WHEN l_partkey % 2 = 0 THEN -1 ELSE 2 * (l_partkey % 4) + 12 END AS INT)
                AS statement_end_offset,
            min(l_shipdate) AS creation_time, max(l_shipdate) AS last_execution_time,
            count(*) AS execution_count, {_COUNTERS},
            CAST(sum(CASE WHEN l_returnflag = 'R' THEN q ELSE 0 END) AS BIGINT) AS total_clr_time
        FROM {_LINES} AS x GROUP BY l_partkey""",
    "query_text": f"""
        SELECT {_PART_SRV} AS server_id, CAST(p_partkey AS STRING) AS sql_handle,
            CAST(p_partkey AS STRING) AS plan_handle,
            CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE {_PART_DB} END AS dbid,
            1000000 + p_size AS objectid,
            'SELECT ' || p_name || ' FROM ' || p_type AS text, p_size % 10 = 0 AS encrypted
        FROM {{part}} WHERE p_size <> 7""",
    "query_plan": f"""
        SELECT {_PART_SRV} AS server_id, CAST(p_partkey AS STRING) AS plan_handle,
            '<ShowPlanXML><BatchSequence><Batch><Statements><StmtSimple><QueryPlan>' ||
            CASE WHEN p_size % 3 = 0 THEN
                '<MissingIndexes><MissingIndexGroup Impact="' || CAST(p_size AS STRING) ||
                '.25"><MissingIndex Database="' ||
                CASE WHEN p_partkey % 4 = 0 THEN 'm'
                     ELSE '[db' || CAST(p_partkey % 5 AS STRING) || ']' END ||
                '" Table="[' || p_brand || ']"/></MissingIndexGroup></MissingIndexes>'
                ELSE '' END ||
            CASE WHEN p_partkey % 17 = 0 THEN '' ELSE
                '</QueryPlan></StmtSimple></Statements></Batch></BatchSequence></ShowPlanXML>' END
            AS query_plan
        FROM {{part}} WHERE p_size <> 13""",
    # One row per server and region, and the fleet's other catalog tables.
    "databases": """
        SELECT 'srv' || CAST(k AS STRING) AS server_id, r_regionkey AS database_id,
            CASE WHEN r_regionkey = 4 THEN 'msdb' ELSE r_name END AS name
        FROM {region} {each_3}""",
    "schemas": """
        SELECT 'srv' || CAST(k % 3 AS STRING) AS server_id, r_regionkey AS database_id,
            CAST(floor(k / 3.0) AS INT) AS schema_id,
            'schema' || CAST(CAST(floor(k / 3.0) AS INT) AS STRING) AS name
        FROM {region} {each_9}""",
    "objects": f"""
        SELECT {_SUPP_SRV} AS server_id, {_SUPP_DB} AS database_id,
            CAST(s_suppkey AS INT) AS object_id, s_nationkey % 3 AS schema_id, s_name AS name,
            CASE WHEN s_suppkey % 20 = 0 THEN 'S' ELSE 'U' END AS type,
            s_suppkey % 25 = 0 AS is_ms_shipped
        FROM {{supplier}}
        UNION ALL
        SELECT {_PART_SRV}, {_PART_DB}, CAST(2000000 + p_partkey AS INT), p_size % 3,
            CASE WHEN p_partkey % 5 <> 2 OR p_size % 3 = 2 THEN p_name
                 WHEN p_size % 3 = 0 THEN rpad('#t' || CAST(p_size AS STRING), 128, '_')
                 ELSE '#0A1B2C' || lpad(CAST(p_size AS STRING), 2, '0') END,
            'U', FALSE
        FROM {{part}}
        UNION ALL
        SELECT DISTINCT {_PART_SRV}, {_PART_DB}, 1000000 + p_size, 0,
            'proc' || CAST(p_size AS STRING), 'P', FALSE
        FROM {{part}}""",
    "indexes": f"""
        SELECT {_SUPP_SRV} AS server_id, {_SUPP_DB} AS database_id,
            CAST(s_suppkey AS INT) AS object_id, CAST(k AS INT) AS index_id,
            CASE WHEN k = 0 THEN NULL
                 ELSE 'ix_' || CAST(s_suppkey AS STRING) || '_' || CAST(k AS STRING) END AS name,
            CASE WHEN k = 0 THEN 'HEAP' WHEN k = 1 THEN 'CLUSTERED' ELSE 'NONCLUSTERED' END
                AS type_desc,
            CAST(s_suppkey % 10 * 10 AS INT) AS fill_factor, s_suppkey % 2 = 0 AS is_padded,
            CAST(100 + s_suppkey % 4 AS INT) AS data_space_id
        FROM {{supplier}} {{each_6}}""",
    "index_usage": f"""
        SELECT {_srv('l_suppkey')} AS server_id, CAST(l_suppkey % 5 AS INT) AS database_id,
            CAST(l_suppkey AS INT) AS object_id, CAST(l_partkey % 4 AS INT) AS index_id,
            count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS user_seeks,
            count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS user_scans,
            count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS user_lookups,
            CAST(sum(l_linenumber) AS BIGINT) AS user_updates,
            count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS system_updates
        FROM {{lineitem}} GROUP BY l_suppkey, l_partkey % 4""",
    "index_physical_stats": f"""
        SELECT {_srv('l_suppkey')} AS server_id, CAST(l_suppkey % 5 AS INT) AS database_id,
            CAST(l_suppkey AS INT) AS object_id, CAST(l_partkey % 6 AS INT) AS index_id,
            CASE WHEN l_partkey % 6 = 0 THEN 'HEAP' ELSE 'INDEX' END AS index_type_desc,
            CAST(max(l_linenumber) AS INT) AS index_depth,
            CASE WHEN l_linenumber > 4 THEN 1 ELSE 0 END AS index_level,
            count(*) AS page_count, CAST(sum(q) AS BIGINT) AS record_count,
            CAST(sum(q) % 9973 AS DOUBLE) / 100.0 AS avg_fragmentation_in_percent
        FROM {_LINES} AS x
        GROUP BY l_suppkey, l_partkey % 6, CASE WHEN l_linenumber > 4 THEN 1 ELSE 0 END""",
    "missing_index_groups": f"""
        SELECT {_PART_SRV} AS server_id, CAST(p_partkey AS INT) AS index_group_handle,
            CAST(p_partkey * 10 AS INT) AS index_handle FROM {{part}}""",
    "missing_index_group_stats": f"""
        SELECT {_srv('l_partkey')} AS server_id, CAST(l_partkey AS INT) AS group_handle,
            CAST(max(l_linenumber) AS DOUBLE) AS avg_total_user_cost,
            CAST(l_partkey % 50 * 2 + 1 AS DOUBLE) AS avg_user_impact,
            count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS user_seeks,
            count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS user_scans,
            count(*) AS unique_compiles, max(l_shipdate) AS last_user_seek,
            min(l_shipdate) AS last_user_scan
        FROM {{lineitem}} GROUP BY l_partkey""",
    "missing_index_details": f"""
        SELECT {_PART_SRV} AS server_id, CAST(p_partkey * 10 AS INT) AS index_handle,
            {_PART_DB} AS database_id, CAST(2000000 + p_partkey AS INT) AS object_id,
            '[db' || CAST(p_partkey % 5 AS STRING) || '].[dbo].[' || p_name || ']' AS statement,
            CASE WHEN p_size % 3 = 0 THEN NULL ELSE '[a' || CAST(p_size AS STRING) || ']' END
                AS equality_columns,
            CASE WHEN p_size % 3 = 1 THEN NULL ELSE '[b' || CAST(p_size AS STRING) || ']' END
                AS inequality_columns,
            CASE WHEN p_size % 4 = 2 THEN NULL ELSE '[c]' END AS included_columns
        FROM {{part}}""",
    "partition_stats": f"""
        SELECT {_PART_SRV} AS server_id, {_PART_DB} AS database_id,
            CAST(2000000 + p_partkey AS INT) AS object_id,
            CAST(CASE WHEN k = 2 THEN 2 ELSE 0 END AS INT) AS index_id,
            CAST(CASE WHEN k = 2 THEN 1 ELSE k + 1 END AS INT) AS partition_number,
            CAST(p_size + k AS BIGINT) AS used_page_count,
            CAST(p_partkey * 10 AS BIGINT) AS row_count
        FROM {{part}} {{each_3}}
        UNION ALL
        SELECT {_SUPP_SRV}, {_SUPP_DB}, CAST(s_suppkey AS INT), CAST(k AS INT), 1,
            CAST(s_nationkey + k AS BIGINT), CAST(s_suppkey * 7 + k AS BIGINT)
        FROM {{supplier}} {{each_6}}""",
    # Plan cache: an order is a plan, its lines are the statements in it.
    "order_plans": f"""
        SELECT {_srv('o_orderkey')} AS server_id, CAST(o_orderkey AS STRING) AS plan_handle,
            CASE o_orderpriority WHEN '1-URGENT' THEN 'Adhoc' WHEN '2-HIGH' THEN 'Prepared'
                 ELSE o_orderpriority END AS objtype,
            CASE o_orderstatus WHEN 'F' THEN 'Compiled Plan' WHEN 'O' THEN 'Compiled Plan Stub'
                 ELSE 'Parse Tree' END AS cacheobjtype,
            CAST(1 + o_custkey % 3 AS INT) AS refcounts, CAST(coalesce(n, 0) AS INT) AS usecounts,
            CAST(floor(o_totalprice) AS BIGINT) AS size_in_bytes
        FROM {{orders}} LEFT JOIN
            (SELECT l_orderkey, count(*) AS n FROM {{lineitem}} GROUP BY l_orderkey) AS c
            ON o_orderkey = l_orderkey""",
    "order_stats": f"""
        SELECT {_srv('l_orderkey')} AS server_id, CAST(l_orderkey AS STRING) AS sql_handle,
            CAST(l_orderkey AS STRING) AS plan_handle,
            'h' || CAST(l_suppkey AS STRING) AS query_hash,
            'p' || CAST(l_suppkey % 7 AS STRING) AS query_plan_hash,
            CAST(2 * l_linenumber AS INT) AS statement_start_offset,
            CAST(CASE WHEN l_partkey % 2 = 0 THEN -1 ELSE 2 * l_linenumber + 10 END AS INT)
                AS statement_end_offset,
            w AS total_worker_time, q AS execution_count
        FROM {_LINES} AS x""",
    "order_text": f"""
        SELECT {_srv('o_orderkey')} AS server_id, CAST(o_orderkey AS STRING) AS sql_handle,
            CAST(o_orderkey AS STRING) AS plan_handle, CAST(o_custkey % 5 AS INT) AS dbid,
            CASE WHEN o_custkey % 10 = 0 THEN 'FETCH API_CURSOR' || CAST(o_custkey AS STRING)
                 WHEN o_custkey % 10 = 1 THEN 'SELECT * FROM dm_exec_stats'
                 ELSE 'SELECT member ' || o_orderpriority || CAST(o_custkey AS STRING) END AS text,
            o_custkey % 10 = 3 AS encrypted
        FROM {{orders}} WHERE o_totalprice > 5000""",
    "order_plan_xml": f"""
        SELECT {_srv('o_orderkey')} AS server_id, CAST(o_orderkey AS STRING) AS plan_handle,
            '<ShowPlanXML Order="' || CAST(o_orderkey AS STRING) || '"/>' AS query_plan
        FROM {{orders}} WHERE o_orderstatus <> 'P'""",
    # Buffer pool: a line is a cached page of a supplier's object.
    "buffer_pages": f"""
        SELECT {_srv('l_suppkey')} AS server_id,
            CASE WHEN l_suppkey % 11 = 0 THEN 32767 ELSE CAST(l_suppkey % 5 AS INT) END
                AS database_id,
            l_suppkey * 10 + l_partkey % 4 AS allocation_unit_id
        FROM {{lineitem}}""",
    "allocation_units": f"""
        SELECT {_SUPP_SRV} AS server_id, {_SUPP_DB} AS database_id,
            s_suppkey * 10 + k AS allocation_unit_id, s_suppkey * 100 AS container_id,
            CAST(k AS INT) AS type,
            CASE k WHEN 0 THEN 'DROPPED' WHEN 1 THEN 'IN_ROW_DATA' WHEN 2 THEN 'LOB_DATA'
                   ELSE 'ROW_OVERFLOW_DATA' END AS type_desc,
            CAST(s_nationkey + 3 * k AS BIGINT) AS total_pages
        FROM {{supplier}} {{each_4}}""",
    "partitions": f"""
        SELECT {_SUPP_SRV} AS server_id, {_SUPP_DB} AS database_id,
            s_suppkey * 100 AS partition_id, s_suppkey * 100 AS hobt_id,
            CAST(s_suppkey AS INT) AS object_id, CAST(s_suppkey % 3 AS INT) AS index_id,
            CAST(1 + s_suppkey % 4 AS INT) AS partition_number,
            CAST(floor(s_acctbal) AS BIGINT) AS rows
        FROM {{supplier}}""",
    "partition_schemes": """
        SELECT 'srv' || CAST(k % 3 AS STRING) AS server_id, r_regionkey AS database_id,
            CAST(100 + floor(k / 3.0) AS INT) AS data_space_id,
            'scheme' || CAST(CAST(floor(k / 3.0) AS INT) AS STRING) AS name,
            CAST(floor(k / 3.0) AS INT) AS function_id, k < 3 AS is_default
        FROM {region} {each_9}""",
    "partition_functions": """
        SELECT 'srv' || CAST(k % 3 AS STRING) AS server_id, r_regionkey AS database_id,
            CAST(floor(k / 3.0) AS INT) AS function_id,
            'function' || CAST(CAST(floor(k / 3.0) AS INT) AS STRING) AS name,
            k >= 6 AS boundary_value_on_right, 4 AS fanout
        FROM {region} {each_9}""",
    "partition_range_values": """
        SELECT 'srv' || CAST(k % 3 AS STRING) AS server_id, CAST(n_nationkey % 5 AS INT) AS database_id,
            CAST(floor(k / 3.0) AS INT) AS function_id,
            CAST(1 + floor(n_nationkey / 5.0) AS INT) AS boundary_id, 1 AS parameter_id,
            n_name AS value
        FROM {nation} {each_9} WHERE n_nationkey < 15""",
    "partition_parameters": """
        SELECT 'srv' || CAST(k % 3 AS STRING) AS server_id, r_regionkey AS database_id,
            CAST(floor(k / 3.0) AS INT) AS function_id, 1 AS parameter_id, 56 AS system_type_id,
            4 AS max_length, 10 AS precision, 0 AS scale
        FROM {region} {each_9}""",
    "destination_data_spaces": """
        SELECT 'srv' || CAST(k % 3 AS STRING) AS server_id, CAST(n_nationkey % 5 AS INT) AS database_id,
            CAST(100 + floor(k / 3.0) AS INT) AS partition_scheme_id,
            CAST(1 + floor(n_nationkey / 5.0) AS INT) AS destination_id,
            CAST(200 + floor(n_nationkey / 5.0) AS INT) AS data_space_id
        FROM {nation} {each_9}""",
    "data_spaces": """
        SELECT 'srv' || CAST(k AS STRING) AS server_id, CAST(n_nationkey % 5 AS INT) AS database_id,
            CAST(200 + floor(n_nationkey / 5.0) AS INT) AS data_space_id,
            'FG_' || n_name AS name
        FROM {nation} {each_3}""",
    "types": """
        SELECT 'srv' || CAST(k % 3 AS STRING) AS server_id, r_regionkey AS database_id,
            56 AS system_type_id, CAST(56 + floor(k / 3.0) AS INT) AS user_type_id,
            CASE WHEN k < 3 THEN 'int' ELSE 'alias' || CAST(k AS STRING) END AS name
        FROM {region} {each_6}""",
    "file_io_stats": f"""
        SELECT {_srv('o_custkey')} AS server_id, CAST(o_custkey % 5 AS INT) AS database_id,
            CAST(floor(o_custkey / 5.0) AS INT) % 3 + 1 AS file_id,
            count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS num_of_reads,
            count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS num_of_writes,
            count(CASE WHEN o_orderstatus = 'F' THEN 1 END) * (o_custkey % 25) + o_custkey % 2
                AS io_stall_read_ms,
            count(CASE WHEN o_orderstatus = 'O' THEN 1 END) * (o_custkey % 23) AS io_stall_write_ms,
            CAST(sum(floor(o_totalprice)) AS BIGINT) * 1000 AS size_on_disk_bytes
        FROM {{orders}} GROUP BY o_custkey""",
    "space_used": f"""
        SELECT {_PART_SRV} AS server_id, {_PART_DB} AS database_id, p_name AS table_name,
            CAST(p_partkey AS STRING) AS rows_cnt,
            CAST(p_size * 3 AS STRING) || ' KB' AS reserved,
            CAST(p_partkey * p_size AS STRING) || ' KB' AS data,
            CAST(p_size AS STRING) || ' KB' AS index_size, '0 KB' AS unused
        FROM {{part}}""",
    "sys_databases": """
        SELECT 'srv' || CAST(c_custkey % 3 AS STRING) AS server_id, c_name AS name,
            CAST(c_custkey AS INT) AS dbid,
            CASE c_mktsegment WHEN 'MACHINERY' THEN 512 WHEN 'BUILDING' THEN 16
                 WHEN 'HOUSEHOLD' THEN 32784 ELSE 0 END AS status
        FROM {customer}""",
    "sys_objects_legacy": """
        SELECT 'srv' || CAST(o_custkey % 3 AS STRING) AS server_id, CAST(o_custkey AS INT) AS database_id,
            CAST(o_orderkey AS INT) AS id, 'table' || CAST(o_orderkey AS STRING) AS name,
            CASE o_orderstatus WHEN 'P' THEN 'S' ELSE 'U' END AS xtype
        FROM {orders}""",
    "sys_indexes": """
        SELECT 'srv' || CAST(o_custkey % 3 AS STRING) AS server_id, CAST(o_custkey AS INT) AS database_id,
            CAST(o_orderkey AS INT) AS id, CAST(k AS INT) AS indid,
            CASE WHEN k = 2 AND o_orderkey % 5 = 0 THEN '_wa_sys_' ELSE 'ix' END ||
                CAST(k AS STRING) AS name,
            CAST(o_orderkey % 4096 AS INT) AS status, 90 AS origfillfactor,
            CAST(floor(o_totalprice) AS BIGINT) AS rowcnt,
            CAST(floor(o_totalprice / 10) AS BIGINT) AS reserved,
            CAST(floor(o_totalprice / 20) AS BIGINT) AS used
        FROM {orders} {each_3}""",
    "sys_index_keys": """
        SELECT 'srv' || CAST(o_custkey % 3 AS STRING) AS server_id, CAST(o_custkey AS INT) AS database_id,
            CAST(o_orderkey AS INT) AS id, CAST(1 + k % 2 AS INT) AS indid,
            CAST(1 + floor(k / 2.0) AS INT) AS keyno, CAST(1 + k AS INT) AS colid
        FROM {orders} {each_4}""",
    "sys_columns": """
        SELECT 'srv' || CAST(o_custkey % 3 AS STRING) AS server_id, CAST(o_custkey AS INT) AS database_id,
            CAST(o_orderkey AS INT) AS id, CAST(1 + k AS INT) AS colid,
            'c' || CAST(k AS STRING) AS name, CAST(50 + k * (o_orderkey % 4) AS INT) AS xtype,
            CAST(10 + k AS INT) AS xprec, CAST(k AS INT) AS xscale, CAST(o_orderkey % 2 AS INT) AS iscomputed,
            CAST(k % 2 AS INT) AS isnullable, CASE WHEN k > 1 THEN 'binary' END AS collation
        FROM {orders} {each_4}""",
    "sys_types": """
        SELECT 'srv' || CAST(c_custkey % 3 AS STRING) AS server_id, CAST(c_custkey AS INT) AS database_id,
            CAST(50 + k AS INT) AS xtype, 'type' || CAST(k AS STRING) AS name
        FROM {customer} {each_3}""",
    "backup_databases": """
        SELECT 'srv' || CAST(c_nationkey % 3 AS STRING) AS server_id,
            CAST(c_custkey AS INT) AS database_id, c_name AS name,
            CAST(100 + 10 * (c_custkey % 5) AS INT) AS compatibility_level,
            c_mktsegment AS recovery_model_desc,
            CASE WHEN c_acctbal < 0 THEN 'OFFLINE' ELSE 'ONLINE' END AS state_desc
        FROM {customer}""",
    "backup_sets": """
        SELECT 'srv' || CAST(c_nationkey % 3 AS STRING) AS server_id, c_name AS database_name,
            CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'L' ELSE 'I' END AS type,
            o_orderdate AS backup_finish_date
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "backup_media": """
        SELECT 'srv' || CAST(o_custkey % 3 AS STRING) AS server_id,
            '/backup/' || o_orderpriority || '/' || CAST(o_custkey AS STRING) AS physical_device_name
        FROM {orders}""",
    "resource_stats": """
        SELECT event_type AS server_id, ts - INTERVAL '5' MINUTE AS start_time, ts AS end_time,
            'db' || CAST(user_id % 5 AS STRING) AS database_name, value AS avg_cpu_percent,
            CASE WHEN event_id % 10 = 0 THEN NULL ELSE value / 2 END AS avg_data_io_percent,
            value * 2 AS avg_log_write_percent
        FROM {events}""",
    "edges": f"""
        SELECT 'srv0' AS server_id, c AS waiter, b AS blocker FROM ({_EDGE}) AS e""",
    # Orders wait for the customer's previous order of the same priority; the first
    # for the first of another customer, or for nobody.
    "order_waits": """
        SELECT 'srv0' AS server_id, CAST(o_custkey AS INT) AS wait_session_id,
            CAST(o_orderkey AS STRING) AS wait_task,
            CAST(CASE WHEN prev IS NOT NULL THEN o_custkey ELSE fc END AS INT) AS block_session_id,
            CAST(CASE WHEN prev IS NOT NULL THEN prev ELSE fk END AS STRING) AS block_task,
            o_orderpriority AS wait_type, CAST(floor(o_totalprice) AS BIGINT) AS wait_duration_ms
        FROM (SELECT *, lag(o_orderkey) OVER
                  (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS prev
              FROM {orders}) AS o
        LEFT JOIN (SELECT o_custkey AS fc, o_orderpriority AS fp, min(o_orderkey) AS fk
                   FROM {orders} GROUP BY o_custkey, o_orderpriority) AS f
            ON f.fc = CAST(floor(o_custkey / 3.0) AS BIGINT) AND f.fp = o_orderpriority
                AND prev IS NULL AND o_custkey > 0 AND o_orderstatus = 'F'""",
    "tran_locks": _LOCKS,
    "master_files": f"""
        SELECT {_srv('l_suppkey')} AS server_id, CAST(l_suppkey % 5 AS INT) AS database_id,
            'file' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS name,
            CASE WHEN l_linestatus = 'O' THEN 'LOG' ELSE 'ROWS' END AS type_desc,
            '/data/' || CAST(l_suppkey AS STRING) || '/' || CAST(l_partkey AS STRING)
                AS physical_name
        FROM {{lineitem}}""",
    "filegroups": f"""
        SELECT {_SUPP_SRV} AS server_id, {_SUPP_DB} AS database_id,
            'fg' || CAST(k AS STRING) AS name, CAST(s_suppkey AS INT) AS data_space_id,
            CASE WHEN k = 0 THEN 'ROWS_FILEGROUP' ELSE 'FILESTREAM' END AS type_desc
        FROM {{supplier}} {{each_4}}""",
    "configurations": f"""
        SELECT {_PART_SRV} AS server_id, CAST(p_partkey AS INT) AS configuration_id,
            p_name AS name, CAST(p_size AS BIGINT) AS value
        FROM {{part}}""",
    "logins": """
        SELECT 'srv' || CAST(c_custkey % 3 AS STRING) AS server_id, c_name AS name,
            CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS denylogin,
            CAST(c_custkey % 2 AS INT) AS isntname, CAST(c_custkey % 4 AS INT) AS isntgroup,
            CAST(c_nationkey % 2 AS INT) AS isntuser,
            CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS sysadmin,
            CASE WHEN c_nationkey = 7 THEN 1 ELSE 0 END AS securityadmin
        FROM {customer}""",
    # Sessions: a customer is a session, an order a transaction of it.
    "sessions": """
        SELECT 'srv0' AS server_id, TIMESTAMP '2024-01-01 12:00:00' AS snapshot_ts,
            CAST(c_custkey AS INT) AS session_id, c_nationkey <> 0 AS is_user_process,
            CASE WHEN c_nationkey = 1 THEN '' ELSE c_name END AS login_name,
            c_mktsegment AS original_login_name, 'sid' AS security_id, 'sid' AS original_security_id,
            'sleeping' AS status, c_nationkey AS endpoint_id,
            'host' || CAST(c_nationkey AS STRING) AS host_name,
            CAST(c_custkey % 1000 AS INT) AS host_process_id, c_mktsegment AS program_name,
            CASE WHEN c_nationkey = 2 THEN NULL ELSE 'DOM' END AS nt_domain,
            c_name AS nt_user_name, CAST(abs(floor(c_acctbal)) AS BIGINT) AS cpu_time,
            CAST(c_custkey AS BIGINT) AS reads, CAST(2 * c_custkey AS BIGINT) AS writes,
            CAST(5 * c_custkey AS BIGINT) AS logical_reads,
            TIMESTAMP '2024-01-01 08:00:00' AS login_time,
            CASE WHEN c_nationkey < 5 THEN TIMESTAMP '2023-11-01 07:00:00'
                 ELSE TIMESTAMP '2024-01-01 11:59:30' END AS last_request_start_time,
            TRUE AS quoted_identifier, c_nationkey = 3 AS arithabort, TRUE AS ansi_null_dflt_on,
            FALSE AS ansi_defaults, c_nationkey <> 4 AS ansi_warnings, TRUE AS ansi_padding,
            TRUE AS ansi_nulls, TRUE AS concat_null_yields_null,
            CAST(c_nationkey % 6 AS SMALLINT) AS transaction_isolation_level, -1 AS lock_timeout,
            CAST(c_nationkey % 3 - 1 AS INT) AS deadlock_priority
        FROM {customer}""",
    "session_process": """
        SELECT 'srv0' AS server_id, TIMESTAMP '2024-01-01 12:00:00' AS snapshot_ts,
            CAST(c_custkey AS INT) AS spid, CAST(k AS INT) AS ecid,
            CAST(c_custkey % 5 AS INT) AS dbid,
            CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS open_tran
        FROM {customer} {each_2}""",
    "tasks": """
        SELECT 'srv0' AS server_id, TIMESTAMP '2024-01-01 12:00:00' AS snapshot_ts,
            't' || CAST(c_custkey AS STRING) AS task_address,
            CAST(NULL AS STRING) AS parent_task_address, CAST(c_custkey AS INT) AS session_id,
            CASE WHEN c_nationkey = 5 THEN 1 ELSE 0 END AS exec_context_id, 0 AS request_id,
            'SUSPENDED' AS task_state
        FROM {customer} WHERE c_mktsegment <> 'MACHINERY' AND c_acctbal > 1000
        UNION ALL
        SELECT 'srv0', TIMESTAMP '2024-01-01 12:00:00', 's' || CAST(s_suppkey AS STRING),
            't' || CAST(s_suppkey AS STRING), CAST(NULL AS INT), 2, 0, 'RUNNING'
        FROM {supplier} WHERE s_acctbal > 5000""",
    "requests": """
        SELECT 'srv0' AS server_id, TIMESTAMP '2024-01-01 12:00:00' AS snapshot_ts,
            CAST(c_custkey AS INT) AS session_id, CASE WHEN c_nationkey = 6 THEN 1 ELSE 0 END AS request_id,
            't' || CAST(c_custkey AS STRING) AS task_address, 'running' AS status,
            CASE WHEN c_nationkey < 10 THEN 'SELECT' ELSE 'UPDATE' END AS command,
            CAST(c_custkey % 5 AS INT) AS database_id,
            CAST(c_custkey * 3 AS BIGINT) AS cpu_time, CAST(c_custkey * 7 % 1000 AS BIGINT) AS total_elapsed_time,
            CAST(c_nationkey AS BIGINT) AS reads, CAST(1 AS BIGINT) AS writes,
            CAST(c_custkey AS BIGINT) AS logical_reads, CAST(c_custkey % 101 AS DOUBLE) AS percent_complete,
            CAST(c_custkey % 3 AS INT) AS open_transaction_count, c_nationkey = 8 AS executing_managed_code,
            CAST(c_custkey % 4 AS INT) AS nest_level, CAST(c_custkey AS STRING) AS sql_handle,
            CAST(c_custkey AS STRING) AS plan_handle, CAST(2 * (c_custkey % 4) AS INT) AS statement_start_offset,
            CAST(CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 20 END AS INT) AS statement_end_offset,
            TRUE AS quoted_identifier, FALSE AS arithabort, TRUE AS ansi_null_dflt_on,
            FALSE AS ansi_defaults, TRUE AS ansi_warnings, TRUE AS ansi_padding, TRUE AS ansi_nulls,
            TRUE AS concat_null_yields_null, CAST(2 AS SMALLINT) AS transaction_isolation_level,
            CAST(c_custkey % 7 * 100 AS INT) AS lock_timeout, 0 AS deadlock_priority
        FROM {customer} WHERE c_mktsegment <> 'MACHINERY' AND c_acctbal > 1000""",
    "session_space": """
        SELECT 'srv0' AS server_id, TIMESTAMP '2024-01-01 12:00:00' AS snapshot_ts,
            CAST(c_custkey AS INT) AS session_id, CAST(c_custkey AS BIGINT) AS user_objects_alloc_page_count,
            CAST(c_custkey % 300 AS BIGINT) AS user_objects_dealloc_page_count,
            CAST(7 AS BIGINT) AS internal_objects_alloc_page_count,
            CAST(2 AS BIGINT) AS internal_objects_dealloc_page_count
        FROM {customer}""",
    "task_space": """
        SELECT 'srv0' AS server_id, TIMESTAMP '2024-01-01 12:00:00' AS snapshot_ts,
            CAST(o_custkey AS INT) AS session_id, 0 AS request_id, 2 AS database_id,
            CAST(floor(o_totalprice) AS BIGINT) AS user_objects_alloc_page_count,
            CAST(0 AS BIGINT) AS user_objects_dealloc_page_count,
            CAST(0 AS BIGINT) AS internal_objects_alloc_page_count,
            CAST(0 AS BIGINT) AS internal_objects_dealloc_page_count
        FROM {orders}""",
    "session_transactions": """
        SELECT 'srv0' AS server_id, TIMESTAMP '2024-01-01 12:00:00' AS snapshot_ts,
            CAST(o_custkey AS INT) AS session_id, o_orderkey AS transaction_id,
            o_orderstatus <> 'P' AS is_user_transaction, o_orderpriority = '5-LOW' AS is_bound
        FROM {orders}""",
    "active_transactions": """
        SELECT 'srv0' AS server_id, TIMESTAMP '2024-01-01 12:00:00' AS snapshot_ts,
            o_orderkey AS transaction_id,
            CASE WHEN o_custkey % 2 = 0 THEN o_orderdate
                 ELSE TIMESTAMP '2024-01-01 11:00:00' END AS transaction_begin_time,
            CAST(1 + o_orderkey % 5 AS INT) AS transaction_type,
            CAST(o_orderkey % 8 AS INT) AS transaction_state, CAST(o_orderkey % 7 AS INT) AS dtc_state
        FROM {orders} WHERE o_orderstatus <> 'O'""",
    "waiting_tasks": f"""
        SELECT 'srv0' AS server_id, TIMESTAMP '2024-01-01 12:00:00' AS snapshot_ts,
            CAST(c AS INT) AS session_id, 't' || CAST(c AS STRING) AS waiting_task_address,
            CAST(b AS INT) AS blocking_session_id, 't' || CAST(b AS STRING) AS blocking_task_address,
            'o' || CAST(c AS STRING) AS resource_address, 'LCK_M_X' AS wait_type,
            CAST(c * 17 AS BIGINT) AS wait_duration_ms
        FROM ({_EDGE}) AS e
        UNION ALL
        SELECT 'srv0', TIMESTAMP '2024-01-01 12:00:00', CAST(NULL AS INT),
            's' || CAST(s_suppkey AS STRING), CAST(NULL AS INT), CAST(NULL AS STRING),
            CAST(NULL AS STRING),
            CASE WHEN s_nationkey < 12 THEN 'CLR_AUTO_EVENT' ELSE 'LOGMGR_QUEUE' END,
            CAST(s_suppkey AS BIGINT)
        FROM {{supplier}}""",
    "endpoints": """
        SELECT 'srv0' AS server_id, TIMESTAMP '2024-01-01 12:00:00' AS snapshot_ts,
            n_nationkey AS endpoint_id, n_name AS name FROM {nation}""",
    "last_command": """
        SELECT 'srv0' AS server_id, TIMESTAMP '2024-01-01 12:00:00' AS snapshot_ts,
            CAST(c_custkey AS INT) AS session_id, 'EXEC ' || c_mktsegment AS inputbuffer
        FROM {customer} WHERE c_nationkey > 3""",
}

# Wait types under real names, idle ones among them.
_WAIT_NAMES = ("PAGEIOLATCH_SH", "LCK_M_X", "CXPACKET", "WRITELOG", "ASYNC_NETWORK_IO", "SOS_SCHEDULER_YIELD", *MORE_IDLE_WAITS)
VIEWS["named_waits"] = f"""
        SELECT l_returnflag AS server_id,
            CASE p_partkey % {len(_WAIT_NAMES) + 4} {" ".join(f"WHEN {n} THEN '{w}'" for n, w in enumerate(_WAIT_NAMES))} ELSE p_brand END AS wait_type,
            CAST(sum(floor(l_quantity)) AS BIGINT) AS wait_time_ms
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey GROUP BY 1, 2"""


def _at(step: str) -> str:
    return f"TIMESTAMP '2024-01-01 12:00:00' + k * INTERVAL {step}"


def _grown(counter: str, restarts: str) -> str:
    """A counter at collection k of 0 to 3; where ``restarts`` holds, it began anew after the second."""
    return (f"CAST(floor(CASE WHEN {restarts} AND k > 1 THEN {counter} * (k - 1) "
            f"ELSE {counter} * (k + 1) END / 4.0) AS BIGINT) AS {counter}")


# Counters collected four times, ten hours apart, and statements collected on three days.
VIEWS["wait_series"] = f"""
        SELECT server_id, wait_type, {_at("'10' HOUR")} AS snapshot_ts,
            {_grown('wait_time_ms', "server_id = 'R'")}
        FROM ({VIEWS['wait_stats']}) AS v {{each_4}}"""
VIEWS["io_series"] = f"""
        SELECT server_id, database_id, file_id, {_at("'10' HOUR")} AS snapshot_ts,
            {_grown('num_of_reads', "server_id = 'srv1'")}, {_grown('num_of_writes', "server_id = 'srv1'")},
            {_grown('io_stall_read_ms', "server_id = 'srv1'")}, {_grown('io_stall_write_ms', "server_id = 'srv1'")}
        FROM (SELECT {_srv('o_custkey')} AS server_id, CAST(o_custkey % 5 AS INT) AS database_id,
                  CAST(o_custkey AS INT) AS file_id,
                  count(CASE WHEN o_orderstatus = 'F' THEN 1 END) * 12 AS num_of_reads,
                  count(CASE WHEN o_orderstatus = 'O' THEN 1 END) * 12 AS num_of_writes,
                  count(CASE WHEN o_orderstatus = 'F' THEN 1 END) * (o_custkey % 250) AS io_stall_read_ms,
                  count(CASE WHEN o_orderstatus = 'O' THEN 1 END) * (o_custkey % 230) AS io_stall_write_ms
              FROM {{orders}} GROUP BY o_custkey) AS v {{each_4}}"""
VIEWS["usage_series"] = f"""
        SELECT server_id, database_id, object_id, index_id, {_at("'10' HOUR")} AS snapshot_ts,
            {', '.join(_grown(c, "server_id = 'srv2'") for c in (
                'user_seeks', 'user_scans', 'user_lookups', 'user_updates', 'system_updates'))}
        FROM ({VIEWS['index_usage']}) AS v {{each_4}}"""
VIEWS["stats_series"] = f"""
        SELECT server_id, sql_handle, plan_handle, statement_start_offset, statement_end_offset,
            {_at("'1' DAY")} AS snapshot_ts,
            {', '.join(_grown(c, "sql_handle LIKE '%7'") for c in (
                'execution_count', 'total_worker_time', 'total_elapsed_time', 'total_physical_reads',
                'total_logical_reads', 'total_logical_writes'))}
        FROM ({VIEWS['query_stats']}) AS v {{each_4}} WHERE execution_count > 3"""
# Catalogs looked up at times of their own: some rows only the first time, some only the second.
VIEWS["text_versions"] = f"""
        SELECT server_id, sql_handle, plan_handle, dbid, objectid, encrypted,
            CASE WHEN k = 0 THEN text ELSE text || ' -- again' END AS text,
            TIMESTAMP '2023-12-31 06:00:00' + k * INTERVAL '2' DAY AS snapshot_ts
        FROM ({VIEWS['query_text']}) AS v {{each_2}}
        WHERE NOT (sql_handle LIKE '%3' AND k = 0) AND NOT (sql_handle LIKE '%5' AND k = 1)"""
VIEWS["plan_versions"] = f"""
        SELECT server_id, plan_handle, query_plan,
            TIMESTAMP '2023-12-30 06:00:00' + k * INTERVAL '36' HOUR AS snapshot_ts
        FROM ({VIEWS['query_plan']}) AS v {{each_3}} WHERE plan_handle NOT LIKE '%8' OR k <> 1"""
VIEWS["database_versions"] = f"""
        SELECT server_id, database_id, name || CAST(k AS STRING) AS name,
            TIMESTAMP '2024-01-01 06:00:00' + k * INTERVAL '36' HOUR AS snapshot_ts
        FROM ({VIEWS['databases']}) AS v {{each_2}}
        WHERE server_id <> 'srv2' OR k = 1"""

def _of_one_server(view: str) -> str:
    """A catalog of the fleet as that of the server of the session snapshot, whose keys are all the fleet's."""
    return f"SELECT 'srv0' AS server_id, v.* FROM (SELECT {_REST[view]} FROM ({VIEWS[view]}) AS u) AS v"


_REST = {
    "text_versions": "sql_handle, plan_handle, dbid, objectid, encrypted, text, snapshot_ts",
    "plan_versions": "plan_handle, query_plan, snapshot_ts",
    "database_versions": "DISTINCT database_id, name, snapshot_ts",
}
for _view in _REST:
    VIEWS[f"all_{_view}"] = _of_one_server(_view)

# Tables of the session snapshot that are the fleet's, seen from its one server.
_OF_SRV0 = ("query_text", "query_plan", "databases", "schemas", "objects", "indexes",
            "partitions", "allocation_units")
_FLEET = {
    "db_resource_stats": "resource_stats",
}
_PLAN_CACHE = {
    "cached_plans": "order_plans", "query_stats": "order_stats", "query_text": "order_text",
    "query_plan": "order_plan_xml", "databases": "databases",
}
_BACKUPS = {
    "databases": "backup_databases", "backup_sets": "backup_sets", "backup_media": "backup_media",
}
_SESSIONS = (
    "tran_locks", "sessions", "session_process", "tasks", "requests", "session_space",
    "task_space", "session_transactions", "active_transactions", "waiting_tasks", "endpoints",
    "last_command",
)

_EACH = re.compile(r"\{each_(\d+)\}")


def duckdb_view(name: str) -> str:
    """The view's SELECT for DuckDB."""
    sql = _EACH.sub(lambda m: f", unnest(range({m[1]})) AS each_row(k)", view(name))
    return sql.format(**{t: t for t in TABLES})


def with_views(*names: str) -> str:
    """A WITH clause that defines views; "x AS y" defines view y under the name x."""
    parts = []
    for n in names:
        alias, _, source = n.partition(" AS ")
        parts.append(f"{alias} AS ({duckdb_view(source or alias)})")
    return "WITH RECURSIVE " + ",\n".join(parts)


def view(name: str) -> str:
    """Template of a view; ``s0_<view>`` is the part of it that server srv0 has,
    with the time of the session snapshot."""
    if name.startswith("s0_"):
        inner = view(name[3:])
        return (
            "SELECT v.*, TIMESTAMP '2024-01-01 12:00:00' AS snapshot_ts "
            f"FROM ({inner}) AS v WHERE server_id = 'srv0'"
        )
    return VIEWS[name]


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = _EACH.sub(
        lambda m: f"LATERAL VIEW explode(sequence(0, {int(m[1]) - 1})) each_row AS k", view(name)
    )
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def _snapshot(spark, sf_dir, names: dict, keys) -> Snapshot:
    return Snapshot(
        {n: (lambda v=v: spark_view(spark, sf_dir, v)) for n, v in names.items()}, keys
    )


def fleet(spark: SparkSession, sf_dir: str) -> Snapshot:
    """Waits, queries, indexes, storage and resources of several servers."""
    return _snapshot(spark, sf_dir, {**{n: n for n in VIEWS}, **_FLEET}, ("server_id",))


#: Columns that grow from collection to collection.
_COUNTERS = ("wait_time_ms", "execution_count", "total_logical_reads", "total_logical_writes",
             "total_physical_reads", "total_worker_time", "total_elapsed_time")


def collections(spark: SparkSession, sf_dir: str) -> Snapshot:
    """The fleet collected on three days; the last is as in ``fleet``, counters were smaller before."""
    def thrice(name):
        df = spark_view(spark, sf_dir, name)
        day = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("day")
        df = df.select("*", day).withColumn(
            "snapshot_ts", F.timestamp_add("DAY", "day", F.lit("2024-01-01 12:00:00").cast("timestamp"))
        )
        grown = {c: F.call_function("div", F.col(c) * (F.col("day") + 1), F.lit(3))
                 for c in _COUNTERS if c in df.columns}
        return df.withColumns(grown).drop("day") if grown else df.drop("day")

    names = {**{n: n for n in VIEWS}, **_FLEET}
    return Snapshot({n: (lambda v=v: thrice(v)) for n, v in names.items()}, ("server_id", "snapshot_ts"))


def plan_cache(spark: SparkSession, sf_dir: str) -> Snapshot:
    """Orders as cached plans."""
    return _snapshot(spark, sf_dir, _PLAN_CACHE, ("server_id",))


def backups(spark: SparkSession, sf_dir: str) -> Snapshot:
    """Customers as databases, orders as backups."""
    return _snapshot(spark, sf_dir, _BACKUPS, ("server_id",))


def sessions(spark: SparkSession, sf_dir: str) -> Snapshot:
    """Locks, waits and sessions of one busy server at one moment."""
    names = {**{n: n for n in _SESSIONS}, **{n: f"s0_{n}" for n in _OF_SRV0}}
    return _snapshot(spark, sf_dir, names, ("server_id", "snapshot_ts"))


def series(spark: SparkSession, sf_dir: str) -> Snapshot:
    """Counters collected again and again, with restarts in between."""
    names = {"wait_stats": "wait_series", "file_io_stats": "io_series", "index_usage": "usage_series",
             "query_stats": "stats_series"}
    return _snapshot(spark, sf_dir, names, ("server_id", "snapshot_ts"))


#: Catalogs with times of their own, by the table they stand for.
VERSIONS = {"query_text": "text_versions", "query_plan": "plan_versions", "databases": "database_versions"}


def drifting(spark: SparkSession, sf_dir: str) -> Snapshot:
    """Statements of several days over catalogs collected at other times."""
    return as_of(_snapshot(spark, sf_dir, {"query_stats": "stats_series", **VERSIONS}, ("server_id", "snapshot_ts")))


def drifting_sessions(spark: SparkSession, sf_dir: str) -> Snapshot:
    """The session snapshot over catalogs of its server collected at other times."""
    names = {**{n: n for n in _SESSIONS}, **{n: f"all_{v}" for n, v in VERSIONS.items()}}
    return as_of(_snapshot(spark, sf_dir, names, ("server_id", "snapshot_ts")))
