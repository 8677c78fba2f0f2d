"""Declared schemas of the snapshot tables.

Column names follow the server's own views. Every table starts with the snapshot
keys; handles and addresses are hex strings.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

KEYS = ("server_id", "snapshot_ts")
_KEY_DDL = "server_id STRING NOT NULL, snapshot_ts TIMESTAMP NOT NULL"

_COUNTERS = ", ".join(
    f"{part}_{what} BIGINT"
    for what in ("worker_time", "elapsed_time", "physical_reads", "logical_reads", "logical_writes")
    for part in ("total", "min", "max", "last")
)
_SET_OPTIONS = (
    "quoted_identifier BOOLEAN, arithabort BOOLEAN, ansi_null_dflt_on BOOLEAN, "
    "ansi_defaults BOOLEAN, ansi_warnings BOOLEAN, ansi_padding BOOLEAN, ansi_nulls BOOLEAN, "
    "concat_null_yields_null BOOLEAN, transaction_isolation_level SMALLINT, "
    "lock_timeout INT, deadlock_priority INT"
)
_PAGE_COUNTS = (
    "user_objects_alloc_page_count BIGINT, user_objects_dealloc_page_count BIGINT, "
    "internal_objects_alloc_page_count BIGINT, internal_objects_dealloc_page_count BIGINT"
)

_TABLES = {
    # waits and query statistics
    "wait_stats": "wait_type STRING, wait_time_ms BIGINT",
    "query_stats": (
        "sql_handle STRING, plan_handle STRING, query_hash STRING, query_plan_hash STRING, "
        "statement_start_offset INT, statement_end_offset INT, creation_time TIMESTAMP, "
        f"last_execution_time TIMESTAMP, execution_count BIGINT, {_COUNTERS}, total_clr_time BIGINT"
    ),
    "query_text": (
        "sql_handle STRING, plan_handle STRING, dbid INT, objectid INT, text STRING, "
        "encrypted BOOLEAN"
    ),
    "query_plan": "plan_handle STRING, query_plan STRING",
    "cached_plans": (
        "plan_handle STRING, objtype STRING, cacheobjtype STRING, refcounts INT, usecounts INT, "
        "size_in_bytes BIGINT"
    ),
    # catalog
    "databases": (
        "database_id INT, name STRING, compatibility_level INT, recovery_model_desc STRING, "
        "state_desc STRING"
    ),
    "schemas": "database_id INT, schema_id INT, name STRING",
    "objects": (
        "database_id INT, object_id INT, schema_id INT, name STRING, type STRING, "
        "is_ms_shipped BOOLEAN"
    ),
    "indexes": (
        "database_id INT, object_id INT, index_id INT, name STRING, type_desc STRING, "
        "fill_factor INT, is_padded BOOLEAN, data_space_id INT"
    ),
    "partitions": (
        "database_id INT, partition_id BIGINT, hobt_id BIGINT, object_id INT, index_id INT, "
        "partition_number INT, rows BIGINT"
    ),
    "allocation_units": (
        "database_id INT, allocation_unit_id BIGINT, container_id BIGINT, type INT, "
        "type_desc STRING, total_pages BIGINT"
    ),
    "partition_functions": (
        "database_id INT, function_id INT, name STRING, boundary_value_on_right BOOLEAN, fanout INT"
    ),
    "partition_schemes": (
        "database_id INT, data_space_id INT, name STRING, function_id INT, is_default BOOLEAN"
    ),
    "partition_range_values": (
        "database_id INT, function_id INT, boundary_id INT, parameter_id INT, value STRING"
    ),
    "partition_parameters": (
        "database_id INT, function_id INT, parameter_id INT, system_type_id INT, max_length INT, "
        "precision INT, scale INT"
    ),
    "destination_data_spaces": (
        "database_id INT, partition_scheme_id INT, destination_id INT, data_space_id INT"
    ),
    "data_spaces": "database_id INT, data_space_id INT, name STRING",
    "types": "database_id INT, system_type_id INT, user_type_id INT, name STRING",
    # indexes
    "index_usage": (
        "database_id INT, object_id INT, index_id INT, user_seeks BIGINT, user_scans BIGINT, "
        "user_lookups BIGINT, user_updates BIGINT, system_updates BIGINT"
    ),
    "index_physical_stats": (
        "database_id INT, object_id INT, index_id INT, index_type_desc STRING, index_depth INT, "
        "index_level INT, page_count BIGINT, record_count BIGINT, "
        "avg_fragmentation_in_percent DOUBLE"
    ),
    "missing_index_groups": "index_group_handle INT, index_handle INT",
    "missing_index_group_stats": (
        "group_handle INT, avg_total_user_cost DOUBLE, avg_user_impact DOUBLE, user_seeks BIGINT, "
        "user_scans BIGINT, unique_compiles BIGINT, last_user_seek TIMESTAMP, "
        "last_user_scan TIMESTAMP"
    ),
    "missing_index_details": (
        "index_handle INT, database_id INT, object_id INT, statement STRING, "
        "equality_columns STRING, inequality_columns STRING, included_columns STRING"
    ),
    "partition_stats": (
        "database_id INT, object_id INT, index_id INT, partition_number INT, "
        "used_page_count BIGINT, row_count BIGINT"
    ),
    # memory, files, disk, backups
    "buffer_pages": "database_id INT, allocation_unit_id BIGINT",
    "file_io_stats": (
        "database_id INT, file_id INT, num_of_reads BIGINT, num_of_writes BIGINT, "
        "io_stall_read_ms BIGINT, io_stall_write_ms BIGINT, size_on_disk_bytes BIGINT"
    ),
    "space_used": (
        "database_id INT, table_name STRING, rows_cnt STRING, reserved STRING, data STRING, "
        "index_size STRING, unused STRING"
    ),
    "sys_databases": "name STRING, dbid INT, status INT",
    "sys_objects_legacy": "database_id INT, id INT, name STRING, xtype STRING",
    "sys_indexes": (
        "database_id INT, id INT, indid INT, name STRING, status INT, origfillfactor INT, "
        "rowcnt BIGINT, reserved BIGINT, used BIGINT"
    ),
    "sys_index_keys": "database_id INT, id INT, indid INT, keyno INT, colid INT",
    "sys_columns": (
        "database_id INT, id INT, colid INT, name STRING, xtype INT, xprec INT, xscale INT, "
        "iscomputed INT, isnullable INT, collation STRING"
    ),
    "sys_types": "database_id INT, xtype INT, name STRING",
    "backup_sets": "database_name STRING, type STRING, backup_finish_date TIMESTAMP",
    "backup_media": "physical_device_name STRING",
    # resource series
    "db_resource_stats": (
        "start_time TIMESTAMP, end_time TIMESTAMP, database_name STRING, avg_cpu_percent DOUBLE, "
        "avg_data_io_percent DOUBLE, avg_log_write_percent DOUBLE"
    ),
    "resource_stats": (
        "start_time TIMESTAMP, end_time TIMESTAMP, database_name STRING, avg_cpu_percent DOUBLE, "
        "avg_data_io_percent DOUBLE, avg_log_write_percent DOUBLE"
    ),
    # locks, waits and sessions
    "tran_locks": (
        "request_session_id INT, resource_database_id INT, resource_associated_entity_id BIGINT, "
        "request_mode STRING, request_type STRING, request_status STRING, "
        "request_owner_type STRING, resource_type STRING, resource_subtype STRING, "
        "resource_description STRING, lock_owner_address STRING"
    ),
    "waiting_tasks": (
        "session_id INT, waiting_task_address STRING, blocking_session_id INT, "
        "blocking_task_address STRING, resource_address STRING, wait_type STRING, "
        "wait_duration_ms BIGINT"
    ),
    "tasks": (
        "task_address STRING, parent_task_address STRING, session_id INT, exec_context_id INT, "
        "request_id INT, task_state STRING"
    ),
    "requests": (
        "session_id INT, request_id INT, task_address STRING, status STRING, command STRING, "
        "database_id INT, cpu_time BIGINT, total_elapsed_time BIGINT, reads BIGINT, "
        "writes BIGINT, logical_reads BIGINT, percent_complete DOUBLE, "
        "open_transaction_count INT, executing_managed_code BOOLEAN, nest_level INT, "
        "sql_handle STRING, plan_handle STRING, statement_start_offset INT, "
        f"statement_end_offset INT, {_SET_OPTIONS}"
    ),
    "sessions": (
        "session_id INT, is_user_process BOOLEAN, login_name STRING, original_login_name STRING, "
        "security_id STRING, original_security_id STRING, status STRING, endpoint_id INT, "
        "host_name STRING, host_process_id INT, program_name STRING, nt_domain STRING, "
        "nt_user_name STRING, cpu_time BIGINT, reads BIGINT, writes BIGINT, logical_reads BIGINT, "
        f"login_time TIMESTAMP, last_request_start_time TIMESTAMP, {_SET_OPTIONS}"
    ),
    "session_process": "spid INT, ecid INT, dbid INT, open_tran INT",
    "session_space": f"session_id INT, {_PAGE_COUNTS}",
    "task_space": f"session_id INT, request_id INT, database_id INT, {_PAGE_COUNTS}",
    "session_transactions": (
        "session_id INT, transaction_id BIGINT, is_user_transaction BOOLEAN, is_bound BOOLEAN"
    ),
    "active_transactions": (
        "transaction_id BIGINT, transaction_begin_time TIMESTAMP, transaction_type INT, "
        "transaction_state INT, dtc_state INT"
    ),
    "endpoints": "endpoint_id INT, name STRING",
    "last_command": "session_id INT, inputbuffer STRING",
    # inventory
    "master_files": "database_id INT, name STRING, type_desc STRING, physical_name STRING",
    "filegroups": (
        "database_id INT, name STRING, data_space_id INT, type STRING, type_desc STRING, "
        "is_default BOOLEAN, is_read_only BOOLEAN"
    ),
    "configurations": (
        "configuration_id INT, name STRING, value BIGINT, minimum BIGINT, maximum BIGINT, "
        "value_in_use BIGINT, description STRING, is_dynamic BOOLEAN, is_advanced BOOLEAN"
    ),
    "logins": (
        "sid STRING, name STRING, denylogin INT, isntname INT, isntgroup INT, isntuser INT, "
        "sysadmin INT, securityadmin INT"
    ),
}


def schema(table: str) -> StructType:
    """Declared schema of a snapshot table, keys first."""
    return StructType.fromDDL(f"{_KEY_DDL}, {_TABLES[table]}")


def tables() -> list[str]:
    return list(_TABLES)
