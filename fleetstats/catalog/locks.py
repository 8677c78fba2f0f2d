"""The lock report and its steps, on customers as sessions of one busy server.

The oracle of the whole report is the chain of the oracles of its steps.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..plans import locks as lk, lock_steps as ls, queries as qs
from ..sources import Snapshot, open_snapshot, publish, restrict, scratch_dir
from ..streaming import arrivals, lock_overview_stream
from .generic import LEVELS
from .registry import query
from .reports import stmt
from .views import sessions, spark_view

_OWN = 11  # the collector's session
_KEYS = ["server_id", "snapshot_ts"]
_NOW = "TIMESTAMP '2024-01-01 12:00:00'"
_VIEWS = [
    "tran_locks", "waiting_tasks", "sessions", "session_process", "tasks", "requests",
    "session_space", "task_space", "session_transactions", "active_transactions", "endpoints",
    "last_command", *[f"{t} AS s0_{t}" for t in (
        "query_text", "query_plan", "databases", "schemas", "objects", "indexes", "partitions",
        "allocation_units")],
]


def _snap(spark, sf_dir) -> Snapshot:
    return sessions(spark, sf_dir)


def _bare(df):
    """Without the snapshot keys, which are the same in every row."""
    return df.drop(*_KEYS)


# --- oracles, step by step ----------------------------------------------------------

_K_LOCKS = """, k_locks AS MATERIALIZED (
    SELECT request_session_id AS session_id, request_mode AS req_mode, resource_type AS rsc_type,
        resource_subtype AS rsc_subtype, request_status AS req_status,
        request_owner_type AS req_owner_type,
        CASE WHEN resource_type = 'APPLICATION' THEN nullif(resource_description, '') END
            AS rsc_description,
        resource_database_id AS database_id, resource_associated_entity_id AS entity_id,
        count(*) AS cnt, NOT (resource_type = 'DATABASE' AND request_status = 'GRANT') AS activelock
    FROM tran_locks GROUP BY ALL)
"""
_K_WAITS = f""", k_waits AS MATERIALIZED (
    SELECT session_id AS wait_session_id, waiting_task_address AS wait_task,
        blocking_session_id AS block_session_id,
        CASE WHEN blocking_session_id IS NOT NULL THEN coalesce(blocking_task_address, '') END
            AS block_task, wait_type, wait_duration_ms
    FROM waiting_tasks WHERE session_id IS NOT NULL
    UNION ALL
    SELECT -1000 - row_number() OVER (ORDER BY waiting_task_address), waiting_task_address, NULL,
        NULL, wait_type, wait_duration_ms
    FROM waiting_tasks WHERE session_id IS NULL AND wait_type NOT IN {ls.SYSTEM_TASK_WAITS})
"""
_K_TRANS = f""", k_trans AS MATERIALIZED (
    SELECT session_id, is_user_transaction AS is_user_trans, transaction_begin_time AS trans_start,
        CASE WHEN date_diff('day', transaction_begin_time, {_NOW}) <= 20
             THEN date_diff('millisecond', transaction_begin_time, {_NOW}) / 1000.0 END AS trans_since,
        transaction_type AS trans_type, transaction_state AS trans_state, dtc_state, is_bound
    FROM session_transactions s JOIN active_transactions a ON a.transaction_id = s.transaction_id
    QUALIFY row_number() OVER (PARTITION BY session_id
        ORDER BY transaction_begin_time, s.transaction_id) = 1)
"""
_PAGES = ("user_objects_alloc_page_count - user_objects_dealloc_page_count "
          "+ internal_objects_alloc_page_count - internal_objects_dealloc_page_count")
_OPTIONS = [c for c in ls.SETTINGS if c not in ("lock_timeout", "deadlock_priority")]
#: Which processes and locks the report leaves out unless asked for all.
_LISTED = f"""WHERE (t.exec_context_id IS NOT NULL AND s.is_user_process AND s.session_id <> {_OWN})
        OR (p.open_tran > 0 AND s.session_id <> {_OWN})
        OR (s.session_id IN (SELECT session_id FROM k_locks WHERE activelock)
            AND s.session_id <> {_OWN})
        OR s.session_id IN (SELECT block_session_id FROM k_waits WHERE block_session_id IS NOT NULL)
        OR z.pages > 1000"""
_LOCKED = f"""WHERE (activelock AND session_id <> {_OWN})
        OR session_id IN (SELECT session_id FROM k_statements)"""
_K_PROCS = f""", k_procs AS MATERIALIZED (
    SELECT s.session_id, coalesce(t.task_address, '') AS task_address,
        coalesce(t.exec_context_id, 0) AS exec_context_id, coalesce(r.request_id, 0) AS request_id,
        s.is_user_process, nullif(s.login_name, '') AS current_login,
        nullif(s.original_login_name, '') AS orig_login, s.status AS session_state, t.task_state,
        s.endpoint_id, p.dbid AS proc_dbid, r.database_id AS request_dbid, s.host_name,
        s.host_process_id, s.program_name, r.command AS request_command,
        coalesce(r.open_transaction_count, p.open_tran) AS trancount,
        s.cpu_time AS session_cpu, r.cpu_time AS request_cpu,
        s.reads + s.writes AS session_physio, r.reads + r.writes AS request_physio,
        s.logical_reads AS session_logreads, r.logical_reads AS request_logreads,
        z.pages AS session_tempdb, q.pages AS request_tempdb,
        nullif(r.percent_complete, 0) AS percent_complete,
        {', '.join(f'coalesce(r.{c}, s.{c}) AS {c}' for c in _OPTIONS)},
        nullif(coalesce(r.lock_timeout, s.lock_timeout), -1) AS lock_timeout,
        nullif(coalesce(r.deadlock_priority, s.deadlock_priority), 0) AS deadlock_priority,
        coalesce(r.executing_managed_code, FALSE) AS executing_managed_code, r.nest_level, s.login_time,
        s.last_request_start_time AS last_batch,
        CASE WHEN date_diff('day', s.last_request_start_time, {_NOW}) <= 20
             THEN date_diff('millisecond', s.last_request_start_time, {_NOW}) / 1000.0 END
            AS last_since,
        r.sql_handle, r.plan_handle, r.statement_start_offset AS stmt_start,
        r.statement_end_offset AS stmt_end
    FROM sessions s
    JOIN (SELECT spid, min(dbid) AS dbid, min(open_tran) AS open_tran FROM session_process
          WHERE ecid = 0 GROUP BY spid) p ON p.spid = s.session_id
    LEFT JOIN tasks t ON t.session_id = s.session_id
    LEFT JOIN requests r ON r.task_address = t.task_address
    LEFT JOIN (SELECT session_id, {_PAGES} AS pages FROM session_space) z
        ON z.session_id = s.session_id
    LEFT JOIN (SELECT session_id, request_id, sum({_PAGES})::BIGINT AS pages FROM task_space
               WHERE database_id = 2 GROUP BY session_id, request_id) q
        ON q.session_id = r.session_id AND q.request_id = r.request_id
    {_LISTED})
"""
_K_SESSIONLESS = """, k_sessionless AS MATERIALIZED (
    SELECT coalesce(pt.session_id, w.wait_session_id) AS session_id,
        coalesce(t.task_address, '') AS task_address,
        CASE WHEN pt.session_id IS NOT NULL THEN -9 ELSE 0 END AS exec_context_id, 0 AS request_id,
        coalesce(t.task_state, 'EXITED') AS task_state, wait_duration_ms / 1000.0 AS wait_time,
        wait_type, 0 AS trancount, 2 AS transaction_isolation_level, FALSE AS executing_managed_code
    FROM k_waits w LEFT JOIN tasks t ON t.task_address = w.wait_task
    LEFT JOIN tasks pt ON pt.task_address = t.parent_task_address
    WHERE w.wait_session_id < -1000)
"""
# Levels by session number; the task of session n is "tn".
_K_CHAINS = (
    ", raw AS (SELECT wait_session_id AS w, block_session_id AS b FROM k_waits "
    "WHERE wait_session_id >= -1000)" + LEVELS + """
    , shared AS (SELECT DISTINCT lead FROM chain WHERE lead <> w),
    k_chains AS MATERIALIZED (
        SELECT w AS wait_session_id, 't' || w AS wait_task, b AS block_session_id,
            't' || b AS block_task, level, lead,
            coalesce(w = lead AND w NOT IN (SELECT lead FROM shared), FALSE) AS same_session_only,
            CASE WHEN level < 0 THEN 1 + level - min(level) OVER () ELSE level END AS block_level,
            wait_type, wait_duration_ms
        FROM chain LEFT JOIN k_waits ON wait_session_id = w AND block_session_id = b)
""")
_LABEL = ("|| CASE WHEN {c} <> 0 OR {r} <> 0 THEN '/' || {c} || '/' || {r} ELSE '' END")
_K_ATTACHED = """, k_all AS MATERIALIZED (
    SELECT * FROM k_procs UNION ALL BY NAME SELECT * FROM k_sessionless),
    k_picked AS (
        SELECT c.*, coalesce(p.exec_context_id, -1) AS bc, coalesce(p.request_id, -1) AS br,
            count(*) OVER (PARTITION BY wait_task) AS blocker_count,
            row_number() OVER (PARTITION BY wait_task ORDER BY level NULLS FIRST, block_task) AS n
        FROM k_chains c
        LEFT JOIN k_all p ON p.session_id = c.block_session_id AND p.task_address = c.block_task),
    k_attached AS MATERIALIZED (
        SELECT p.* EXCLUDE (wait_time, wait_type), c.block_level, c.block_session_id,
            c.bc AS block_exec_context_id, c.br AS block_request_id, c.blocker_count,
            coalesce(c.same_session_only, FALSE) AS same_session_only,
            CASE WHEN c.n = 1 THEN wait_duration_ms / 1000.0 ELSE p.wait_time END AS wait_time,
            CASE WHEN c.n = 1 THEN c.wait_type ELSE p.wait_type END AS wait_type,
            c.block_session_id """ + _LABEL.format(c="c.bc", r="c.br") + """
                || CASE WHEN c.blocker_count > 1 THEN ' (+' || (c.blocker_count - 1) || ')' ELSE '' END
                AS block_label
        FROM k_all p LEFT JOIN k_picked c
            ON c.wait_session_id = p.session_id AND c.wait_task = p.task_address AND c.n = 1)
"""
_K_STATEMENTS = f""", k_statements AS MATERIALIZED (
    SELECT p.*, t.dbid AS statement_database_id, t.objectid AS statement_object_id,
        CASE WHEN t.encrypted THEN '-- ENCRYPTED, pos ' || (stmt_start + 2) // 2 || ' - '
                 || (stmt_end + 2) // 2
             WHEN stmt_start >= 0 THEN {stmt('t.text', 'stmt_start', 'stmt_end')} END AS current_stmt
    FROM k_attached p LEFT JOIN query_text t ON t.sql_handle = p.sql_handle)
"""
_K_KEPT = f""", k_kept AS MATERIALIZED (
    SELECT * FROM k_locks l
    {_LOCKED})
"""


def _name(obj, schema, entity, db_id, db):
    return (
        f"CASE WHEN {db_id} = 2 AND regexp_matches({obj}, '^#[0-9A-F]{{8}}$') "
        "THEN '#(tblvar or dropped temp table)' "
        f"WHEN {db_id} = 2 AND length({obj}) = 128 AND regexp_matches({obj}, '^#[^#]') "
        f"THEN split_part({obj}, '_____', 1) "
        f"ELSE {db} || '.' || coalesce({schema} || '.' || {obj}, '<' || {entity} || '>') END"
    )


def _ids(with_processes: bool) -> str:
    more = """
        UNION ALL SELECT 'OBJ', statement_database_id, statement_object_id, NULL FROM k_statements
        WHERE statement_database_id IS NOT NULL AND statement_object_id IS NOT NULL""" if with_processes else ""
    return f""", k_ids AS (
    SELECT idtype, i.database_id, entity_id, min(session_id) AS session_id, any_value(d.name) AS db
    FROM (SELECT CASE WHEN rsc_type = 'OBJECT' THEN 'OBJ'
                      WHEN rsc_type IN ('PAGE', 'KEY', 'RID', 'HOBT') THEN 'HOBT'
                      WHEN rsc_type = 'ALLOCATION_UNIT' THEN 'AU' END AS idtype,
              database_id, entity_id, CASE WHEN database_id = 2 THEN session_id END AS session_id
          FROM {'k_kept' if with_processes else 'k_locks'}{more}) AS i
    LEFT JOIN databases d ON d.database_id = i.database_id
    WHERE idtype IS NOT NULL GROUP BY idtype, i.database_id, entity_id)"""


_SUFFIX = ("CASE WHEN c.index_id <= 1 THEN '' ELSE '.' || c.index_name END "
           "|| CASE WHEN c.partition_number > 1 THEN '(' || c.partition_number || ')' ELSE '' END")
_OBJECT_NAMES = f""", k_catalog AS MATERIALIZED (
    SELECT p.database_id, p.hobt_id, p.partition_id, p.index_id, p.partition_number,
        o.name AS object_name, s.name AS schema_name, i.name AS index_name
    FROM partitions p
    JOIN objects o ON o.database_id = p.database_id AND o.object_id = p.object_id
    JOIN indexes i ON i.database_id = p.database_id AND i.object_id = p.object_id
        AND i.index_id = p.index_id
    JOIN schemas s ON s.database_id = o.database_id AND s.schema_id = o.schema_id),
    k_units AS (
        SELECT i.*, a.type, a.type_desc, a.container_id FROM k_ids i
        LEFT JOIN allocation_units a
            ON a.database_id = i.database_id AND a.allocation_unit_id = i.entity_id
        WHERE idtype = 'AU'),
    k_containers AS (
        SELECT idtype, database_id, entity_id, session_id, db, entity_id AS hobt, CAST(NULL AS VARCHAR) AS type_desc
        FROM k_ids WHERE idtype = 'HOBT'
        UNION ALL
        SELECT 'HOBT', database_id, entity_id, session_id, db, container_id, type_desc
        FROM k_units WHERE type IN (1, 3)),
    k_objects AS MATERIALIZED (
        SELECT i.idtype, i.database_id, i.entity_id, i.session_id,
            {_name('o.name', 's.name', 'i.entity_id', 'i.database_id', 'i.db')} AS object_name
        FROM k_ids i
        LEFT JOIN objects o ON o.database_id = i.database_id AND o.object_id = i.entity_id
        LEFT JOIN schemas s ON s.database_id = o.database_id AND s.schema_id = o.schema_id
        WHERE idtype = 'OBJ'
        UNION ALL
        SELECT i.idtype, i.database_id, i.entity_id, i.session_id,
            {_name('c.object_name', 'c.schema_name', 'i.entity_id', 'i.database_id', 'i.db')}
                || {_SUFFIX} || coalesce(' (' || i.type_desc || ')', '')
        FROM k_containers i LEFT JOIN k_catalog c
            ON c.database_id = i.database_id AND c.hobt_id = i.hobt
        WHERE c.hobt_id IS NOT NULL
        UNION ALL
        SELECT i.idtype, i.database_id, i.entity_id, i.session_id, NULL
        FROM k_containers i WHERE NOT EXISTS (SELECT 1 FROM k_catalog c
            WHERE c.database_id = i.database_id AND c.hobt_id = i.hobt)
        UNION ALL
        SELECT i.idtype, i.database_id, i.entity_id, i.session_id,
            CASE WHEN i.type = 0 THEN i.db || ' (dropped table et al)'
                 WHEN i.type = 2 AND c.partition_id IS NOT NULL THEN
                 {_name('c.object_name', 'c.schema_name', 'i.entity_id', 'i.database_id', 'i.db')}
                 || {_SUFFIX} END
        FROM k_units i LEFT JOIN k_catalog c
            ON c.database_id = i.database_id AND c.partition_id = i.container_id AND i.type = 2
        WHERE i.type IS NULL OR i.type NOT IN (1, 3))
"""
_K_OBJECTS = _ids(True) + _OBJECT_NAMES


def _consolidated(locks: str) -> str:
    return f""", k_multi AS MATERIALIZED (
    SELECT *, min(entity_id) OVER w AS min_id, count(*) OVER w AS n FROM k_objects
    WHERE database_id = 2 AND object_name LIKE '#%' AND object_name NOT LIKE '##%'
        AND session_id IS NOT NULL
    WINDOW w AS (PARTITION BY object_name, session_id, idtype)),
    k_labelled AS MATERIALIZED (
        SELECT o.idtype, o.database_id, o.entity_id, o.session_id,
            CASE WHEN m.n > 1 THEN o.object_name || ' (x' || m.n || ')' ELSE o.object_name END
                AS object_name
        FROM k_objects o LEFT JOIN k_multi m ON m.idtype = o.idtype
            AND m.database_id = o.database_id AND m.entity_id = o.entity_id),
    k_marked AS (
        SELECT l.*, m.min_id FROM {locks} l
        LEFT JOIN (SELECT database_id, entity_id, session_id, min(min_id) AS min_id FROM k_multi
                   WHERE n > 1 GROUP BY ALL) m
            ON m.database_id = l.database_id AND m.entity_id = l.entity_id
            AND m.session_id = l.session_id),
    k_merged AS MATERIALIZED (
        SELECT * EXCLUDE (min_id) FROM k_marked WHERE min_id IS NULL
        UNION ALL BY NAME
        SELECT session_id, req_mode, rsc_type, rsc_subtype, req_status, req_owner_type,
            NULL AS rsc_description, database_id, min_id AS entity_id, sum(cnt)::BIGINT AS cnt,
            bool_or(activelock) AS activelock
        FROM k_marked WHERE min_id IS NOT NULL
        GROUP BY session_id, req_mode, rsc_type, rsc_subtype, req_status, req_owner_type,
            database_id, min_id)
"""


_K_MERGED = _consolidated("k_kept")
_NUMBER = """row_number() OVER (PARTITION BY session_id ORDER BY
            CASE WHEN req_status = 'GRANT' THEN 'ZZZZ' ELSE req_status END,
            object_name NULLS FIRST, rsc_type, rsc_description NULLS FIRST, database_id, entity_id,
            req_mode, rsc_subtype, req_status, req_owner_type)"""
_K_NUMBERED = f""", k_named AS (
    SELECT l.*, o.object_name FROM k_merged l LEFT JOIN (
        SELECT database_id, entity_id, min(object_name) AS object_name FROM k_labelled
        GROUP BY database_id, entity_id) o
        ON o.database_id = l.database_id AND o.entity_id = l.entity_id),
    k_numbered AS MATERIALIZED (
        SELECT *, {_NUMBER} AS rowno
        FROM k_named)
"""
_KEPT_COLUMNS = (
    "session_id, is_user_process, orig_login, current_login, session_state, endpoint_id, "
    "proc_dbid, host_name, host_process_id, program_name, session_cpu, session_physio, "
    "session_logreads, quoted_identifier, arithabort, ansi_null_dflt_on, ansi_defaults, ansi_warnings, "
    "ansi_padding, ansi_nulls, concat_null_yields_null, login_time, last_batch, last_since"
)
_K_SUPPLEMENTED = f""", k_supplemented AS MATERIALIZED (
    SELECT * FROM k_statements
    UNION ALL BY NAME
    SELECT {_KEPT_COLUMNS}, '' AS task_address, 0 AS exec_context_id, 0 AS request_id,
        0 AS trancount, 2 AS transaction_isolation_level, FALSE AS executing_managed_code, FALSE AS same_session_only
    FROM k_statements s
    WHERE session_id NOT IN (SELECT session_id FROM k_statements
                             WHERE exec_context_id = 0 AND request_id = 0)
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY exec_context_id < 0,
        exec_context_id, request_id, task_address) = 1)
"""
_K_FLAGGED = """, k_flagged AS MATERIALIZED (
    SELECT p.*, p.session_id IN (
        SELECT session_id FROM k_locks WHERE req_status = 'WAIT'
            AND session_id NOT IN (SELECT wait_session_id FROM k_waits)) AS waiter_no_blocker
    FROM k_supplemented p)
"""


def _clock(ts):
    return (f"CASE WHEN date_diff('day', {ts}, {_NOW}) = 0 THEN strftime({ts}, '%H:%M:%S') "
            f"ELSE strftime({ts}, '%y%m%d %H:%M:%S') END")


def _sec(x):
    return f"lpad(CAST(CAST({x} AS DECIMAL(18, 3)) AS VARCHAR), 11, ' ')"


def _count(session, request):
    return (f"coalesce({session}::VARCHAR, '') || CASE WHEN {request} IS NOT NULL "
            f"THEN ' (' || {request} || ')' ELSE '' END")


_Z1 = "coalesce(exec_context_id, 0) = 0 AND coalesce(rowno, 1) = 1"
_M1 = "exec_context_id = 0 AND coalesce(rowno, 1) = 1"
_F1 = "coalesce(rowno, 1) = 1"
_OFF = {"quoted_identifier": "qid ", "ansi_null_dflt_on": "ando ", "ansi_warnings": "awarn ", "ansi_padding": "apad ",
        "ansi_nulls": "anull ", "concat_null_yields_null": "cnyn "}
_SHOWN_OPTIONS = " || ".join(
    f"CASE WHEN {'' if n in ('arithabort', 'ansi_defaults') else 'NOT '}{n} THEN '{t}' ELSE '' END"
    for n, t in [("quoted_identifier", "qid "), ("arithabort", "ARITH "), ("ansi_defaults", "ADEF "),
                 *[(n, t) for n, t in _OFF.items() if n != "quoted_identifier"]]
)


def _if(cond, value):
    return f"CASE WHEN {cond} THEN {value} ELSE '' END"


_REPORT_COLUMNS = {
    "spid": f"coalesce(p.session_id {_LABEL.format(c='exec_context_id', r='p.request_id')}, "
            "l_session_id::VARCHAR)",
    "command": _if(_Z1, "request_command"),
    "login": _if(_Z1, "CASE WHEN NOT is_user_process THEN 'SYSTEM PROCESS' ELSE orig_login || "
                      "CASE WHEN current_login <> orig_login OR orig_login IS NULL "
                      "THEN ' (' || current_login || ')' ELSE '' END END"),
    "host": _if(_Z1, "host_name"),
    "hostprc": _if(_Z1, "host_process_id::VARCHAR"),
    "endpoint": _if(_Z1, "e.name"),
    "appl": _if(_Z1, "program_name"),
    "dbname": _if(_Z1, "coalesce(d1.name, d2.name)"),
    "prcstatus": _if(_F1, "coalesce(task_state, session_state)"),
    "ansiopts": _if(_F1, _SHOWN_OPTIONS),
    "trnopts": _if(_F1, "CASE transaction_isolation_level WHEN 0 THEN 'Unspecified  ' WHEN 1 THEN "
                        "'Read uncommitted  ' WHEN 2 THEN '' WHEN 3 THEN 'Repeatable read  ' WHEN 4 "
                        "THEN 'Serializable  ' WHEN 5 THEN 'Snapshot  ' ELSE 'Isolation level=' || "
                        "transaction_isolation_level END || CASE WHEN lock_timeout >= 0 THEN 'LT=' || lock_timeout "
                        "|| '  ' ELSE '' END || CASE WHEN deadlock_priority <> 0 THEN 'DP=' || "
                        "deadlock_priority ELSE '' END"),
    "opntrn": _if("exec_context_id = 0", "coalesce(nullif(trancount, 0)::VARCHAR, '')"),
    "trninfo": _if(f"{_M1} AND is_user_trans IS NOT NULL",
                   "CASE WHEN is_user_trans THEN 'U' ELSE 'S' END || '-' || CASE trans_type WHEN 1 "
                   "THEN 'RW' WHEN 2 THEN 'R' WHEN 3 THEN 'SYS' WHEN 4 THEN 'DIST' ELSE "
                   "trans_type::VARCHAR END || '-' || trans_state || CASE dtc_state WHEN 0 THEN '' "
                   "WHEN 1 THEN '-DTC:ACTIVE' WHEN 2 THEN '-DTC:PREPARED' WHEN 3 THEN "
                   "'-DTC:COMMITED' WHEN 4 THEN '-DTC:ABORTED' WHEN 5 THEN '-DTC:RECOVERED' ELSE "
                   "'-DTC:' || dtc_state END || CASE WHEN is_bound THEN '-BND' ELSE '' END"),
    "blklvl": "CASE WHEN block_level IS NOT NULL THEN CASE WHEN same_session_only THEN '(' ELSE '' "
              "END || CASE WHEN block_level = 0 THEN '!!' ELSE block_level::VARCHAR END || CASE WHEN "
              "same_session_only THEN ')' ELSE '' END WHEN block_session_id IS NOT NULL THEN 'DD' "
              "WHEN waiter_no_blocker THEN '??' ELSE '' END",
    "blkby": "coalesce(block_label, '')",
    "cnt": _if("exec_context_id = 0 AND p.request_id = 0", "coalesce(cnt::VARCHAR, '0')"),
    "object": "CASE WHEN rsc_type = 'APPLICATION' THEN coalesce(d3.name || '|', '') || "
              "rsc_description ELSE coalesce(l.object_name, d3.name, '') END",
    "rsctype": "coalesce(rsc_type, '')",
    "locktype": "coalesce(req_mode, '')",
    "lstatus": "CASE WHEN req_status = 'GRANT' THEN 'grant' ELSE coalesce(req_status, '') END",
    "ownertype": "CASE WHEN req_owner_type = 'SHARED_TRANSACTION_WORKSPACE' THEN 'STW' ELSE "
                 "coalesce(req_owner_type, '') END",
    "rscsubtype": "coalesce(rsc_subtype, '')",
    "waittime": _if(_F1, "coalesce(CAST(CAST(wait_time AS DECIMAL(18, 3)) AS VARCHAR), '')"),
    "waittype": _if(_F1, "coalesce(wait_type, '')"),
    "cpu": _if(_M1, _count("session_cpu", "request_cpu")),
    "physio": _if(_M1, _count("session_physio", "request_physio")),
    "logreads": _if(_M1, _count("session_logreads", "request_logreads")),
    "progress": _if(_F1, "coalesce(CAST(round(percent_complete) AS INT) || ' %', '')"),
    "tempdb": _if(_M1, _count("session_tempdb", "request_tempdb")),
    "now": _if(_M1, "'12:00:00:000'"),
    "login_time": _if(_M1, _clock("login_time")),
    "last_batch": _if(_M1, _clock("last_batch")),
    "trn_start": _if(f"{_M1} AND trans_start IS NOT NULL", _clock("trans_start")),
    "last_since": _if(_M1, _sec("last_since")),
    "trn_since": _if(f"{_M1} AND trans_since IS NOT NULL", _sec("trans_since")),
    "clr": _if("exec_context_id = 0 AND executing_managed_code", "'CLR'"),
    "nstlvl": _if(_M1, "coalesce(nest_level::VARCHAR, '')"),
    "inputbuffer": _if(_M1, "coalesce(c.inputbuffer, '')"),
    "current_sp": "coalesce(o.object_name, '')",
    "curstmt": f"CASE WHEN {_F1} THEN coalesce(current_stmt, '') "
               "ELSE coalesce(substr(current_stmt, 1, 50), '') END",
    "current_plan": f"CASE WHEN {_M1} THEN x.query_plan END",
}
_REPORT = f"""
    SELECT {', '.join(f'{c} AS "{n}"' for n, c in _REPORT_COLUMNS.items())}
    FROM (SELECT *, CASE WHEN exec_context_id = 0 AND request_id = 0 THEN session_id END AS main
          FROM k_flagged) p
    FULL JOIN (SELECT * EXCLUDE (session_id), session_id AS l_session_id FROM k_numbered) l
        ON l.l_session_id = p.main
    LEFT JOIN k_labelled o ON o.idtype = 'OBJ' AND o.database_id = p.statement_database_id
        AND o.entity_id = p.statement_object_id
    LEFT JOIN last_command c ON c.session_id = p.session_id
    LEFT JOIN endpoints e ON e.endpoint_id = p.endpoint_id
    LEFT JOIN k_trans t ON t.session_id = p.session_id
    LEFT JOIN databases d1 ON d1.database_id = p.request_dbid
    LEFT JOIN databases d2 ON d2.database_id = p.proc_dbid
    LEFT JOIN databases d3 ON d3.database_id = l.database_id
    LEFT JOIN query_plan x ON x.plan_handle = p.plan_handle"""
_TO_STATEMENTS = (_K_LOCKS + _K_WAITS + _K_PROCS + _K_SESSIONLESS + _K_CHAINS + _K_ATTACHED
                  + _K_STATEMENTS)


# --- the steps ------------------------------------------------------------------------


@query(_K_LOCKS + "SELECT * REPLACE (activelock::BIGINT AS activelock) FROM k_locks", _VIEWS[:1])
def aggregate_locks(spark, sf_dir):
    return _bare(ls.aggregate_locks(_snap(spark, sf_dir)["tran_locks"], _KEYS))


def _waits(spark, sf_dir):
    return ls.clean_waits(_snap(spark, sf_dir)["waiting_tasks"], _KEYS)


@query(_K_WAITS + "SELECT * FROM k_waits", ["waiting_tasks"])
def clean_waits(spark, sf_dir):
    return _bare(_waits(spark, sf_dir))


@query(_K_TRANS + "SELECT * REPLACE (is_user_trans::BIGINT AS is_user_trans, "
       "is_bound::BIGINT AS is_bound) FROM k_trans", ["session_transactions", "active_transactions"])
def oldest_transaction(spark, sf_dir):
    snap = _snap(spark, sf_dir)
    out = ls.oldest_transaction(snap["session_transactions"], snap["active_transactions"], _KEYS)
    return _bare(out.withColumn("trans_start", F.col("trans_start").cast("timestamp_ntz")))


def _processes(spark, sf_dir, **options):
    snap = _snap(spark, sf_dir)
    locks = ls.aggregate_locks(snap["tran_locks"], _KEYS)
    return ls.assemble_processes(snap, locks, _waits(spark, sf_dir), own_session=_OWN, **options)


def _flags(names):
    return "REPLACE (" + ", ".join(f"{n}::BIGINT AS {n}" for n in names) + ")"


_BOOLS = ["is_user_process", "executing_managed_code", *[n for n in _OPTIONS if n != "transaction_isolation_level"]]


@query(_K_LOCKS + _K_WAITS + _K_PROCS + f"SELECT * {_flags(_BOOLS)} FROM k_procs", _VIEWS)
def assemble_processes(spark, sf_dir):
    return _bare(_processes(spark, sf_dir)).drop("now")


@query(_K_WAITS + _K_SESSIONLESS + "SELECT * REPLACE (executing_managed_code::BIGINT AS executing_managed_code) FROM k_sessionless",
       ["waiting_tasks", "tasks"])
def sessionless_tasks(spark, sf_dir):
    tasks = _snap(spark, sf_dir)["tasks"]
    return _bare(ls.sessionless_tasks(_waits(spark, sf_dir), tasks, _KEYS)).drop("now")


@query(_K_WAITS + _K_CHAINS + """
    SELECT wait_session_id, wait_task, block_session_id, block_task, wait_type, wait_duration_ms,
        level, lead, same_session_only::BIGINT AS same_session_only, block_level FROM k_chains""",
    ["waiting_tasks"])
def blocking_chains(spark, sf_dir):
    return _bare(ls.blocking_chains(_waits(spark, sf_dir), _KEYS))


@query(_K_LOCKS + _K_WAITS + _K_PROCS + _K_SESSIONLESS + _K_CHAINS + _K_ATTACHED + """
    SELECT session_id, task_address, exec_context_id, request_id, block_level, block_label,
        wait_time, wait_type FROM k_attached""", _VIEWS)
def attach_blockers(spark, sf_dir):
    snap, waits = _snap(spark, sf_dir), _waits(spark, sf_dir)
    rows = _processes(spark, sf_dir).unionByName(
        ls.sessionless_tasks(waits, snap["tasks"], _KEYS), allowMissingColumns=True
    )
    out = ls.attach_blockers(rows, ls.blocking_chains(waits, _KEYS), _KEYS)
    return out.select("session_id", "task_address", "exec_context_id", "request_id", "block_level",
                      "block_label", "wait_time", "wait_type")


@query(_K_LOCKS + _K_WAITS + _K_PROCS + f"""
    SELECT * REPLACE (activelock::BIGINT AS activelock) FROM k_locks
    WHERE (activelock AND session_id <> {_OWN})
        OR session_id IN (SELECT session_id FROM k_procs)""", _VIEWS)
def drop_idle_locks(spark, sf_dir):
    locks = ls.aggregate_locks(_snap(spark, sf_dir)["tran_locks"], _KEYS)
    return _bare(ls.drop_idle_locks(locks, _processes(spark, sf_dir), _KEYS, own_session=_OWN))


@query(f"""
    SELECT r.session_id, r.request_id, t.dbid AS statement_database_id, t.objectid AS statement_object_id,
        CASE WHEN t.encrypted THEN '-- ENCRYPTED, pos ' || (statement_start_offset + 2) // 2
                 || ' - ' || (statement_end_offset + 2) // 2
             ELSE {stmt('t.text')} END AS current_stmt
    FROM requests r LEFT JOIN query_text t ON t.sql_handle = r.sql_handle""",
    ["requests", "query_text AS s0_query_text"])
def current_statement(spark, sf_dir):
    snap = _snap(spark, sf_dir)
    rows = snap["requests"].select(
        *_KEYS, "session_id", "request_id", "sql_handle",
        F.col("statement_start_offset").alias("stmt_start"),
        F.col("statement_end_offset").alias("stmt_end"),
    )
    return _bare(ls.current_statement(rows, snap["query_text"], _KEYS)).drop(
        "sql_handle", "stmt_start", "stmt_end"
    )


@query(_K_LOCKS + _ids(False) + _OBJECT_NAMES + "SELECT * FROM k_objects", _VIEWS)
def resolve_objects(spark, sf_dir):
    snap = _snap(spark, sf_dir)
    return _bare(ls.resolve_objects(snap, ls.aggregate_locks(snap["tran_locks"], _KEYS)))


@query("""
    SELECT server_id, object_id,
        CASE WHEN regexp_matches(name, '^#[0-9A-F]{8}$') THEN '#(tblvar or dropped temp table)'
             WHEN length(name) = 128 AND name LIKE '#%' THEN split_part(name, '_____', 1) END AS shown
    FROM objects WHERE database_id = 2""", ["objects"])
def temp_table_names(spark, sf_dir):
    objects = spark_view(spark, sf_dir, "objects").filter(F.col("database_id") == 2)
    return objects.select("server_id", "object_id", fn.temp_table_name("name").alias("shown"))


@query(_K_LOCKS + _ids(False) + _OBJECT_NAMES + _consolidated("k_locks") + """
    SELECT l.session_id, l.req_mode, l.rsc_type, l.req_status, l.req_owner_type, l.rsc_description,
        l.database_id, l.entity_id, l.cnt, o.object_name
    FROM k_merged l LEFT JOIN (SELECT database_id, entity_id, min(object_name) AS object_name
        FROM k_labelled GROUP BY database_id, entity_id) o
        ON o.database_id = l.database_id AND o.entity_id = l.entity_id""", _VIEWS)
def consolidate_temp_tables(spark, sf_dir):
    snap = _snap(spark, sf_dir)
    locks = ls.aggregate_locks(snap["tran_locks"], _KEYS)
    objects, merged = ls.consolidate_temp_tables(ls.resolve_objects(snap, locks), locks, _KEYS)
    return _bare(ls.name_locks(merged, objects, _KEYS)).drop("rsc_subtype", "activelock")


@query("""
    SELECT r.session_id, r.request_id, p.query_plan AS current_plan
    FROM requests r LEFT JOIN query_plan p ON p.plan_handle = r.plan_handle""",
    ["requests", "query_plan AS s0_query_plan"])
def attach_plans(spark, sf_dir):
    snap = _snap(spark, sf_dir)
    rows = snap["requests"].select(*_KEYS, "session_id", "request_id", "plan_handle")
    return _bare(ls.attach_plans(rows, snap["query_plan"], _KEYS)).drop("plan_handle")


@query(_K_LOCKS + """
    SELECT session_id, req_mode, rsc_type, req_status, req_owner_type, rsc_description, database_id,
        entity_id, cnt, row_number() OVER (PARTITION BY session_id ORDER BY
            CASE WHEN req_status = 'GRANT' THEN 'ZZZZ' ELSE req_status END, rsc_type,
            rsc_description NULLS FIRST, database_id, entity_id, req_mode, req_owner_type) AS rowno
    FROM k_locks""", _VIEWS[:1])
def number_locks(spark, sf_dir):
    locks = ls.aggregate_locks(_snap(spark, sf_dir)["tran_locks"], _KEYS)
    unnamed = locks.withColumn("object_name", F.lit(None).cast("string"))
    return _bare(ls.number_locks(unnamed, _KEYS)).drop("rsc_subtype", "activelock", "object_name")


@query(_TO_STATEMENTS + _K_SUPPLEMENTED + """
    SELECT session_id, task_address, exec_context_id, request_id, host_name, trancount,
        session_cpu, request_cpu, transaction_isolation_level FROM k_supplemented""", _VIEWS)
def supplement_processes(spark, sf_dir):
    waits, tasks = _waits(spark, sf_dir), _snap(spark, sf_dir)["tasks"]
    rows = _processes(spark, sf_dir).unionByName(
        ls.sessionless_tasks(waits, tasks, _KEYS), allowMissingColumns=True
    )
    return ls.supplement_processes(rows, _KEYS).select(
        "session_id", "task_address", "exec_context_id", "request_id", "host_name", "trancount",
        "session_cpu", "request_cpu", "transaction_isolation_level",
    )


@query(_K_LOCKS + _K_WAITS + """
    SELECT session_id, CAST(session_id IN (
        SELECT session_id FROM k_locks WHERE req_status = 'WAIT'
            AND session_id NOT IN (SELECT wait_session_id FROM k_waits)) AS BIGINT)
        AS waiter_no_blocker
    FROM sessions""",
    ["tran_locks", "waiting_tasks", "sessions"])
def mark_waiter_without_blocker(spark, sf_dir):
    snap = _snap(spark, sf_dir)
    locks = ls.aggregate_locks(snap["tran_locks"], _KEYS)
    rows = snap["sessions"].select(*_KEYS, "session_id")
    return _bare(ls.mark_waiter_without_blocker(rows, locks, _waits(spark, sf_dir), _KEYS))


# --- the reports -----------------------------------------------------------------------


@query("""
    SELECT d.name AS database_name, l.* EXCLUDE (server_id, snapshot_ts) FROM tran_locks l
    LEFT JOIN databases d ON d.database_id = l.resource_database_id""",
    ["tran_locks", "databases AS s0_databases"])
def examine_locks(spark, sf_dir):
    return _bare(lk.examine_locks(_snap(spark, sf_dir)))


@query("""
    SELECT d.name AS database, l.request_status AS status, bs.host_name AS blocking_host,
        bs.nt_domain || '\\' || bs.nt_user_name AS blocking_user, w.wait_duration_ms / 1000.0 AS wait_s,
        bt.text AS blocking_sql_text, bp.query_plan AS blocking_query_plan,
        ct.text AS executing_sql_text, cp.query_plan AS executing_query_plan, l.resource_type,
        l.resource_subtype AS resource_sub_type, l.resource_description, l.request_mode,
        l.request_type, w.wait_type
    FROM tran_locks l
    JOIN waiting_tasks w ON w.resource_address = l.lock_owner_address
    JOIN sessions bs ON bs.session_id = w.blocking_session_id
    JOIN requests br ON br.session_id = w.blocking_session_id
    JOIN sessions cs ON cs.session_id = w.session_id
    JOIN requests cr ON cr.session_id = w.session_id
    JOIN query_text bt ON bt.sql_handle = br.sql_handle
    JOIN query_plan bp ON bp.plan_handle = br.plan_handle
    JOIN query_text ct ON ct.sql_handle = cr.sql_handle
    JOIN query_plan cp ON cp.plan_handle = cr.plan_handle
    LEFT JOIN databases d ON d.database_id = l.resource_database_id""", _VIEWS)
def current_locks(spark, sf_dir):
    return _bare(lk.current_locks(_snap(spark, sf_dir)))


@query("""
    SELECT r.session_id, d.name AS database_name, s.host_name AS host,
        s.nt_domain || '\\' || s.nt_user_name AS user, r.command, r.status, s.deadlock_priority,
        r.cpu_time, r.total_elapsed_time AS elapsed_time, t.text AS sql_text, p.query_plan
    FROM requests r JOIN sessions s ON s.session_id = r.session_id
    JOIN query_text t ON t.sql_handle = r.sql_handle
    JOIN query_plan p ON p.plan_handle = r.plan_handle
    LEFT JOIN databases d ON d.database_id = r.database_id
    WHERE r.session_id <> 42""", _VIEWS)
def running_queries(spark, sf_dir):
    return _bare(qs.running_queries(_snap(spark, sf_dir), exclude_session=42))


_OVERVIEW = (_K_TRANS + _TO_STATEMENTS + _K_KEPT + _K_OBJECTS + _K_MERGED + _K_NUMBERED
             + _K_SUPPLEMENTED + _K_FLAGGED + _REPORT)


@query(_OVERVIEW, _VIEWS)
def lock_overview(spark, sf_dir):
    return _bare(lk.lock_overview(_snap(spark, sf_dir), own_session=_OWN))


@query(_OVERVIEW.replace(_LISTED, "").replace(_LOCKED, ""), _VIEWS)
def lock_overview_all(spark, sf_dir):
    """Idle sessions and their locks too."""
    return _bare(lk.lock_overview(_snap(spark, sf_dir), own_session=_OWN, all_processes=True))


@query(_OVERVIEW.replace(_NUMBER, "NULL::BIGINT"), _VIEWS)
def lock_overview_every_row(spark, sf_dir):
    """The columns about a process in every row of it."""
    return _bare(lk.lock_overview(_snap(spark, sf_dir), own_session=_OWN, first_row_only=False))


@query(_OVERVIEW.removesuffix(_REPORT) + f""", k_report AS MATERIALIZED ({_REPORT})
    SELECT * FROM k_report UNION ALL SELECT * FROM k_report""", _VIEWS, "lock_overview_stream")
def _lock_overview_stream(spark, sf_dir):
    """The same report for each of two servers, run as their collections are published."""
    out, snap = scratch_dir(spark, "lock-stream"), _snap(spark, sf_dir)
    base = f"{out}/store"

    def write(report, batch_id):
        report.write.mode("overwrite").parquet(f"{out}/report/batch={batch_id}")

    for server in ("srv0", "srv9"):
        publish(spark, {t: snap[t].withColumn("server_id", F.lit(server)) for t in snap}, base, f"of-{server}")
        stored = open_snapshot(spark, base)
        stream = lock_overview_stream(arrivals(spark, base), lambda keys: restrict(stored, keys), write, own_session=_OWN)
        stream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return _bare(spark.read.parquet(f"{out}/report")).drop("batch")
