"""Reports on a handful of rows each, with the expected rows worked out by hand."""

import datetime as dt
from decimal import Decimal as D

import pytest
from conftest import DATABASES, TS, rows

from fleetstats.plans import (
    backups, indexes, inventory, memory_io, plancache, queries, resource, storage, waits,
)


def test_wait_pareto(snap):
    s = snap(wait_stats=[
        {"wait_type": "SLEEP_TASK", "wait_time_ms": 9_000_000},  # excluded, not in the total
        {"wait_type": "LCK_M_X", "wait_time_ms": 60_005}, {"wait_type": "IO", "wait_time_ms": 30_000},
        {"wait_type": "NET_B", "wait_time_ms": 5_000}, {"wait_type": "NET_A", "wait_time_ms": 5_000},
        {"wait_type": "NIL", "wait_time_ms": 0},
        {"wait_type": "IO", "wait_time_ms": 10, "server_id": "b"},
    ])
    got = rows(waits.wait_pareto_short(s), "server_id", "wait_type", "wait_time_s", "pct", "running_pct")
    assert got == [
        ("a", "LCK_M_X", D("60.01"), D("60.00"), D("60.00")),
        ("a", "IO", D("30.00"), D("30.00"), D("90.00")),
        ("a", "NET_A", D("5.00"), D("5.00"), D("95.00")),
        ("b", "IO", D("0.01"), D("100.00"), D("100.00")),
    ]
    assert len(rows(waits.wait_pareto(s), "wait_type")) == 5  # 99 % takes NET_B in too
    fleet = rows(waits.wait_pareto(s, scope=()), "wait_type", "wait_time_s")
    assert fleet[1] == ("IO", D("30.01"))


def test_top_waits(snap):
    s = snap(wait_stats=[
        {"wait_type": f"W{i:02}", "wait_time_ms": 1999 * i} for i in range(12)
    ] + [{"wait_type": "BIG_SLEEP", "wait_time_ms": 10 ** 9}])
    got = rows(waits.top_waits(s), "wait_type", "wait_time_s", "pct_waiting")
    assert len(got) == 10 and got[0] == ("W11", 21, D("16.67")) and got[-1][0] == "W02"


def stat(handle, **more):
    base = {"sql_handle": handle, "plan_handle": "p" + handle, "query_hash": "h", "query_plan_hash": "ph",
            "statement_start_offset": 0, "statement_end_offset": -1, "execution_count": 2,
            "creation_time": TS, "last_execution_time": TS, "total_clr_time": 0}
    for what in ("worker_time", "elapsed_time", "physical_reads", "logical_reads", "logical_writes"):
        for part in ("total", "min", "max", "last"):
            base[f"{part}_{what}"] = 10
    return {**base, **more}


TEXTS = [
    {"sql_handle": "1", "plan_handle": "p1", "dbid": 5, "objectid": 100, "text": "SELECT 1; SELECT 2",
     "encrypted": False},
    {"sql_handle": "2", "plan_handle": "p2", "dbid": 4, "objectid": 100, "text": "BACKUP", "encrypted": True},
    {"sql_handle": "3", "plan_handle": "p3", "dbid": None, "objectid": None,
     "text": "FETCH API_CURSOR0001", "encrypted": False},
    {"sql_handle": "4", "plan_handle": "p4", "dbid": 6, "objectid": 7, "text": "SELECT member",
     "encrypted": False},
]


def query_snap(snap, **more):
    return snap(**{
        "databases": DATABASES, "query_text": TEXTS,
        "objects": [{"database_id": 5, "object_id": 100, "name": "proc1", "type": "P"}],
        "query_stats": [
            stat("1", total_worker_time=5_999_999, execution_count=4, total_elapsed_time=9_000_000),
            stat("1", statement_start_offset=20, total_logical_reads=101, total_clr_time=9),
            stat("2", execution_count=50, total_elapsed_time=3, total_worker_time=10),
            stat("3", execution_count=60), stat("4", execution_count=7, total_logical_writes=70),
            stat("gone", total_logical_reads=10 ** 9),  # its text is gone: in no report
        ], **more})


def test_reads_and_writes_by_database(snap):
    s = query_snap(snap)
    got = rows(queries.reads_by_database(s), "total_reads", "execution_count", "database_name")
    assert got == [(111, 6, "sales"), (10, 60, None), (10, 50, "msdb"), (10, 7, "stock")]
    assert rows(queries.writes_by_database(s, n=1), "total_writes", "database_name") == [(70, "stock")]


def test_costly_queries(snap):
    s = query_snap(snap)
    io = rows(queries.costly_by_io(s, n=2), "average_io", "total_io", "individual_query", "database_name")
    assert io == [(55, 111, "SELECT 2", "sales"), (11, 80, "SELECT member", "stock")]
    cpu = rows(queries.costly_by_cpu(s, n=1), "average_cpu", "total_cpu", "parent_query")
    assert cpu == [(1_499_999, 5_999_999, "SELECT 1; SELECT 2")]
    assert rows(queries.costly_clr(s), "average_clr_time", "total_clr_time") == [(4, 9)]
    most = rows(queries.most_executed(s), "dbid", "execution_count")
    assert most == [(6, 7), (5, 4), (5, 2)]
    blocked = rows(queries.most_blocked(s), "average_time_blocked", "total_time_blocked")
    assert blocked[0] == (750_000, 3_000_001) and (0, -7) in blocked


def test_most_expensive_needs_a_plan(snap):
    s = query_snap(snap, query_plan=[{"plan_handle": "p1", "query_plan": "<x/>"},
                                     {"plan_handle": "pgone", "query_plan": "<x/>"}])
    got = rows(queries.most_expensive(s), "statement_text", "total_logical_reads", "query_plan")
    assert got == [("SELECT 2", 101, "<x/>"), ("SELECT 1; SELECT 2", 10, "<x/>")]
    by_cpu = rows(queries.most_expensive(s, by="worker_time", n=1), "total_elapsed_time_s")
    assert by_cpu == [(9,)]
    with pytest.raises(ValueError):
        queries.most_expensive(s, by="text")


def test_worst_procedures_and_profile(snap):
    s = query_snap(snap)
    got = rows(queries.worst_procedures(s, database_id=5), "object_name", "total_cpu_time",
               "avg_cpu_time", "statement_text")
    assert got == [("proc1", 5999, 1499, "SELECT 1; SELECT 2"), ("proc1", 0, 0, "SELECT 2")]
    profile = rows(queries.procedure_profile(s, 5), "object_name", "avg_elapsed_time", "sql_stmt")
    assert profile == [("proc1", 2_250_000, "SELECT 1; SELECT 2"), ("proc1", 5, "SELECT 2")]
    assert rows(queries.procedure_profile(s, 6), "object_name") == [(None,)]


PLAN = ("<ShowPlanXML xmlns='urn:p'><BatchSequence><Batch><Statements><StmtSimple><QueryPlan>"
        "<MissingIndexes>{}</MissingIndexes></QueryPlan></StmtSimple></Statements></Batch>"
        "</BatchSequence></ShowPlanXML>")
GROUP = "<MissingIndexGroup Impact='{}'><MissingIndex Database='{}' Table='{}'/></MissingIndexGroup>"


def test_missing_index_plans(snap):
    s = query_snap(snap, query_plan=[
        {"plan_handle": "p1", "query_plan": PLAN.format(GROUP.format("20.5", "[d]", "[t]") +
                                                        GROUP.format("99", "[e]", "[u]"))},
        {"plan_handle": "p2", "query_plan": PLAN.format(GROUP.format("50", "m", "[t]"))},
        {"plan_handle": "p3", "query_plan": "<MissingIndex"},
        {"plan_handle": "p4", "query_plan": "<ShowPlanXML/>"},
    ])
    got = rows(queries.missing_index_plans(s), "total_impact", "database", "table", "avg_reads")
    assert got == [(D("82.0000"), "[d]", "[t]", 5), (D("41.0000"), "[d]", "[t]", 55)]


def test_cached_text_and_pages(snap):
    s = query_snap(snap)
    assert len(rows(queries.cached_text(s), "text")) == 4
    assert len(rows(queries.page_query_stats(s, page_number=1, size=3), "row_number")) == 3
    last = rows(queries.page_query_stats(s, page_number=2, size=3, details=True), "row_number",
                "total_hits", "statement_text")
    assert sorted(last) == [(4, 5, "FETCH API_CURSOR0001"), (5, 5, "SELECT member")]


def cached(handle, **more):
    return {"plan_handle": handle, "objtype": "Adhoc", "cacheobjtype": "Compiled Plan", "refcounts": 2,
            "usecounts": 1, "size_in_bytes": 2048, **more}


def test_plan_cache_reports(snap):
    s = query_snap(
        snap,
        cached_plans=[
            cached("p1", usecounts=2, size_in_bytes=1024 * 1024), cached("p2", size_in_bytes=3071),
            cached("p3"), cached("p4", objtype="Proc", usecounts=9, refcounts=5), cached("p5"),
        ],
        query_plan=[{"plan_handle": h, "query_plan": "<x/>"} for h in ("p1", "p4")],
    )
    got = rows(plancache.cache_pollution(s), "cache_type", "total_plans", "avg_use_count",
               "total_plans_use_1", "percent_wasted")
    assert got[0][:4] == ("Adhoc", 4, 1, 3) and got[1] == ("Proc", 1, 9, 0, 0.0)
    once = rows(plancache.one_time_queries(s), "size_kb", "text")
    assert once == [(2, "BACKUP")]  # a cursor fetch, and a plan without text, are left out
    listed = rows(plancache.cached_queries(s), "refcounts", "text")
    assert listed == [(5, "SELECT member"), (2, "SELECT 1; SELECT 2")]
    reuse = rows(plancache.lowest_plan_reuse(s, n=3), "plan_usage", "individual_query")
    assert reuse == [(1, "BACKUP"), (1, "FETCH API_CURSOR0001"), (2, "SELECT 1; SELECT 2")]
    details = rows(plancache.cache_pollution_details(s, "SELECT%"), "objtype", "total_mb",
                   "execution_total", "example_statement_text")
    # Both statements of plan 1 count its megabyte.
    assert details == [("Adhoc", 2.0, 6, "SELECT 1; SELECT 2"), ("Proc", 2048 / 1048576, 7, "SELECT member")]


def index_snap(snap):
    def ix(i, name="ix", **more):
        return {"database_id": 5, "object_id": 1, "index_id": i, "name": name and f"{name}{i}",
                "type_desc": "NC", "fill_factor": 90, "is_padded": False, "data_space_id": 70, **more}

    def used(i, seeks, updates, **more):
        return {"database_id": 5, "object_id": 1, "index_id": i, "user_seeks": seeks, "user_scans": 0,
                "user_lookups": 0, "user_updates": updates, "system_updates": 1, **more}

    return snap(
        databases=DATABASES,
        schemas=[{"database_id": 5, "schema_id": 1, "name": "dbo"}],
        objects=[{"database_id": 5, "object_id": 1, "schema_id": 1, "name": "t1", "type": "U", "is_ms_shipped": False},
                 {"database_id": 5, "object_id": 2, "schema_id": 1, "name": "sys", "type": "S", "is_ms_shipped": True}],
        indexes=[ix(0, None), *[ix(i) for i in range(1, 13)], ix(1, object_id=2)],
        index_usage=[used(0, 9, 9), used(1, 5, 100), used(2, 0, 50), used(3, 7, 0, database_id=6),
                     used(1, 5, 5, object_id=2)],
        index_physical_stats=[
            {"database_id": 5, "object_id": 1, "index_id": i, "index_type_desc": "NC", "index_depth": 2,
             "index_level": 0, "page_count": i, "record_count": i, "avg_fragmentation_in_percent": i + 0.126}
            for i in range(13)],
        partition_stats=[
            {"database_id": 5, "object_id": 1, "index_id": 0, "partition_number": p, "used_page_count": 4,
             "row_count": 5_001} for p in (1, 2)
        ] + [{"database_id": 5, "object_id": 1, "index_id": 2, "partition_number": 1, "used_page_count": 1,
              "row_count": 10 ** 6},
             {"database_id": 5, "object_id": 3, "index_id": 1, "partition_number": 1, "used_page_count": 1,
              "row_count": 10_000}],
        missing_index_groups=[{"index_group_handle": g, "index_handle": g * 10} for g in (1, 2, 3, 4)],
        missing_index_group_stats=[
            {"group_handle": g, "avg_total_user_cost": 2.0, "avg_user_impact": i, "user_seeks": 3,
             "user_scans": 1, "unique_compiles": 1, "last_user_seek": TS}
            for g, i in ((1, 90.0), (2, 89.9), (3, 95.0))],
        missing_index_details=[
            {"index_handle": g * 10, "database_id": 5, "object_id": o, "statement": "[sales].[dbo].[t1]",
             "equality_columns": "[a]"} for g, o in ((1, 1), (2, 1), (3, 3), (4, 1))],
    )


def test_index_reports(snap):
    s = index_snap(snap)
    usage = rows(indexes.index_usage(s), "index_name", "seeks", "updates")
    assert usage[0] == ("(heap)", 9, 9) and len(usage) == 13 and ("ix3", 0, 0) in usage
    flags = rows(indexes.index_used_flag(s), "index_name", "schema_name", "index_is_used", "drop_index",
                 "recorded_at")
    assert flags == [("ix1", "dbo", 1, 0, TS), ("ix2", "dbo", 0, 0, TS)]
    costly = rows(indexes.costly_used_indexes(s), "maintenance_cost", "retrieval_usage", "index_name")
    assert costly == [(101, 5, "ix1"), (51, 0, "ix2")]
    assert rows(indexes.most_used_indexes(s), "usage", "index_name") == [(5, "ix1")]
    fragmented = rows(indexes.fragmented_indexes(s, database_id=5), "index_name", "fragmentation_pct")
    assert fragmented[0] == ("ix12", 12.13) and len(fragmented) == 10 and fragmented[-1][0] == "ix3"
    sizes = rows(indexes.index_sizes(s, "t1"), "index_id", "used_page_count", "row_count")
    assert sorted(sizes) == [(0, 4, 5001), (0, 4, 5001), (2, 1, 10 ** 6)]
    assert rows(indexes.index_depth(s, "t1", 4), "index", "index_depth", "page_count") == [("ix4", 2, 4)]


def test_missing_index_reports(snap):
    s = index_snap(snap)
    got = rows(indexes.missing_indexes(s), "avg_user_impact", "total_cost", "database_name", "table_name")
    assert got == [(95.0, 760.0, "[sales]", "[dbo].[t1]"), (90.0, 720.0, "[sales]", "[dbo].[t1]"),
                   (89.9, 719.0, "[sales]", "[dbo].[t1]")]
    assert len(rows(indexes.missing_indexes(s, n=1, order_by="total_cost"), "total_cost")) == 1
    sized = rows(indexes.missing_indexes_with_rows(s), "total_cost", "row_count", "table_name", "recorded_at")
    assert sized == [(720.0, 10_002, "t1", TS)]  # exactly 10,000 rows is too few
    counts = rows(indexes.missing_index_count_by_db(s), "database_name", "missing_index_count")
    assert counts == [("sales", 1)]
    assert rows(indexes.missing_index_count(s), "missing_index_count") == [(4,)]


def test_partitioned_tables(snap):
    db = {"database_id": 5}
    s = snap(
        objects=[{**db, "object_id": 1, "name": "t1"}],
        indexes=[{**db, "object_id": 1, "index_id": 1, "data_space_id": 70}],
        partitions=[{**db, "partition_id": 10 + n, "hobt_id": n, "object_id": 1, "index_id": 1,
                     "partition_number": n, "rows": n} for n in (1, 2)],
        allocation_units=[{**db, "container_id": 11, "total_pages": 3}, {**db, "container_id": 11, "total_pages": 4},
                          {**db, "container_id": 12, "total_pages": 5}],
        partition_schemes=[{**db, "data_space_id": 70, "name": "ps", "function_id": 7, "is_default": False}],
        partition_functions=[{**db, "function_id": 7, "name": "pf", "boundary_value_on_right": True, "fanout": 2}],
        partition_range_values=[{**db, "function_id": 7, "boundary_id": 1, "parameter_id": 1, "value": "2024"}],
        partition_parameters=[{**db, "function_id": 7, "system_type_id": 56, "max_length": 4}],
        destination_data_spaces=[{**db, "partition_scheme_id": 70, "destination_id": n, "data_space_id": 200 + n}
                                 for n in (1, 2)],
        data_spaces=[{**db, "data_space_id": 200 + n, "name": f"fg{n}"} for n in (1, 2)],
        types=[{**db, "system_type_id": 56, "user_type_id": 56, "name": "int"},
               {**db, "system_type_id": 56, "user_type_id": 300, "name": "alias"}],
    )
    got = rows(indexes.partitioned_tables(s), "table_name", "fg_name", "value", "type", "data_type", "total_pages")
    assert got == [("t1", "fg1", "2024", "Range Right", "int", 7), ("t1", "fg2", None, "Range Right", "int", 5)]


def test_file_latency(snap):
    def file(fid, read, write, n=10):
        return {"database_id": 5, "file_id": fid, "num_of_reads": n, "num_of_writes": 10,
                "io_stall_read_ms": read * 10 + 9, "io_stall_write_ms": write * 10, "size_on_disk_bytes": 1536 * 1024 + 1}

    s = snap(databases=DATABASES, file_io_stats=[file(1, 9, 10), file(2, 4, 15), file(1, 20, 19), file(3, 1, 1, 0)])
    got = rows(memory_io.file_latency(s), "database_name", "file_type", "size_on_disk_mb", "avg_read_ms",
               "read_rating", "avg_write_ms", "write_rating")
    assert sorted(got) == [
        ("sales", "Data", 1.5, 9, "Good", 10, "Acceptable"),
        ("sales", "Data", 1.5, 20, "Unacceptable", 19, "Acceptable"),
        ("sales", "Log", 1.5, 4, "Good", 15, "Unacceptable"),
    ]


def test_buffer_reports(snap):
    def pages(db, unit, n):
        return [{"database_id": db, "allocation_unit_id": unit}] * n

    s = snap(
        databases=DATABASES,
        buffer_pages=pages(5, 1, 127) + pages(5, 2, 1) + pages(5, 9, 5) + pages(6, 1, 3) + pages(32767, 1, 2),
        allocation_units=[{"database_id": 5, "allocation_unit_id": u, "container_id": 50, "type": t}
                          for u, t in ((1, 1), (2, 2), (9, 0))],
        partitions=[{"database_id": 5, "hobt_id": 50, "object_id": 1, "index_id": 1}],
        objects=[{"database_id": 5, "object_id": 1, "name": "t1"}],
        indexes=[{"database_id": 5, "object_id": 1, "index_id": 1, "name": "ix", "type_desc": "CLUSTERED"}],
    )
    got = rows(memory_io.buffer_by_object(s, database_id=5), "object_name", "index_name",
               "buffered_page_count", "buffer_mb")
    assert got == [("t1", "ix", 128, 1)]
    got = rows(memory_io.buffer_by_database(s), "database_name", "buffered_page_count", "buffer_pool_mb")
    assert got == [("sales", 133, 1), ("stock", 3, 0), ("ResourceDb", 2, 0)]


def test_disk_usage(snap):
    db = {"database_id": 5}
    s = snap(
        space_used=[{"table_name": "a", "rows_cnt": "7", "data": "12345 KB", "index_size": "8 KB"},
                    {"table_name": "b", "rows_cnt": "0", "data": "0 KB", "index_size": "0 KB"}],
        sys_databases=[{"name": "sales", "dbid": 5, "status": 16}, {"name": "off", "dbid": 6, "status": 512},
                       {"name": "pubs", "dbid": 7, "status": 0}, {"name": "msdb", "dbid": 4, "status": 0}],
        sys_objects_legacy=[{"database_id": d, "id": 1, "name": "t", "xtype": "U"} for d in (4, 5, 6, 7)]
        + [{**db, "id": 2, "name": "s", "xtype": "S"}],
        sys_indexes=[{"database_id": d, "id": i, "indid": n, "name": name, "status": st, "rowcnt": 9,
                      "reserved": 256, "used": 1}
                     for d, i, n, name, st in ((5, 1, 1, "pk", 2066), (5, 1, 2, "_WA_Sys_x", 0),
                                               (5, 1, 3, "_wa_sys_x", 0), (5, 1, 4, "nokey", 0),
                                               (6, 1, 1, "x", 0), (7, 1, 1, "x", 0), (4, 1, 1, "x", 0),
                                               (5, 2, 1, "x", 0))],
        sys_index_keys=[{"database_id": d, "id": i, "indid": n, "keyno": k, "colid": k}
                        for d, i, n in ((5, 1, 1), (5, 1, 2), (5, 1, 3), (6, 1, 1), (7, 1, 1), (4, 1, 1), (5, 2, 1))
                        for k in (1, 2)],
        sys_columns=[{"database_id": d, "id": i, "colid": k, "xtype": 56}
                     for d in (4, 5, 6, 7) for i in (1, 2) for k in (1, 2)],
        sys_types=[{"database_id": d, "xtype": 56, "name": "int"} for d in (4, 5, 6, 7)],
    )
    got = rows(storage.disk_usage_by_table(s), "table_name", "row_count", "data_kb", "total_kb")
    assert got == [("a", 7, 12345, 12353), ("b", 0, 0, 0)]
    got = rows(storage.disk_usage_by_index(s), "db_name", "table_name", "index_name", "clustered", "reserved_mb")
    assert sorted(got) == [("sales", "t", "_WA_Sys_x", 0, 2), ("sales", "t", "pk", 1, 2)]
    flags = storage.index_details(s).filter("index_name = 'pk'")
    assert rows(flags, "is_primary", "clustered", "is_unique", "ignore_dup_key") == [(1, 1, 1, 0)]


def test_backups(snap):
    new, old = dt.datetime(2024, 4, 2), dt.datetime(2024, 4, 1)
    s = snap(
        databases=DATABASES,
        backup_sets=[{"database_name": "sales", "type": "D", "backup_finish_date": t} for t in (old, new)]
        + [{"database_name": "stock", "type": "L", "backup_finish_date": new},
           {"database_name": "tempdb", "type": "D", "backup_finish_date": new},
           {"database_name": "master", "type": "D", "backup_finish_date": old}],
        backup_media=[{"physical_device_name": d} for d in ("x", "y", "x")],
    )
    got = rows(backups.last_backup(s), "name", "last_backup_finish_date", "label")
    assert got == [("sales", new, None), ("master", old, None), ("msdb", None, "No Backup"), ("stock", None, "No Backup")]
    assert sorted(rows(backups.backup_locations(s), "physical_device_name")) == [("x",), ("y",)]


def test_resource_reports(snap):
    def at(minute, cpu, io=1.0, log=1.0, db="d"):
        return {"end_time": TS - dt.timedelta(minutes=minute), "database_name": db, "avg_cpu_percent": cpu,
                "avg_data_io_percent": io, "avg_log_write_percent": log}

    data = [at(0, 80.0), at(5, 80.1), at(70, None, None, None), at(90, 99.0, 10.0, 99.5, "e")]
    s = snap(db_resource_stats=data, resource_stats=data)
    assert rows(resource.resource_fit(s), "cpu_fit", "log_write_fit", "data_read_fit") == [(0.5, 0.75, 1.0)]
    assert rows(resource.resource_fit(s, last_minutes=60), "cpu_fit") == [(0.5,)]
    assert rows(resource.latest_resource(s, n=2), "avg_cpu_percent") == [(80.0,), (80.1,)]
    assert rows(resource.latest_resource(s, last_minutes=4), "avg_cpu_percent") == [(80.0,)]
    assert rows(resource.dtu_percent(s, "d"), "avg_dtu_percent") == [(80.0,), (80.1,), (None,)]
    empty = snap(db_resource_stats=[])
    assert rows(resource.resource_fit(empty, scope=()), "cpu_fit") == [(None,)]


def test_inventory(snap):
    s = snap(
        databases=DATABASES,
        master_files=[{"database_id": 5, "name": "f", "type_desc": "ROWS", "physical_name": "/f"}],
        filegroups=[{"database_id": 5, "name": "PRIMARY"}],
        configurations=[{"name": "z", "value": 1}, {"name": "a", "value": 2}],
        logins=[{"name": n, "sysadmin": a, "securityadmin": b} for n, a, b in (("x", 1, 0), ("y", 0, 1), ("z", 0, 0))],
    )
    assert rows(inventory.database_files(s), "database_name", "physical_name") == [("sales", "/f")]
    assert inventory.databases(s).count() == 5 and inventory.filegroups(s).count() == 1
    assert rows(inventory.configuration(s), "name") == [("a",), ("z",)]
    assert sorted(rows(inventory.privileged_logins(s), "name")) == [("x",), ("y",)]
