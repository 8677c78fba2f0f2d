"""The lock report on a small server: sessions 51..60, most special cases once."""

import datetime as dt
from decimal import Decimal as D

import pytest
from conftest import DATABASES, TS, rows
from pyspark.sql import functions as F

from fleetstats.plans import lock_steps as ls, locks as lk

KEYS = ["server_id", "snapshot_ts"]


def lock(session, entity=0, mode="X", rtype="OBJECT", status="GRANT", db=5, description="", owner="TRANSACTION", **more):
    return {"request_session_id": session, "resource_database_id": db, "resource_associated_entity_id": entity,
            "request_mode": mode, "request_type": "LOCK", "request_status": status, "request_owner_type": owner,
            "resource_type": rtype, "resource_subtype": "", "resource_description": description, **more}


def wait(session, task, bsession=None, btask=None, ms=1500, wtype="LCK_M_X", **more):
    return {"session_id": session, "waiting_task_address": task, "blocking_session_id": bsession,
            "blocking_task_address": btask, "wait_type": wtype, "wait_duration_ms": ms, **more}


def session(sid, **more):
    return {"session_id": sid, "is_user_process": True, "login_name": f"u{sid}", "original_login_name": f"u{sid}",
            "status": "sleeping", "endpoint_id": 4, "host_name": "h", "host_process_id": 7, "program_name": "app",
            "cpu_time": 10, "reads": 1, "writes": 2, "logical_reads": 3, "login_time": TS - dt.timedelta(days=1),
            "last_request_start_time": TS - dt.timedelta(seconds=2.5), "quoted_identifier": True, "arithabort": False,
            "ansi_null_dflt_on": True, "ansi_defaults": False, "ansi_warnings": True, "ansi_padding": True,
            "ansi_nulls": True, "concat_null_yields_null": True, "transaction_isolation_level": 2,
            "lock_timeout": -1, "deadlock_priority": 0, **more}


def task(address, sid, context=0, **more):
    return {"task_address": address, "session_id": sid, "exec_context_id": context, "request_id": 0,
            "task_state": "SUSPENDED", **more}


def request(sid, address, rid=0, **more):
    return {"session_id": sid, "request_id": rid, "task_address": address, "status": "suspended", "command": "UPDATE",
            "database_id": 5, "cpu_time": 4, "total_elapsed_time": 9, "reads": 1, "writes": 1, "logical_reads": 5,
            "percent_complete": 0.0, "open_transaction_count": 1, "executing_managed_code": False, "nest_level": 1,
            "sql_handle": "s", "plan_handle": "p", "statement_start_offset": 0, "statement_end_offset": -1, **more}


def space(sid, pages):
    return {"session_id": sid, "user_objects_alloc_page_count": pages, "user_objects_dealloc_page_count": 0,
            "internal_objects_alloc_page_count": 0, "internal_objects_dealloc_page_count": 0}


@pytest.fixture(scope="module")
def server(snap):
    db = {"database_id": 5}
    temp = "#t" + "_" * 126
    return snap(
        databases=DATABASES,
        schemas=[{**db, "schema_id": 1, "name": "dbo"}, {"database_id": 2, "schema_id": 1, "name": "dbo"}],
        objects=[{**db, "object_id": 1, "schema_id": 1, "name": "t1", "type": "U"},
                 {**db, "object_id": 9, "schema_id": 1, "name": "proc", "type": "P"}]
        + [{"database_id": 2, "object_id": i, "schema_id": 1, "name": n}
           for i, n in ((1, temp), (2, temp), (3, "#0A1B2C3D"), (4, "##global"))],
        indexes=[{**db, "object_id": 1, "index_id": i, "name": n, "type_desc": "X"}
                 for i, n in ((0, None), (1, "pk"), (2, "ix"))],
        partitions=[{**db, "partition_id": 100 + i, "hobt_id": i, "object_id": 1, "index_id": x, "partition_number": n}
                    for i, x, n in ((10, 1, 1), (11, 2, 2))],
        allocation_units=[{**db, "allocation_unit_id": 20 + t, "container_id": c, "type": t, "type_desc": f"T{t}"}
                          for t, c in ((0, 0), (1, 11), (2, 110))],
        tran_locks=[
            lock(51, 1), lock(51, 1), lock(51, rtype="DATABASE", mode="S"),
            lock(52, 1, status="WAIT"), lock(52, 11, rtype="KEY"), lock(52, 77), lock(52, 99, rtype="HOBT"),
            *[lock(52, 20 + t, rtype="ALLOCATION_UNIT") for t in (0, 1, 2, 3)],
            lock(53, rtype="APPLICATION", description="mine"), lock(53, rtype="APPLICATION", description=""),
            lock(53, 5, rtype="METADATA", description="a"), lock(53, 5, rtype="METADATA", description="b"),
            *[lock(54, i, db=2) for i in (1, 2, 3, 4)],
            lock(55, rtype="DATABASE"),               # idle: only a granted database lock
            lock(59, 1, status="CONVERT", owner="SHARED_TRANSACTION_WORKSPACE"),  # no such session
            lock(60, 1, status="WAIT"),               # waits for a lock, not in the waits
        ],
        waiting_tasks=[
            wait(52, "a52", 51), wait(52, "a52", 51), wait(53, "a53", 52, "a52", ms=20),
            wait(53, "a53", 54, "a54"), wait(54, "a54", 56, "a56"), wait(56, "a56", 54, "a54"),
            wait(None, "sys", wtype="CLR_AUTO_EVENT"), wait(None, "child", wtype="LOGMGR_QUEUE", ms=40),
            wait(None, "gone", wtype="LOGMGR_QUEUE"),
        ],
        sessions=[session(i) for i in (51, 55, 57, 58)] + [
            session(52, deadlock_priority=-5, arithabort=True), session(53, login_name="other"),
            session(54, is_user_process=False), session(56, last_request_start_time=dt.datetime(2024, 1, 1)),
            session(60, transaction_isolation_level=4, lock_timeout=30), session(50)],
        session_process=[{"spid": i, "ecid": 0, "dbid": 5, "open_tran": int(i == 57)}
                         for i in (50, 51, 52, 53, 54, 55, 56, 57, 58, 60)]
        + [{"spid": 51, "ecid": 1, "dbid": 1, "open_tran": 9}],
        tasks=[task("a50", 50), task("a52", 52), task("a53", 53, 1), task("a54", 54), task("a56", 56),
               task("child", None, parent_task_address="a52", task_state="RUNNING")],
        requests=[request(50, "a50"), request(52, "a52", percent_complete=33.4), request(53, "a53", 2, sql_handle="e"),
                  request(54, "a54"), request(56, "a56", executing_managed_code=True)],
        session_space=[space(55, 1000), space(58, 1001)],
        task_space=[{**space(52, 3), "request_id": 0, "database_id": 2},
                    {**space(52, 4), "request_id": 0, "database_id": 2},
                    {**space(52, 99), "request_id": 0, "database_id": 5}],
        session_transactions=[{"session_id": 52, "transaction_id": t, "is_user_transaction": True, "is_bound": t == 1}
                              for t in (1, 2)]
        + [{"session_id": 51, "transaction_id": 3, "is_user_transaction": False, "is_bound": False}],
        active_transactions=[
            {"transaction_id": t, "transaction_begin_time": b, "transaction_type": k, "transaction_state": 2, "dtc_state": d}
            for t, b, k, d in ((1, TS - dt.timedelta(seconds=90), 1, 0), (2, TS, 2, 0), (3, dt.datetime(2024, 3, 1), 4, 9))],
        endpoints=[{"endpoint_id": 4, "name": "tcp"}],
        last_command=[{"session_id": 51, "inputbuffer": "EXEC x"}],
        query_text=[{"sql_handle": "s", "dbid": 5, "objectid": 9, "text": "UPDATE t1 " + "x" * 60, "encrypted": False},
                    {"sql_handle": "e", "dbid": 5, "objectid": 9, "text": None, "encrypted": True}],
        query_plan=[{"plan_handle": "p", "query_plan": "<plan/>"}],
    )


def test_aggregate_locks(server):
    locks = ls.aggregate_locks(server["tran_locks"], KEYS)
    mine = lambda s: sorted(rows(locks.filter(f"session_id = {s}"), "rsc_type", "rsc_description", "cnt", "activelock"), key=str)
    assert mine(51) == [("DATABASE", None, 1, False), ("OBJECT", None, 2, True)]
    assert mine(53) == [("APPLICATION", "mine", 1, True), ("APPLICATION", None, 1, True), ("METADATA", None, 2, True)]


def test_clean_waits(server):
    waits = ls.clean_waits(server["waiting_tasks"], KEYS)
    got = sorted(rows(waits, "wait_session_id", "wait_task", "block_session_id", "block_task"), key=str)
    assert len(got) == 7
    assert (52, "a52", 51, "") in got
    assert (-1001, "child", None, None) in got and (-1002, "gone", None, None) in got


def test_oldest_transaction(server):
    out = ls.oldest_transaction(server["session_transactions"], server["active_transactions"], KEYS)
    got = sorted(rows(out, "session_id", "trans_since", "trans_type", "is_bound"))
    assert got == [(51, None, 4, False), (52, D("90.000"), 1, True)]


def processes(server, **options):
    locks = ls.aggregate_locks(server["tran_locks"], KEYS)
    return ls.assemble_processes(server, locks, ls.clean_waits(server["waiting_tasks"], KEYS),
                                 own_session=50, **options)


def test_assemble_processes_keeps_the_interesting(server):
    out = processes(server)
    # 55 has only a granted database lock and exactly 1,000 pages; 50 is the collector.
    assert sorted(r[0] for r in rows(out, "session_id")) == [51, 52, 53, 54, 56, 57, 58, 60]
    assert processes(server, all_processes=True).count() == 10
    one = out.filter("session_id = 52").first()
    assert (one.trancount, one.request_tempdb, one.deadlock_priority, one.lock_timeout) == (1, 7, -5, None)
    assert one.arithabort is True and float(one.last_since) == 2.5
    assert out.filter("session_id = 56").first().last_since is None


def test_sessionless_tasks(server):
    waits = ls.clean_waits(server["waiting_tasks"], KEYS)
    got = rows(ls.sessionless_tasks(waits, server["tasks"], KEYS), "session_id", "task_address",
               "exec_context_id", "task_state", "wait_time")
    assert sorted(got) == [(-1002, "", 0, "EXITED", D("1.500")), (52, "child", -9, "RUNNING", D("0.040"))]


def test_attach_blockers(server):
    chains = ls.blocking_chains(ls.clean_waits(server["waiting_tasks"], KEYS), KEYS)
    rows_ = processes(server).unionByName(
        ls.sessionless_tasks(ls.clean_waits(server["waiting_tasks"], KEYS), server["tasks"], KEYS),
        allowMissingColumns=True)
    out = ls.attach_blockers(rows_, chains, KEYS)
    got = {r.session_id: (r.block_level, r.block_label, r.wait_time)
           for r in out.filter("exec_context_id >= 0").collect()}
    assert got[51] == (0, None, None)
    assert got[52] == (1, "51", D("1.500"))
    # 53 waits for 52 (level 2) and for 54 in the deadlock (a tail); the tail comes first.
    assert got[53] == (1, "54 (+1)", D("1.500"))
    assert got[54][:2] == (None, "56") and got[56][:2] == (None, "54")


def test_names(server):
    locks = ls.aggregate_locks(server["tran_locks"], KEYS)
    objects = ls.resolve_objects(server, locks)
    got = {(r.idtype, r.database_id, r.entity_id): r.object_name for r in objects.collect()}
    assert got["OBJ", 5, 1] == "sales.dbo.t1" and got["OBJ", 5, 77] == "sales.<77>"
    assert got["HOBT", 5, 11] == "sales.dbo.t1.ix(2)" and got["HOBT", 5, 99] is None
    assert got["AU", 5, 20] == "sales (dropped table et al)"
    assert got["HOBT", 5, 21] == "sales.dbo.t1.ix(2) (T1)"
    assert got["AU", 5, 22] == "sales.dbo.t1" and got["AU", 5, 23] is None
    assert got["OBJ", 2, 1] == "#t" and got["OBJ", 2, 3] == "#(tblvar or dropped temp table)"
    assert got["OBJ", 2, 4] == "tempdb.dbo.##global"
    objects, merged = ls.consolidate_temp_tables(objects, locks, KEYS)
    named = ls.name_locks(merged, objects, KEYS).filter("session_id = 54")
    assert sorted(rows(named, "entity_id", "object_name", "cnt")) == [
        (1, "#t (x2)", 2), (3, "#(tblvar or dropped temp table)", 1), (4, "tempdb.dbo.##global", 1)]


@pytest.fixture(scope="module")
def report(server):
    return lk.lock_overview(server, own_session=50).collect()


def of(report, spid):
    return [r for r in report if r.spid == spid]


def test_report_rows(report):
    assert [r.spid for r in report][0] == "-1002" and report[-1].spid == "60"
    assert len(of(report, "51")) == 2 and len(of(report, "52")) == 8
    assert not of(report, "55") and not of(report, "50")
    # 53 runs in context 1 and request 2, so it gets an added main row for its locks.
    assert [r.lstatus for r in of(report, "53/1/2")] == [""] and len(of(report, "53")) == 3
    assert [r.object for r in of(report, "53") if r.rsctype == "APPLICATION"] == [None, "sales|mine"]


def test_report_first_row_shows_the_process(report):
    first, *others = of(report, "52")
    assert (first.lstatus, first.locktype, first.object) == ("WAIT", "X", "sales.dbo.t1")
    assert (first.login, first.host, first.endpoint, first.dbname) == ("u52", "h", "tcp", "sales")
    assert (first.ansiopts, first.trnopts) == ("ARITH ", "DP=-5")
    assert (first.cpu, first.physio, first.logreads, first.tempdb) == ("10 (4)", "3 (2)", "3 (5)", " (7)")
    assert (first.trninfo, first.trn_since, first.progress) == ("U-RW-2-BND", "     90.000", "33 %")
    assert (first.waittime, first.waittype, first.blklvl, first.blkby) == ("1.500", "LCK_M_X", "1", "51")
    assert (first.now, first.login_time) == ("12:00:00:000", "240430 12:00:00")
    assert first.current_sp == "sales.dbo.proc" and first.current_plan == "<plan/>"
    assert len(first.curstmt) == 70 and all(len(r.curstmt) == 50 for r in others)
    assert all(r.login == "" and r.cpu == "" and r.current_plan is None for r in others)
    assert all(r.blklvl == "1" and r.opntrn == "1" for r in others)


def test_report_marks(report):
    lead = of(report, "51")[0]
    assert (lead.blklvl, lead.blkby, lead.inputbuffer) == ("!!", "", "EXEC x")
    assert (lead.trninfo, lead.trn_since) == ("S-DIST-2-DTC:9", "")
    assert of(report, "54")[0].blklvl == "DD" and of(report, "54")[0].login == "SYSTEM PROCESS"
    assert of(report, "56")[0].clr == "CLR" and of(report, "56")[0].last_since is None
    assert of(report, "60")[0].blklvl == "??"
    assert of(report, "60")[0].trnopts == "Serializable  LT=30  "
    assert of(report, "53/1/2")[0].curstmt == "-- ENCRYPTED, pos 1 - 0"
    assert of(report, "53")[0].login == "u53 (other)"
    gone = of(report, "59")[0]
    assert (gone.command, gone.ownertype, gone.lstatus, gone.cnt) == (None, "STW", "CONVERT", "")
    assert of(report, "57")[0].cnt == "0"


def test_report_with_process_data_on_every_row(server, report):
    full = lk.lock_overview(server, own_session=50, first_row_only=False).collect()
    assert len(full) == len(report)
    assert all(r.login == "u52" for r in of(full, "52"))


def test_current_and_all_locks(snap):
    s = snap(
        databases=DATABASES,
        tran_locks=[lock(52, 1, status="WAIT", lock_owner_address="o1"), lock(51, 1, lock_owner_address="o2")],
        waiting_tasks=[wait(52, "a52", 51, "a51", resource_address="o1")],
        sessions=[session(51, nt_domain="D", nt_user_name="x"), session(52)],
        requests=[request(51, "a51", sql_handle="s1"), request(52, "a52", sql_handle="s2")],
        query_text=[{"sql_handle": "s1", "text": "one"}, {"sql_handle": "s2", "text": "two"}],
        query_plan=[{"plan_handle": "p", "query_plan": "<p/>"}],
    )
    got = rows(lk.current_locks(s), "database", "status", "blocking_user", "wait_s", "blocking_sql_text",
               "executing_sql_text")
    assert got == [("sales", "WAIT", "D\\x", 1.5, "one", "two")]
    assert sorted(rows(lk.examine_locks(s), "database_name", "request_session_id")) == [("sales", 51), ("sales", 52)]


def test_running_queries(snap):
    from fleetstats.plans.queries import running_queries

    s = snap(
        databases=DATABASES, sessions=[session(i, nt_domain="D", nt_user_name="x") for i in (51, 52, 53)],
        requests=[request(51, "a", total_elapsed_time=1), request(52, "b", total_elapsed_time=5), request(53, "c")],
        query_text=[{"sql_handle": "s", "text": "one"}], query_plan=[{"plan_handle": "p", "query_plan": "<p/>"}],
    )
    got = rows(running_queries(s, exclude_session=53), "session_id", "user", "sql_text")
    assert got == [(52, "D\\x", "one"), (51, "D\\x", "one")]


def test_the_report_is_written_before_it_is_sorted(spark):
    from fleetstats.catalog import QUERIES

    plan = QUERIES["lock_overview"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "Join" not in plan and "Window" not in plan


def test_locks_are_written_before_they_are_named_and_once_with_their_process(server, report, monkeypatch):
    from fleetstats.operators import ranking

    written, write = [], lk.settle
    for module in (lk, ls, ranking):
        monkeypatch.setattr(module, "settle", lambda df, purpose: written.append(purpose) or write(df, purpose))
    assert lk.lock_overview(server, own_session=50).collect() == report
    assert written.count("report") == 1 and written.count("kept") == 1
    assert not {"rows", "numbered", "named"} & set(written)


def test_sessions_with_very_many_locks_are_shown_like_others(server, report, monkeypatch):
    from fleetstats.operators import ranking

    sliced, original = [], ranking._sliced
    monkeypatch.setattr(ranking, "_WHOLE", 3)
    monkeypatch.setattr(ranking, "_sliced", lambda *a: sliced.append(1) or original(*a))
    assert lk.lock_overview(server, own_session=50).collect() == report and sliced


def test_several_plans_of_a_handle_are_shown_in_first_rows_only(server, report):
    plans = server["query_plan"]
    none = plans.withColumn("query_plan", F.lit(None).cast("string"))
    lost = plans.withColumn("plan_handle", F.lit(None).cast("string"))
    twice = server.with_tables(query_plan=plans.unionByName(plans).unionByName(none).unionByName(lost))
    full = lk.lock_overview(twice, own_session=50).collect()
    shown = sum(r.current_plan is not None for r in report)
    assert shown and len(full) == len(report) + 2 * shown
    assert sorted(str(r.current_plan) for r in of(full, "52") if r.login) == ["<plan/>", "<plan/>", "None"]
    assert [r.current_plan for r in of(full, "52") if not r.login] == [None] * 7
    every = lk.lock_overview(twice, own_session=50, first_row_only=False).collect()
    assert len(of(every, "52")) == 3 * len(of(report, "52"))


def test_the_report_as_of_finds_plans_of_their_time(server):
    from fleetstats.sources import as_of

    plans = server["query_plan"]
    older = plans.withColumns({"snapshot_ts": F.lit(TS - dt.timedelta(days=1)), "query_plan": F.lit("<older/>")})
    later = plans.withColumns({"snapshot_ts": F.lit(TS + dt.timedelta(days=1)), "query_plan": F.lit("<later/>")})
    earlier = plans.withColumn("snapshot_ts", F.lit(TS - dt.timedelta(hours=1)))
    snap = as_of(server.with_tables(query_plan=older.unionByName(earlier).unionByName(later)), ["query_plan"])
    full = lk.lock_overview(snap, own_session=50).collect()
    assert {r.current_plan for r in full} == {None, "<plan/>"}
