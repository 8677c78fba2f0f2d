"""Names as of a time, growth of counters, published collections, and their streams."""

from __future__ import annotations

import datetime as dt
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import DATABASES, TS, rows
from pyspark.sql import functions as F

from fleetstats.operators import deltas, last_before, lookup
from fleetstats.plans.intervals import io_per_interval, waits_per_interval
from fleetstats.plans.waits import top_waits
from fleetstats.sources import Store, as_of, land, open_snapshot, publish, publish_landed, restrict, schema, store, sweep
from fleetstats.sources.snapshot import newest
from fleetstats.streaming import deltas_stream

HOUR = dt.timedelta(hours=1)


def at(h: float) -> dt.datetime:
    return TS + HOUR * h


# names as of a time


@pytest.mark.parametrize("slice_seconds", [3600, 86_400])
def test_last_before_equals_brute_force(spark, slice_seconds):
    rng = random.Random(1)
    # key 0 holds most rows
    keys = [0] * 8 + [1, 2, None]
    asked = [(rng.choice(keys), at(rng.randrange(90))) for _ in range(400)]
    there = [(rng.choice(keys), at(rng.randrange(90) + rng.choice([0, 0.5]))) for _ in range(60)]
    got = last_before(spark.createDataFrame(asked, "k int, t timestamp"), spark.createDataFrame(there, "k int, s timestamp"),
                      ["k"], "t", "s", slice_seconds)
    want = set()
    for k, t in set(asked):
        seen = [s for j, s in there if j == k and k is not None and s <= t]
        if seen:
            want.add((k, t, max(seen)))
    found = rows(got, "k", "t", "s")
    assert len(found) == len(want) and set(found) == want


def test_a_lookup_takes_the_newest_row_of_its_time(spark, snap):
    text = snap(query_text=[
        {"snapshot_ts": at(-5), "sql_handle": "a", "text": "old"}, {"snapshot_ts": at(1), "sql_handle": "a", "text": "new"},
        {"snapshot_ts": at(0), "sql_handle": "b", "text": "same time"}, {"snapshot_ts": at(3), "sql_handle": "c", "text": "too late"},
        {"server_id": "b", "snapshot_ts": at(-1), "sql_handle": "a", "text": "of another server"}])
    stats = snap(query_stats=[
        {"snapshot_ts": at(h), "sql_handle": s} for h, s in ((0, "a"), (2, "a"), (0, "b"), (0, "c"), (0, None))])["query_stats"]
    for how, want in (("inner", {("a", at(0), "old"), ("a", at(2), "new"), ("b", at(0), "same time")}),
                      ("left", {("a", at(0), "old"), ("a", at(2), "new"), ("b", at(0), "same time"), ("c", at(0), None), (None, at(0), None)})):
        out = lookup(stats, as_of(text)["query_text"], {"sql_handle": "sql_handle"}, {"text": "text"}, ("server_id", "snapshot_ts"), how)
        assert set(rows(out, "sql_handle", "snapshot_ts", "text")) == want
    semi = lookup(stats, as_of(text)["query_text"], {"sql_handle": "sql_handle"}, {}, ("server_id", "snapshot_ts"), "left_semi")
    assert sorted(rows(semi, "sql_handle", "snapshot_ts")) == [("a", at(0)), ("a", at(2)), ("b", at(0))]


def test_a_busy_server_can_be_split(spark, snap):
    made = snap(query_stats=[{"sql_handle": "a"}], query_text=[{"sql_handle": "a", "text": "t"}])
    out = lookup(made["query_stats"], as_of(made)["query_text"], {"sql_handle": "sql_handle"}, {"text": "text"}, ("server_id", "snapshot_ts"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = out.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the join with the counters has a shuffle of its own on both sides, by key and time
    join = plan[plan.index("SortMergeJoin"):]
    assert join.count("_asked") and "_slice" in plan and "CartesianProduct" not in plan


def test_reports_see_names_of_catalogs_collected_before(spark, snap):
    from fleetstats.plans.queries import reads_by_database

    made = snap(
        query_stats=[{"snapshot_ts": at(h), "sql_handle": "a", "total_logical_reads": 7, "execution_count": 1} for h in (1, 30)],
        query_text=[{"snapshot_ts": at(0), "sql_handle": "a", "dbid": 5, "text": "t"}],
        databases=[{"snapshot_ts": at(0.5), **d} for d in DATABASES] + [{"snapshot_ts": at(24), "database_id": 5, "name": "renamed"}])
    assert reads_by_database(made).count() == 0
    assert rows(reads_by_database(as_of(made)), "snapshot_ts", "total_reads", "database_name") == [
        (at(1), 7, "sales"), (at(30), 7, "renamed")]


# growth of counters


def test_deltas_equal_brute_force(spark):
    rng = random.Random(2)
    data = {}
    for k in (None, "a", "b", "c"):
        for s in ("x", "y"):
            for h in rng.sample(range(80), 25):
                data[s, k, at(h)] = (rng.choice([None, rng.randrange(50)]), rng.randrange(50))
    flat = [(*key, *v) for key, v in data.items()]
    df = spark.createDataFrame(flat + flat[:9], "s string, k string, t timestamp, m bigint, n bigint")
    for together in (None, ["s"]):
        fell, steps = set(), []
        for s in ("x", "y"):
            for k in (None, "a", "b", "c"):
                times = sorted(t for x, y, t in data if (x, y) == (s, k))
                for was, now in zip(times, times[1:]):
                    old, new = ([x or 0 for x in data[s, k, t]] for t in (was, now))
                    if any(b < a for a, b in zip(old, new)):
                        fell.add((s, now) if together else (s, k, now))
                    steps.append((s, k, was, now, old, new))
        want = set()
        for s, k, was, now, old, new in steps:
            reset = ((s, now) if together else (s, k, now)) in fell
            want.add((s, k, was, now, (now - was).total_seconds(), reset, *(b - (0 if reset else a) for a, b in zip(old, new))))
        got = rows(deltas(df, ["s", "k"], "t", ["m", "n"], together, slice_seconds=7200), "s", "k", "since", "t", "seconds", "restarted", "m", "n")
        assert len(got) == len(want) and set(got) == want


def test_a_restart_of_the_server_resets_all_its_counters(spark, snap):
    waits = [{"snapshot_ts": at(h), "wait_type": w, "wait_time_ms": v}
             for w, values in (("V", (10, 70, 20)), ("W", (0, 0, 5))) for h, v in enumerate(values)]
    got = waits_per_interval(snap(wait_stats=waits))
    assert sorted(rows(got, "wait_type", "since", "wait_time_ms", "restarted")) == [
        ("V", at(0), 60, False), ("V", at(1), 20, True), ("W", at(1), 5, True)]
    files = [{"snapshot_ts": at(h), "database_id": 1, "file_id": 1, "num_of_reads": n, "io_stall_read_ms": 3 * n, "num_of_writes": 2,
              "io_stall_write_ms": 2} for h, n in ((0, 5), (2, 9))]
    assert rows(io_per_interval(snap(file_io_stats=files)), "seconds", "num_of_reads", "avg_read_ms", "avg_write_ms") == [(7200.0, 4, 3, None)]


# published collections


def waits_at(snap, *moments, servers=("a",)):
    return snap(wait_stats=[{"server_id": s, "snapshot_ts": t, "wait_type": "W", "wait_time_ms": 1000} for t in moments for s in servers])["wait_stats"]


def test_a_collection_is_published_once(spark, snap, tmp_path):
    base = str(tmp_path)
    frames = {"wait_stats": waits_at(snap, TS, servers="abc"), "databases": snap(databases=DATABASES)["databases"]}
    assert publish(spark, frames, base, "first")
    assert not publish(spark, frames, base, "first")
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda _: publish(spark, {"wait_stats": waits_at(snap, at(1))}, base, "second"), range(4)))
    assert sum(done) == 1
    assert Store(spark, base).frame("wait_stats").count() == 4 and Store(spark, base).frame("databases").count() == len(DATABASES)
    with pytest.raises(ValueError):
        publish(spark, frames, base, "a/b")


def test_a_failed_collection_is_not_seen(spark, snap, tmp_path, monkeypatch):
    base = str(tmp_path)
    publish(spark, {"wait_stats": waits_at(snap, TS)}, base, "first")

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_move_new", fail)
        with pytest.raises(OSError):
            publish(spark, {"wait_stats": waits_at(snap, at(1))}, base, "second")
    assert Store(spark, base).frame("wait_stats").count() == 1
    assert publish(spark, {"wait_stats": waits_at(snap, at(1))}, base, "second")
    assert Store(spark, base).frame("wait_stats").count() == 2
    assert sweep(spark, base, ["wait_stats"], 3600) == 0
    assert sweep(spark, base, ["wait_stats", "databases"], -60) == 1
    assert Store(spark, base).frame("wait_stats").count() == 2


def test_a_table_of_a_collection_may_lack_columns_and_rows(spark, tmp_path):
    some = spark.createDataFrame([("a", TS, "W")], "server_id string, snapshot_ts timestamp, wait_type string")
    assert publish(spark, {"wait_stats": some, "databases": some.limit(0)}, str(tmp_path), "x")
    got = Store(spark, str(tmp_path)).frame("wait_stats")
    assert got.schema.fieldNames() == schema("wait_stats").fieldNames() and rows(got, "wait_type", "wait_time_ms") == [("W", None)]
    assert Store(spark, str(tmp_path)).frame("databases").count() == 0
    assert publish(spark, {}, str(tmp_path), "nothing")


def test_the_index_prunes_what_newest_and_restrict_read(spark, snap, tmp_path):
    base = str(tmp_path)
    for d in range(4):
        publish(spark, {"wait_stats": waits_at(snap, at(24 * d), servers="ab" if d < 3 else "a")}, base, f"day{d}")
    stored = open_snapshot(spark, base)
    assert rows(top_waits(stored, scope=()), "wait_time_s") == [(2,)]

    def filters(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]

    def attempts(df):
        return {f.split("attempt=")[1].split("/")[0] for f in df.inputFiles() if "/wait_stats/" in f}

    last = newest(stored)["wait_stats"]
    assert sorted(rows(last, "server_id", "snapshot_ts")) == [("a", at(72)), ("b", at(48))]
    said = filters(last)
    assert "snapshot_date" in said and "server_bucket" in said and len(attempts(last)) == 2
    moment = spark.createDataFrame([("b", at(24))], "server_id string, snapshot_ts timestamp")
    one = restrict(stored, moment)["wait_stats"]
    assert rows(one, "server_id", "snapshot_ts") == [("b", at(24))]
    assert "snapshot_date" in filters(one) and "server_bucket" in filters(one) and len(attempts(one)) == 1
    limited = newest(open_snapshot(spark, base, until=at(48)))["wait_stats"]
    assert sorted(rows(limited, "server_id", "snapshot_ts")) == [("a", at(24)), ("b", at(24))]


# files of differing columns


def test_files_that_drift_are_landed_whole(spark, tmp_path):
    sent = spark.createDataFrame(
        [("a", "2024-05-01 12:00:00", "W", "7", None, None), ("a", "2024-05-01 12:00:00", "V", "many", "x", None),
         ("a", "yesterday", "U", "1", None, None), (None, "2024-05-01 12:00:00", "T", "1", None, None),
         ("b", "2024-05-01 12:00:00", "S", None, "kept", None), ("b", "2024-05-01 12:00:00", "R", "3", None, "9")],
        "Host string, snapshot_TS string, `Wait_Type ` string, WAIT_TIME_MS string, note string, ms string")
    landed = land(sent, "wait_stats", {"host": "server_id", "ms": "wait_time_ms"})
    assert landed.rows.schema.fieldNames() == schema("wait_stats").fieldNames()
    assert sorted(rows(landed.rows, "server_id", "snapshot_ts", "wait_type", "wait_time_ms")) == [("a", TS, "W", 7), ("b", TS, "S", None)]
    assert sorted(r.reasons for r in landed.rejects.collect()) == [["server_id"], ["snapshot_ts"], ["wait_time_ms"], ["wait_time_ms"]]
    assert all('"Wait_Type "' in r.row for r in landed.rejects.collect())
    assert rows(landed.extras, "server_id", "row") == [("b", '{"note":"kept"}')]
    base = str(tmp_path)
    assert publish_landed(spark, {"wait_stats": landed}, base, "x") and not publish_landed(spark, {"wait_stats": landed}, base, "x")
    assert Store(spark, base).frame("wait_stats").count() == 2
    assert spark.read.parquet(f"{base}/aside/x/wait_stats/rejects").count() == 4
    plain = land(spark.createDataFrame([("a", TS)], "server_id string, snapshot_ts timestamp"), "wait_stats")
    assert plain.rows.count() == 1 and plain.rejects.count() == 0 and plain.extras.count() == 0


# streams


def test_counters_of_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(3)
    ddl = "s string, w string, t timestamp, n bigint"
    values = [(s, w, at(h), rng.choice([None, rng.randrange(40)])) for h in range(8) for s in ("x", "y") for w in ("v", None)]
    for h in ((0, 1, 2), (2, 3), (1, 4, 5), (6, 7)):
        part = spark.createDataFrame([v for v in values if v[2] in [at(x) for x in h]], ddl)
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    (deltas_stream(stream, ["s", "w"], "t", ["n"]).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state")
     .option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination())
    cols = ["s", "w", "since", "t", "seconds", "restarted", "n"]
    got = rows(spark.read.parquet(f"{tmp_path}/out"), *cols)
    want = rows(deltas(spark.createDataFrame(values, ddl), ["s", "w"], "t", ["n"]), *cols)
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 28


def test_names_as_of_a_time_do_not_move_the_rows_that_ask(spark):
    from fleetstats.catalog import QUERIES

    plan = QUERIES["examine_locks_as_of"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_texts_as_of_a_time_are_found_for_requests_and_not_for_locks(spark, monkeypatch):
    from fleetstats.catalog import QUERIES
    from fleetstats.operators import asof

    asked, settle = [], asof.settle
    monkeypatch.setattr(asof, "settle", lambda df, purpose: asked.append((purpose, set(df.columns))) or settle(df, purpose))
    QUERIES["current_locks_as_of"](spark, "/root/testdata/sf0.001")
    asked = [columns for purpose, columns in asked if purpose == "asked"]
    assert len(asked) == 3 and not any("lock_owner_address" in c and ("sql_handle" in c or "_sql" in c or len(c) > 14) for c in asked)
