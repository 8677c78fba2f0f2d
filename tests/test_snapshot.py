import datetime as dt
import glob
import threading

import pytest
from conftest import TS, rows
from pyspark.sql import functions as F

from fleetstats.sources import (
    Store, append, latest, open_snapshot, publish, read, restrict, schema, scratch, settle, store, tables, together,
)


def test_every_table_has_a_declared_schema(spark):
    for t in tables():
        assert schema(t).fieldNames()[:2] == ["server_id", "snapshot_ts"]


def test_append_read_and_prune(spark, snap, tmp_path):
    day = dt.timedelta(days=1)
    waits = snap(wait_stats=[
        {"server_id": s, "snapshot_ts": TS + day * d, "wait_type": "W", "wait_time_ms": d}
        for s in ("a", "b", "c") for d in range(3)
    ])["wait_stats"]
    base = str(tmp_path)
    append(waits.filter("wait_time_ms < 2"), base, "wait_stats")
    append(waits.filter("wait_time_ms = 2"), base, "wait_stats")
    assert glob.glob(f"{base}/wait_stats/attempt=*/snapshot_date=2024-05-03")
    everything = open_snapshot(spark, base)["wait_stats"]
    assert everything.schema.fieldNames() == schema("wait_stats").fieldNames()
    assert everything.count() == 9

    some = read(spark, base, "wait_stats", servers=["a", "c"], since=TS + day, until=TS + 2 * day)
    assert sorted(rows(some, "server_id", "wait_time_ms")) == [("a", 1), ("c", 1)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    head = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert "snapshot_date" in head and "server_bucket" in head
    assert "In(server_id" in plan.replace(" ", "")

    assert sorted(rows(latest(everything), "server_id", "wait_time_ms")) == [("a", 2), ("b", 2), ("c", 2)]


def test_reports_run_on_stored_snapshots(spark, snap, tmp_path):
    from fleetstats.plans.waits import wait_pareto

    made = snap(wait_stats=[{"wait_type": "W", "wait_time_ms": 5}, {"server_id": "b", "wait_type": "V", "wait_time_ms": 1}])
    append(made["wait_stats"], str(tmp_path), "wait_stats")
    got = rows(wait_pareto(open_snapshot(spark, str(tmp_path), servers=["a"])), "server_id", "wait_type")
    assert got == [("a", "W")]


def test_a_repeated_collection_changes_nothing(spark, snap, tmp_path):
    waits = snap(wait_stats=[
        {"server_id": s, "wait_type": w, "wait_time_ms": 1} for s in "ab" for w in ("V", "W")
    ])["wait_stats"]
    append(waits.filter("wait_type = 'V'"), str(tmp_path), "wait_stats")
    append(waits, str(tmp_path), "wait_stats")
    append(waits, str(tmp_path), "wait_stats")
    assert read(spark, str(tmp_path), "wait_stats").count() == 4


def test_days_do_not_depend_on_the_session(spark, snap, tmp_path):
    at = dt.datetime(2024, 5, 2, 0, 45)
    zone = spark.conf.get("spark.sql.session.timeZone")
    waits = snap(wait_stats=[{"snapshot_ts": at, "wait_type": "W", "wait_time_ms": 1}])["wait_stats"]
    try:
        for writer, reader, until, since in (
            ("UTC", "America/Los_Angeles", "2024-05-01 18:30:00", "2024-05-01 17:30:00"),
            ("Asia/Tokyo", "UTC", "2024-05-02 01:30:00", "2024-05-02 00:30:00"),
        ):
            base = str(tmp_path / writer.replace("/", "-"))
            spark.conf.set("spark.sql.session.timeZone", writer)
            append(waits, base, "wait_stats")
            spark.conf.set("spark.sql.session.timeZone", reader)
            assert read(spark, base, "wait_stats", until=until).count() == 1
            assert read(spark, base, "wait_stats", since=since).count() == 1
            assert read(spark, base, "wait_stats", until=since).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_a_scope_over_collections_reads_the_newest(spark, snap):
    from fleetstats.plans.resource import resource_fit
    from fleetstats.plans.waits import top_waits

    later = TS + dt.timedelta(days=1)
    made = snap(wait_stats=[
        {"wait_type": "W", "wait_time_ms": 1000}, {"snapshot_ts": later, "wait_type": "W", "wait_time_ms": 1500},
        {"server_id": "b", "wait_type": "W", "wait_time_ms": 3000},
    ])
    assert rows(top_waits(made, scope=()), "wait_time_s") == [(4,)]
    assert sorted(rows(top_waits(made, scope=["server_id"]), "server_id", "wait_time_s")) == [("a", 1), ("b", 3)]
    assert len(top_waits(made).collect()) == 3
    series = [{"snapshot_ts": t, "end_time": e, "avg_cpu_percent": p, "avg_data_io_percent": 1.0, "avg_log_write_percent": 1.0}
              for t in (TS, later) for e, p in ((TS, 90.0), (TS - dt.timedelta(hours=1), 10.0))]
    series.append({"snapshot_ts": later, "end_time": later, "avg_cpu_percent": 10.0, "avg_data_io_percent": 1.0,
                   "avg_log_write_percent": 1.0})
    fit = resource_fit(snap(db_resource_stats=series), scope=()).first()
    assert abs(float(fit.cpu_fit) - 2 / 3) < 1e-6


class FakeSession:
    """A session on a cluster, with or without the checkpoint setting."""

    def __init__(self, folder=None):
        self.conf = self.sparkContext = self
        self.folder, self.master, self.applicationId = folder, "spark://host:7077", "app"

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" and self.folder else default


def test_settled_rows_do_not_change(spark):
    kept = settle(spark.range(5).withColumn("r", F.rand()), "numbers")
    assert kept.collect() == kept.collect()


def test_scratch_is_under_the_session_folder():
    session = FakeSession("hdfs://shared/checkpoints/")
    path = scratch.scratch_dir(session, "x")
    assert path.startswith("hdfs://shared/checkpoints/fleetstats/app/x-")
    assert path != scratch.scratch_dir(session, "x")


def test_scratch_refuses_a_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        scratch.scratch_dir(FakeSession(), "x")


def test_steps_run_at_the_same_time_and_a_failure_is_raised(spark):
    meet = threading.Barrier(2, timeout=60)
    assert together(spark, lambda: meet.wait() >= 0, lambda: meet.wait() >= 0, lambda: spark.range(3).count()) == [True, True, 3]
    assert together(spark) == []
    with pytest.raises(ZeroDivisionError):
        together(spark, lambda: 1, lambda: 1 // 0)


def test_tables_of_a_collection_are_written_at_the_same_time(spark, snap, tmp_path, monkeypatch):
    made = snap(wait_stats=[{"wait_type": "W", "wait_time_ms": 1}], databases=[{"database_id": 1, "name": "master"}])
    meet, typed = threading.Barrier(2, timeout=60), store.typed
    monkeypatch.setattr(store, "typed", lambda df, table: meet.wait() >= 0 and typed(df, table))
    assert publish(spark, made, str(tmp_path), "one")
    again = open_snapshot(spark, str(tmp_path))
    assert rows(again["wait_stats"], "wait_type") == [("W",)] and rows(again["databases"], "name") == [("master",)]


def test_the_index_is_asked_once_for_all_tables(spark, snap, tmp_path, monkeypatch):
    made = snap(wait_stats=[{"server_id": s, "wait_type": s, "wait_time_ms": 1} for s in "ab"],
                databases=[{"server_id": s, "database_id": 1, "name": s} for s in "ab"])
    publish(spark, made, str(tmp_path), "one")
    asked, index = [], Store.index
    monkeypatch.setattr(Store, "index", lambda self, *names: asked.append(names) or index(self, *names))
    some = restrict(open_snapshot(spark, str(tmp_path)), made["databases"].filter("server_id = 'b'"))
    assert rows(some["wait_stats"], "wait_type") == [("b",)] and rows(some["databases"], "name") == [("b",)]
    assert some["sessions"].count() == 0 and some["sessions"].schema.fieldNames() == schema("sessions").fieldNames()
    assert len(asked) == 1
