"""Collected snapshots: a name-to-DataFrame mapping, and its Parquet layout.

One table holds the rows of every server and database, so reading it once takes
the place of a loop over servers or databases.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import store
from .schemas import KEYS, schema, tables
from .scratch import settle
from .store import Store


class Snapshot(Mapping):
    """Tables by name. ``keys`` are the columns that tell snapshots apart; rows of
    different tables belong together only when all of them agree."""

    def __init__(self, frames: Mapping, keys: Iterable[str] = KEYS):
        self._frames = dict(frames)
        self.keys_ = tuple(keys)

    def __getitem__(self, name: str) -> DataFrame:
        frame = self._frames[name]
        if not isinstance(frame, DataFrame):
            frame = self._frames[name] = frame()
        return frame

    def __iter__(self):
        return iter(self._frames)

    def __len__(self):
        return len(self._frames)

    def with_tables(self, **frames) -> "Snapshot":
        return Snapshot({**self._frames, **frames}, self.keys_)


def append(df: DataFrame, base: str, table: str) -> bool:
    """Publish rows of a table under ``base``; False if there is nothing new in them.

    Rows that are there already are not written again, so a collection may be repeated. Only
    what the index knows of the new rows' servers and moments is looked through for them, and
    rows are compared by two hashes. The rows' own hash names the collection, so of two that
    append the same at once one is published. ``publish`` takes several tables at once.
    """
    spark = df.sparkSession
    new = store.typed(df, table).drop(store.DATE, store.BUCKET)

    def marked(rows: DataFrame) -> DataFrame:
        names = schema(table).fieldNames()
        # a NULL changes no hash by itself
        values = [v for n in names for v in (F.col(n), F.col(n).isNull())]
        return rows.withColumns({"_h1": F.xxhash64(*values), "_h2": F.xxhash64(F.lit(1), *values)})

    there = marked(Store(spark, base).frame(table, at=new.select(*KEYS).distinct()))
    new = marked(new).join(there.select(*KEYS, "_h1", "_h2").distinct(), [*KEYS, "_h1", "_h2"], "left_anti")
    new = settle(new, "append")
    n, h1, h2 = new.agg(F.count("*"), F.coalesce(F.bit_xor("_h1"), F.lit(0)), F.coalesce(F.sum(F.shiftright("_h2", 20)), F.lit(0))).first()
    if not n:
        return False
    return store.publish(spark, {table: new.drop("_h1", "_h2")}, base, f"{table}-{n}-{h1 & (1 << 64) - 1:016x}-{h2 & (1 << 64) - 1:016x}")


def read(spark: SparkSession, base: str, table: str, servers: Iterable[str] | None = None,
         since=None, until=None) -> DataFrame:
    """Published rows of a table; server and time limits prune directories before any read."""
    return Store(spark, base, servers, since, until).frame(table)


def open_snapshot(spark: SparkSession, base: str, **limits) -> Snapshot:
    """All tables under ``base``, opened when first asked for."""
    kept = Store(spark, base, **limits)
    out = Snapshot({t: (lambda t=t: kept.frame(t)) for t in tables()}, KEYS)
    out.store_ = kept
    return out


#: Tables whose collections overlap: each row counts once, however often it was collected.
SERIES = ("db_resource_stats", "resource_stats")


def newest(snap: Snapshot) -> Snapshot:
    """Each server as it was last seen: what a report over several collections reads.

    Counters grow from collection to collection, so adding them up would count twice.
    A server's newest collection is the last that has its databases or a row of the
    table, so a table that was empty then stays empty. Of the series, each row is
    taken once.
    """
    if "snapshot_ts" not in snap.keys_ or getattr(snap, "newest_", False):
        return snap

    def cut(name: str) -> DataFrame:
        df = snap[name]
        if "snapshot_ts" not in df.columns:
            return df
        if name in SERIES:
            others = [c for c in df.columns if c != "snapshot_ts"]
            return df.groupBy(*others).agg(F.min("snapshot_ts").alias("snapshot_ts")).select(*df.columns)
        kept = getattr(snap, "store_", None)
        if kept is not None:
            # the index of the store tells where the newest rows are
            return kept.frame(name, at=kept.newest(*{name, "databases"}))
        seen = df.select(*KEYS)
        if name != "databases" and "databases" in snap:
            seen = seen.union(snap["databases"].select(*KEYS))
        last = seen.groupBy("server_id").agg(F.max("snapshot_ts").alias("snapshot_ts"))
        return df.join(last, list(KEYS), "left_semi")

    out = Snapshot({name: (lambda name=name: cut(name)) for name in snap}, snap.keys_)
    out.newest_ = True
    return out


#: Tables that describe what counters count, and may be collected at other times than these.
CATALOG = ("query_text", "query_plan", "databases", "schemas", "objects", "indexes", "partitions",
           "allocation_units", "data_spaces", "types")


def as_of(snap: Snapshot, tables: Iterable[str] = CATALOG, since: str = "valid_since") -> Snapshot:
    """A snapshot whose catalogs were collected at times of their own.

    Of these tables a report sees, for each row that it looks up, the newest of the same key
    on the same server at the moment the row was collected or before.
    """
    def own_time(name: str) -> DataFrame:
        df = snap[name]
        return df.withColumnRenamed("snapshot_ts", since) if "snapshot_ts" in df.columns else df

    mine = set(tables)
    return Snapshot({n: (lambda n=n: own_time(n) if n in mine else snap[n]) for n in snap}, snap.keys_)


def restrict(snap: Snapshot, keys: DataFrame) -> Snapshot:
    """The rows of ``snap`` that belong to ``keys``; of a stored one, only their directories are read.

    The index is asked once for all tables, when the first of them is.
    """
    names = list(snap.keys_)
    kept = getattr(snap, "store_", None)
    if kept is not None:
        keys = keys.select(*KEYS).distinct()
        places = cache(lambda: kept.places(*snap, at=keys))
        return Snapshot({t: (lambda t=t: kept.frame(t, at=keys, places=places()[t])) for t in snap}, names)
    return Snapshot({t: (lambda t=t: snap[t].join(keys, names, "left_semi")) for t in snap}, names)


def latest(df: DataFrame) -> DataFrame:
    """Rows of each server's newest snapshot."""
    newest = df.groupBy("server_id").agg(F.max("snapshot_ts").alias("snapshot_ts"))
    return df.join(newest, list(KEYS), "left_semi")
