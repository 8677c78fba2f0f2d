"""What the reports have in common.

A report takes a ``Snapshot`` and returns a DataFrame. ``scope`` is the set of
columns within which it ranks and totals: by default the snapshot keys (each server
at each collection on its own), ``()`` for the fleet. A scope without the time of
the snapshot means each server as last seen. Tables are always joined on the
snapshot keys as well. ``database_id`` restricts a report to one database.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, functions as F

from ..operators.joins import lookup
from ..sources.snapshot import Snapshot, newest


def report(fn):
    """A report that reads each server's newest collection when its scope spans collections."""
    @wraps(fn)
    def run(snap, *args, scope=None, **options):
        if scope is not None and "snapshot_ts" not in scope:
            snap = newest(snap)
        return fn(snap, *args, scope=scope, **options)

    return run


def scope_of(snap: Snapshot, scope) -> list[str]:
    return list(snap.keys_ if scope is None else scope)


def database_name(df: DataFrame, snap: Snapshot, id_col: str = "database_id",
                  name: str = "database_name") -> DataFrame:
    """Add the database's name, NULL when unknown."""
    return lookup(df, snap["databases"], {id_col: "database_id"}, {"name": name}, snap.keys_)


def only_database(df: DataFrame, database_id, column: str = "database_id") -> DataFrame:
    return df if database_id is None else df.filter(F.col(column) == database_id)


def pick(df: DataFrame, snap_or_cols, *cols) -> DataFrame:
    """Key columns first, then the report's own, each named once."""
    keys = list(getattr(snap_or_cols, "keys_", snap_or_cols))
    seen, out = set(), []
    for c in [*keys, *cols]:
        if c not in seen:
            seen.add(c)
            out.append(c)
    return df.select(*out)
