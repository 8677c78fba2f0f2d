"""Backups: the last one of each database, and where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import latest_or_label
from .common import report, scope_of

_TEMPDB = 2


@report
def last_backup(snap, *, scope=None) -> DataFrame:
    """Newest full backup of each database except tempdb, ``No Backup`` where there
    is none; newest first."""
    keys = list(snap.keys_)
    dbs = snap["databases"].filter(F.col("database_id") != _TEMPDB).select(*keys, "name")
    full = snap["backup_sets"].filter(F.col("type") == "D").select(
        *keys, F.col("database_name").alias("name"),
        F.col("backup_finish_date").alias("last_backup_finish_date"),
    )
    out = latest_or_label(dbs, full, [*keys, "name"], "last_backup_finish_date", "No Backup")
    return out.orderBy(*scope_of(snap, scope), F.desc_nulls_last("last_backup_finish_date"), "name")


@report
def backup_locations(snap, *, scope=None) -> DataFrame:
    """Devices that backups were written to."""
    return snap["backup_media"].select(*scope_of(snap, scope), "physical_device_name").distinct()
