"""Disk usage by table and by index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import bit_flags, bits_clear, idiv, parse_kb
from ..operators import lookup
from .common import only_database, report, scope_of

# Database status bits (loading, pre-recovery, recovering, not
# recovered, offline, emergency) and index status bits.
UNAVAILABLE = (32, 64, 128, 256, 512, 32768)
INDEX_STATUS = {
    "is_primary": 0x800, "clustered": 0x10, "is_unique": 0x2, "ignore_dup_key": 0x1,
    "ignore_dup_row": 0x4, "no_recompute": 0x1000000,
}
SAMPLE_DATABASES = ("northwind", "pubs")
_LAST_SYSTEM_DB = 4
_STATISTICS = "_wa_sys_%"  # an underscore stands for any character here


@report
def disk_usage_by_table(snap, *, scope=None, database_id=None) -> DataFrame:
    """Rows, data, index and total kilobytes per table, biggest first."""
    out = only_database(snap["space_used"], database_id).select(
        *snap.keys_, "table_name",
        F.col("rows_cnt").cast("long").alias("row_count"),
        parse_kb("data").alias("data_kb"),
        parse_kb("index_size").alias("index_kb"),
    ).withColumn("total_kb", F.col("data_kb") + F.col("index_kb"))
    return out.orderBy(*scope_of(snap, scope), F.desc("total_kb"), "table_name")


def _user_tables(snap, exclude_db) -> DataFrame:
    """(database_id, id, table_name, db_name) of available user databases, beside the snapshot keys."""
    keys, db = snap.keys_, "database_id"
    dbs = snap["sys_databases"].filter(
        ~F.col("name").isin(*exclude_db)
        & (F.col("dbid") > _LAST_SYSTEM_DB)
        & bits_clear("status", UNAVAILABLE)
    )
    tables = snap["sys_objects_legacy"].filter(F.col("xtype") != "S").select(
        *keys, db, "id", F.col("name").alias("table_name"))
    return lookup(tables, dbs, {db: "dbid"}, {"name": "db_name"}, keys, "inner")


def _indexes(snap) -> DataFrame:
    """Indexes, statistics left out."""
    return snap["sys_indexes"].filter(~F.col("name").like(_STATISTICS))


def _user_indexes(snap, exclude_db) -> DataFrame:
    """Indexes of available user databases, statistics left out, with db_name and table_name."""
    return lookup(_indexes(snap), _user_tables(snap, exclude_db), {"database_id": "database_id", "id": "id"},
                  {"db_name": "db_name", "table_name": "table_name"}, snap.keys_, "inner")


def index_columns(snap, *, exclude_db=SAMPLE_DATABASES) -> DataFrame:
    """The key columns of every index in their order, with type and properties."""
    keys, db = snap.keys_, "database_id"
    column = {"name": "column_name", "xtype": "_xtype", "xprec": "precision", "xscale": "scale",
              "iscomputed": "is_computed", "isnullable": "is_nullable", "collation": "collation"}
    parts = lookup(snap["sys_index_keys"], snap["sys_columns"],
                   {db: db, "id": "id", "colid": "colid"}, column, keys, "inner")
    parts = lookup(parts, snap["sys_types"], {db: db, "_xtype": "xtype"}, {"name": "data_type"},
                   keys, "inner")
    about = ["db_name", "table_name", "name"]
    out = lookup(parts, _user_indexes(snap, exclude_db), {db: db, "id": "id", "indid": "indid"},
                 {c: c for c in about}, keys, "inner")
    return out.select(
        *keys, "db_name", "table_name", F.col("name").alias("index_name"), "indid",
        F.col("keyno").alias("key_number"), "column_name", "data_type", "precision", "scale",
        "is_computed", "is_nullable", "collation",
    ).orderBy(*keys, "db_name", "table_name", "indid", "key_number", "column_name", "data_type")


def index_details(snap, *, exclude_db=SAMPLE_DATABASES) -> DataFrame:
    """Indexes that have key columns, of available user databases, with their
    status flags, estimated rows and pages in kilobytes.

    The key, column and type tables only decide whether an index is listed: what they say of
    a table is one row for it, so all joins but the two on databases are on the same key, by which each
    input is shuffled once. The sets in such a row are as long as a table has columns and key columns.
    """
    keys, db = snap.keys_, "database_id"
    table = {db: db, "id": "id"}
    columns = lookup(
        snap["sys_columns"], snap["sys_types"], {db: db, "xtype": "xtype"}, {}, keys, "left_semi"
    ).groupBy(*keys, db, "id").agg(F.collect_set("colid").alias("_columns"))
    parts = snap["sys_index_keys"].groupBy(*keys, db, "id").agg(
        F.collect_set(F.struct("indid", "colid")).alias("_parts"))
    keyed = lookup(parts, columns, table, {"_columns": "_columns"}, keys, "inner")
    there = F.filter("_parts", lambda k: F.array_contains("_columns", k["colid"]))
    keyed = keyed.select(*keys, db, "id", F.transform(there, lambda k: k["indid"]).alias("_keyed"))
    tables = lookup(_user_tables(snap, exclude_db), keyed, table, {"_keyed": "_keyed"}, keys, "inner")
    out = lookup(_indexes(snap), tables, table, {c: c for c in ("db_name", "table_name", "_keyed")}, keys, "inner")
    out = out.filter(F.array_contains("_keyed", F.col("indid")))
    return out.select(
        *keys, "db_name", "table_name", F.col("name").alias("index_name"), "indid",
        *bit_flags("status", INDEX_STATUS),
        F.col("origfillfactor").alias("fill_factor"),
        F.col("rowcnt").alias("est_row_count"),
        (F.col("reserved") * 8).alias("reserved_kb"),
        (F.col("used") * 8).alias("used_kb"),
    )


@report
def disk_usage_by_index(snap, *, scope=None, exclude_db=SAMPLE_DATABASES) -> DataFrame:
    """Reserved megabytes per index, biggest first."""
    out = (
        index_details(snap, exclude_db=exclude_db)
        .withColumn("reserved_mb", idiv("reserved_kb", 1024))
        .select(*snap.keys_, "db_name", "table_name", "index_name", "clustered", "est_row_count",
                "reserved_mb")
        .distinct()
    )
    return out.orderBy(*scope_of(snap, scope), F.desc("reserved_mb"), "db_name", "table_name",
                       "index_name")
