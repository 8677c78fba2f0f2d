"""Indexes: missing, used, unused, fragmented, partitioned."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import index_ddl, split_object_name, usage_flag
from ..operators import lookup, top_n
from .common import database_name, only_database, pick, report, scope_of

_OBJECT = ("database_id", "object_id")
_INDEX = (*_OBJECT, "index_id")


def _same(*cols):
    return {c: c for c in cols}


def _hints(snap, database_id=None, min_impact: float | None = None) -> DataFrame:
    """Missing-index details with their counters: group, its statistics, its details."""
    stats = snap["missing_index_group_stats"]
    if min_impact is not None:
        stats = stats.filter(F.col("avg_user_impact") >= min_impact)
    stats = stats.select(
        *snap.keys_, "group_handle", "avg_user_impact", "user_seeks", "unique_compiles",
        "last_user_seek", "last_user_scan",
        F.round(
            F.col("avg_total_user_cost") * F.col("avg_user_impact")
            * (F.col("user_seeks") + F.col("user_scans")), 0,
        ).alias("total_cost"),
    )
    grouped = lookup(
        stats, snap["missing_index_groups"], {"group_handle": "index_group_handle"},
        {"index_handle": "index_handle"}, snap.keys_, "inner",
    )
    details = only_database(snap["missing_index_details"], database_id)
    return lookup(
        grouped, details, {"index_handle": "index_handle"},
        _same("database_id", "object_id", "statement", "equality_columns", "inequality_columns",
              "included_columns"),
        snap.keys_, "inner",
    ).withColumnsRenamed({
        "equality_columns": "equality_usage", "inequality_columns": "inequality_usage",
        "included_columns": "include_columns",
    })


@report
def missing_indexes(snap, *, scope=None, database_id=None, n: int | None = None,
                    order_by: str = "avg_user_impact") -> DataFrame:
    """Indexes the optimizer missed, with the statement that would create each.
    ``order_by`` may also be ``total_cost``; ``n`` keeps the first ones."""
    scope = scope_of(snap, scope)
    hints = _hints(snap, database_id)
    order = [F.desc(order_by), F.asc("group_handle"), F.asc("index_handle")]
    if n is not None:
        hints = top_n(hints, order, n, scope)
    name = split_object_name("statement")
    out = (
        hints.withColumn("database_name", name["database"])
        .withColumn("table_name", name["rest"])
        .withColumn(
            "create_index_statement",
            index_ddl("group_handle", "index_handle", "statement", "equality_usage",
                      "inequality_usage", "include_columns"),
        )
        .orderBy(*scope, *order)
    )
    return pick(
        out, snap, "total_cost", "avg_user_impact", "user_seeks", "unique_compiles",
        "last_user_seek", "last_user_scan", "database_name", "table_name", "equality_usage",
        "inequality_usage", "include_columns", "create_index_statement",
    )


def _named_objects(df: DataFrame, snap, table: str = "table_name") -> DataFrame:
    """Add the table's and schema's names, NULL when unknown."""
    named = lookup(df, snap["objects"], _same(*_OBJECT), {"name": table, "schema_id": "_schema"},
                   snap.keys_)
    return lookup(
        named, snap["schemas"], {"database_id": "database_id", "_schema": "schema_id"},
        {"name": "schema_name"}, snap.keys_,
    ).drop("_schema")


def _hints_with_rows(snap, database_id, min_impact, min_rows) -> DataFrame:
    """Hints on tables with more than ``min_rows`` rows. A table's rows are summed
    over the partitions of its heap or clustered index; no match means 0."""
    hints = _hints(snap, database_id, min_impact)
    rows = (
        only_database(snap["partition_stats"], database_id)
        .filter(F.col("index_id").isin(0, 1))
        .groupBy(*snap.keys_, *_OBJECT)
        .agg(F.sum("row_count").alias("row_count"))
    )
    sized = lookup(hints, rows, _same(*_OBJECT), {"row_count": "_rows"}, snap.keys_)
    return (
        sized.withColumn("row_count", F.coalesce("_rows", F.lit(0))).drop("_rows")
        .filter(F.col("row_count") > min_rows)
    )


@report
def missing_indexes_with_rows(snap, *, scope=None, database_id=None, min_impact: float = 90,
                              min_rows: int = 10_000, recorded_at=None) -> DataFrame:
    """Missing indexes worth having: high impact on big tables, costliest first."""
    scope = scope_of(snap, scope)
    hints = _hints_with_rows(snap, database_id, min_impact, min_rows)
    out = database_name(_named_objects(hints, snap), snap).withColumn(
        "recorded_at", _recorded_at(snap, recorded_at)
    ).orderBy(*scope, F.desc("total_cost"), "group_handle", "index_handle")
    return pick(
        out, snap, "database_id", "object_id", "total_cost", "avg_user_impact", "user_seeks",
        "unique_compiles", "row_count", "database_name", "schema_name", "table_name",
        "equality_usage", "inequality_usage", "include_columns", "last_user_seek", "recorded_at",
    )


def _recorded_at(snap, given):
    if given is not None:
        return F.lit(given).cast("timestamp")
    if "snapshot_ts" in snap.keys_:
        return F.col("snapshot_ts")
    return F.lit(None).cast("timestamp")


@report
def missing_index_count_by_db(snap, *, scope=None, min_impact: float = 90,
                              min_rows: int = 10_000) -> DataFrame:
    """Number of such indexes per database."""
    scope = scope_of(snap, scope)
    hints = _hints_with_rows(snap, None, min_impact, min_rows)
    counts = hints.groupBy(*snap.keys_, "database_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        database_name(counts, snap).groupBy(*scope, "database_name")
        .agg(F.sum("_n").alias("missing_index_count"))
        .orderBy(*scope, F.desc("missing_index_count"), "database_name")
    )


@report
def missing_index_count(snap, *, scope=None) -> DataFrame:
    """Number of missing indexes per database, unfiltered. Names are cut to 30."""
    scope = scope_of(snap, scope)
    counts = snap["missing_index_details"].groupBy(*snap.keys_, "database_id").agg(
        F.count(F.lit(1)).alias("_n")
    )
    return (
        database_name(counts, snap)
        .withColumn("database_name", F.left(F.col("database_name"), F.lit(30)))
        .groupBy(*scope, "database_name")
        .agg(F.sum("_n").alias("missing_index_count"))
        .orderBy(*scope, F.desc("missing_index_count"), "database_name")
    )


@report
def index_usage(snap, *, scope=None, database_id=None) -> DataFrame:
    """Every index of every user object with its use, 0 when it was never used."""
    objects = only_database(snap["objects"], database_id).filter(F.col("type") != "S")
    indexes = only_database(snap["indexes"], database_id).select(
        *snap.keys_, *_INDEX, F.col("name").alias("_name"), F.col("type_desc").alias("type")
    )
    named = lookup(indexes, objects, _same(*_OBJECT), {"name": "object_name"}, snap.keys_, "inner")
    counters = {"user_seeks": "seeks", "user_scans": "scans", "user_lookups": "lookups",
                "user_updates": "updates"}
    used = lookup(named, snap["index_usage"], _same(*_INDEX), counters, snap.keys_)
    out = used.orderBy(*scope_of(snap, scope), "database_id", "object_name",
                       F.asc_nulls_first("_name"), "object_id", "index_id")
    return out.select(
        *snap.keys_, "database_id", "object_name",
        F.coalesce("_name", F.lit("(heap)")).alias("index_name"), "type",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counters.values()],
    )


def _used_indexes(snap, database_id, active=None) -> DataFrame:
    """Usage rows of named indexes on user objects."""
    usage = only_database(snap["index_usage"], database_id)
    if active is not None:
        usage = usage.filter(active > 0)
    indexed = lookup(
        usage, snap["indexes"].filter(F.col("name").isNotNull()), _same(*_INDEX),
        {"name": "index_name", "type_desc": "type_desc"}, snap.keys_, "inner",
    )
    mine = snap["objects"].filter(~F.col("is_ms_shipped"))
    return lookup(indexed, mine, _same(*_OBJECT), {"name": "table_name", "schema_id": "_schema"},
                  snap.keys_, "inner")


def _retrieval():
    return F.col("user_seeks") + F.col("user_scans") + F.col("user_lookups")


def _maintenance():
    return F.col("user_updates") + F.col("system_updates")


@report
def index_used_flag(snap, *, scope=None, database_id=None, recorded_at=None) -> DataFrame:
    """Named indexes with their counters and whether any of them was read at all.
    Used ones are listed too, with ``index_is_used`` = 1."""
    used = _used_indexes(snap, database_id)
    named = lookup(
        used, snap["schemas"], {"database_id": "database_id", "_schema": "schema_id"},
        {"name": "schema_name"}, snap.keys_,
    )
    out = (
        database_name(named, snap)
        .withColumn("index_is_used", usage_flag("user_seeks", "user_scans", "user_lookups"))
        .withColumn("drop_index", F.lit(0))
        .withColumn("recorded_at", _recorded_at(snap, recorded_at))
        .orderBy(*scope_of(snap, scope), F.desc("user_updates"), *_INDEX)
    )
    return pick(
        out, snap, "database_name", "schema_name", "table_name", "index_name", "type_desc",
        "user_updates", "user_seeks", "user_scans", "user_lookups", "system_updates",
        "index_is_used", "drop_index", "recorded_at",
    )


@report
def costly_used_indexes(snap, *, scope=None, n: int = 10, database_id=None) -> DataFrame:
    """Indexes that cost most to maintain, with what they give back."""
    scope = scope_of(snap, scope)
    used = (
        _used_indexes(snap, database_id, _maintenance())
        .withColumn("maintenance_cost", _maintenance())
        .withColumn("retrieval_usage", _retrieval())
    )
    order = [F.desc("maintenance_cost"), *_INDEX]
    out = database_name(top_n(used, order, n, scope), snap).orderBy(*scope, *order)
    return pick(
        out, snap, "maintenance_cost", "retrieval_usage", "user_updates", "system_updates",
        "user_seeks", "user_scans", "user_lookups", "database_name", "table_name", "index_name",
    )


@report
def most_used_indexes(snap, *, scope=None, n: int = 10, database_id=None) -> DataFrame:
    """Indexes read most often. A first cut per database would not change the set."""
    scope = scope_of(snap, scope)
    used = _used_indexes(snap, database_id, _retrieval()).withColumn("usage", _retrieval())
    order = [F.desc("usage"), *_INDEX]
    out = database_name(top_n(used, order, n, scope), snap).orderBy(*scope, *order)
    return pick(out, snap, "usage", "database_name", "table_name", "index_name")


@report
def fragmented_indexes(snap, *, scope=None, per_db: int = 10, n: int = 100,
                       database_id=None) -> DataFrame:
    """Most fragmented indexes: the first ``per_db`` of each database, then the
    first ``n`` by database and fragmentation, usually of one ``database_id``."""
    scope = scope_of(snap, scope)
    stats = only_database(snap["index_physical_stats"], database_id).select(
        *snap.keys_, *_INDEX, "index_level",
        F.round("avg_fragmentation_in_percent", 2).alias("fragmentation_pct"),
    )
    indexed = lookup(
        stats, snap["indexes"].filter(F.col("name").isNotNull()), _same(*_INDEX),
        {"name": "index_name", **_same("fill_factor", "is_padded", "type_desc")},
        snap.keys_, "inner",
    )
    mine = lookup(
        indexed, snap["objects"].filter(~F.col("is_ms_shipped")), _same(*_OBJECT),
        {"name": "table_name"}, snap.keys_, "inner",
    )
    order = [F.desc("fragmentation_pct"), "object_id", "index_id", "index_level"]
    worst = database_name(
        top_n(mine, order, per_db, [*snap.keys_, "database_id"]), snap
    )
    out = top_n(worst, ["database_name", *order], n, scope).orderBy(
        *scope, "database_name", *order
    )
    return pick(out, snap, "database_name", "table_name", "index_name", "fill_factor",
                "is_padded", "type_desc", "fragmentation_pct")


def _of_table(snap, database_id, table: str | None) -> DataFrame:
    objects = only_database(snap["objects"], database_id)
    return objects if table is None else objects.filter(F.col("name") == table)


def index_sizes(snap, table: str | None = None, *, database_id=None) -> DataFrame:
    """Pages and rows per index and partition of one table, or of all."""
    sized = lookup(
        snap["partition_stats"], _of_table(snap, database_id, table), _same(*_OBJECT),
        {"name": "table"}, snap.keys_, "inner",
    )
    out = lookup(sized, snap["indexes"], _same(*_INDEX), {"name": "index"}, snap.keys_, "inner")
    return pick(out, snap, "table", "index_id", "index", "used_page_count", "row_count")


def index_depth(snap, table: str | None = None, index_id: int | None = None, *,
                database_id=None) -> DataFrame:
    """Depth, and pages and records per level, of one index or of all."""
    stats = snap["index_physical_stats"]
    if index_id is not None:
        stats = stats.filter(F.col("index_id") == index_id)
    mine = lookup(
        stats, _of_table(snap, database_id, table), _same(*_OBJECT), {}, snap.keys_, "left_semi"
    )
    out = lookup(mine, snap["indexes"], _same(*_INDEX), {"name": "index"}, snap.keys_, "inner")
    return pick(out, snap, "index_id", "index", "index_type_desc", "index_depth", "index_level",
                "page_count", "record_count")


@report
def partitioned_tables(snap, *, scope=None, database_id=None) -> DataFrame:
    """Every partition with its function, scheme, filegroup, boundary and size.

    The last partition has no boundary value. Several types may share a system
    type id; the smallest user type id names the type, so rows do not multiply.
    """
    keys, db = snap.keys_, "database_id"
    parts = only_database(snap["partitions"], database_id).select(
        *keys, *_INDEX, "partition_id", "partition_number", F.col("rows").alias("approx_row_count")
    )
    pages = snap["allocation_units"].groupBy(*keys, db, "container_id").agg(
        F.sum("total_pages").alias("total_pages")
    )
    types = snap["types"].groupBy(*keys, db, "system_type_id").agg(
        F.min_by("name", "user_type_id").alias("name")
    )
    steps = [
        ("indexes", _same(*_INDEX), {"data_space_id": "_space"}, "inner"),
        ("partition_schemes", {db: db, "_space": "data_space_id"},
         {"name": "ps_name", "function_id": "_function", "is_default": "is_default"}, "inner"),
        ("partition_functions", {db: db, "_function": "function_id"},
         {"name": "pf_name", "boundary_value_on_right": "_right", "fanout": "partition_count"},
         "inner"),
        ("partition_range_values",
         {db: db, "_function": "function_id", "partition_number": "boundary_id"},
         {"value": "value", "parameter_id": "parameter_id"}, "left"),
        ("destination_data_spaces",
         {db: db, "_space": "partition_scheme_id", "partition_number": "destination_id"},
         {"data_space_id": "_filegroup"}, "inner"),
        ("partition_parameters", {db: db, "_function": "function_id"},
         {"system_type_id": "_type", **_same("max_length", "precision", "scale")}, "inner"),
        (types, {db: db, "_type": "system_type_id"}, {"name": "data_type"}, "inner"),
        ("data_spaces", {db: db, "_filegroup": "data_space_id"}, {"name": "fg_name"}, "inner"),
        (pages, {db: db, "partition_id": "container_id"}, {"total_pages": "total_pages"}, "inner"),
        ("objects", _same(*_OBJECT), {"name": "table_name"}, "left"),
    ]
    out = parts
    for dim, on, take, how in steps:
        out = lookup(out, snap[dim] if isinstance(dim, str) else dim, on, take, keys, how)
    out = out.withColumn(
        "type", F.when(F.col("_right"), "Range Right").otherwise("Range Left")
    ).orderBy(*scope_of(snap, scope), "partition_number", *_INDEX)
    return pick(
        out, snap, "table_name", "pf_name", "ps_name", "fg_name", "value", "type", "data_type",
        "max_length", "precision", "scale", "is_default", "parameter_id", "partition_count",
        "index_id", "partition_number", "approx_row_count", "total_pages",
    )
