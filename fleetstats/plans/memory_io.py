"""File latency and what the buffer pool holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import band, idiv
from ..operators import lookup, top_n
from .common import database_name, only_database, pick, report, scope_of

_RATINGS = ["Good", "Acceptable", "Unacceptable"]
# Rating limits in milliseconds, each edge belonging to the worse side.
DATA_EDGES = (10, 20)
LOG_EDGES = (5, 15)
_LOG_FILE = 2
_RESOURCE_DB = 32767
_PAGE_BYTES, _MB = 8192, 1024 * 1024


@report
def file_latency(snap, *, scope=None) -> DataFrame:
    """Average read and write time of each file that saw both, and a rating.
    Averages are truncated before they are rated."""
    files = snap["file_io_stats"].filter(
        (F.col("num_of_reads") > 0) & (F.col("num_of_writes") > 0)
    )
    is_log = F.col("file_id") == _LOG_FILE

    def rating(ms):
        return F.when(is_log, band(ms, LOG_EDGES, _RATINGS)).otherwise(
            band(ms, DATA_EDGES, _RATINGS)
        )

    rated = (
        files.withColumn("file_type", F.when(is_log, "Log").otherwise("Data"))
        .withColumn("size_on_disk_mb", idiv("size_on_disk_bytes", 1024) / F.lit(1024.0))
        .withColumn("avg_read_ms", idiv("io_stall_read_ms", "num_of_reads"))
        .withColumn("read_rating", rating("avg_read_ms"))
        .withColumn("avg_write_ms", idiv("io_stall_write_ms", "num_of_writes"))
        .withColumn("write_rating", rating("avg_write_ms"))
    )
    return pick(
        database_name(rated, snap), snap, "database_name", "file_type", "size_on_disk_mb",
        "avg_read_ms", "read_rating", "avg_write_ms", "write_rating",
    )


@report
def buffer_by_object(snap, *, scope=None, database_id=None, n: int = 100) -> DataFrame:
    """Cached pages and megabytes per object and index, the first ``n`` of each
    database. Pages are counted per allocation unit before any join."""
    scope = scope_of(snap, scope)
    keys = snap.keys_
    counted = (
        only_database(snap["buffer_pages"], database_id)
        .groupBy(*keys, "database_id", "allocation_unit_id")
        .agg(F.count(F.lit(1)).alias("_pages"))
    )
    units = snap["allocation_units"].filter(F.col("type").isin(1, 2, 3))
    placed = lookup(
        counted, units, {c: c for c in ("database_id", "allocation_unit_id")},
        {"container_id": "_container"}, keys, "inner",
    )
    owned = lookup(
        placed, snap["partitions"], {"database_id": "database_id", "_container": "hobt_id"},
        {"object_id": "object_id", "index_id": "index_id"}, keys, "inner",
    )
    per_index = owned.groupBy(*keys, "database_id", "object_id", "index_id").agg(
        F.sum("_pages").alias("_pages")
    )
    named = lookup(
        per_index, snap["objects"], {c: c for c in ("database_id", "object_id")},
        {"name": "object_name"}, keys,
    )
    named = lookup(
        named, snap["indexes"], {c: c for c in ("database_id", "object_id", "index_id")},
        {"name": "index_name", "type_desc": "type_desc"}, keys,
    )
    # Objects of one name (in several schemas) share a row, as do their indexes.
    group = ["object_name", "index_id", "index_name", "type_desc"]
    sums = named.groupBy(*scope, "database_id", *group).agg(
        F.sum("_pages").alias("buffered_page_count")
    )
    order = [F.desc("buffered_page_count"), *group]
    top = top_n(sums, order, n, [*scope, "database_id"]).withColumn(
        "buffer_mb", idiv(F.col("buffered_page_count") * _PAGE_BYTES, _MB)
    ).orderBy(*scope, "database_id", *order)
    return pick(top, scope, "database_id", "object_name", "index_name", "type_desc",
                "buffered_page_count", "buffer_mb")


@report
def buffer_by_database(snap, *, scope=None) -> DataFrame:
    """Cached pages and megabytes per database. Names are cut to 20."""
    scope = scope_of(snap, scope)
    counted = snap["buffer_pages"].groupBy(*snap.keys_, "database_id").agg(
        F.count(F.lit(1)).alias("_pages")
    )
    label = F.when(F.col("database_id") == _RESOURCE_DB, "ResourceDb").otherwise(
        F.col("database_name")
    )
    sums = (
        database_name(counted, snap)
        .withColumn("database_name", F.left(label, F.lit(20)))
        .groupBy(*scope, "database_id", "database_name")
        .agg(F.sum("_pages").alias("buffered_page_count"))
        .withColumn("buffer_pool_mb", idiv(F.col("buffered_page_count") * _PAGE_BYTES, _MB))
        .orderBy(*scope, F.desc("buffered_page_count"))
    )
    return pick(sums, scope, "database_name", "buffered_page_count", "buffer_pool_mb")
