"""Resource percentages over rolling windows.

Both functions take a stream or a batch DataFrame. State per server and window is
a few counters, and one key for each row within the watermark; it lets them go once a
window can get no more rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import row_max
from ..operators import fit_ratio
from ..plans.resource import FIT_COLUMNS


def _timed(df: DataFrame, late: str) -> DataFrame:
    """Each row of the series once: collections overlap, and repeat rows with another time of collection."""
    # A watermark needs a TIMESTAMP; files often hold TIMESTAMP_NTZ.
    timed = df.withColumn("end_time", F.col("end_time").cast("timestamp")).withWatermark(
        "end_time", late
    )
    same = [c for c in df.columns if c != "snapshot_ts"]
    # repeats that come after the watermark has passed their rows are late, and dropped as such
    return timed.dropDuplicatesWithinWatermark(same) if df.isStreaming else timed.dropDuplicates(same)


def _flat(df: DataFrame, scope, cols) -> DataFrame:
    return df.select(
        *scope, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        *cols,
    )


def resource_fit_stream(df: DataFrame, *, limit: float = 80, window: str = "60 minutes",
                        slide: str = "15 minutes", late: str = "15 minutes",
                        scope=("server_id",)) -> DataFrame:
    """The fit fractions of every sliding window."""
    windowed = _timed(df, late).withColumn("window", F.window("end_time", window, slide))
    fit = fit_ratio(windowed, FIT_COLUMNS, limit, [*scope, "window"])
    return _flat(fit, scope, FIT_COLUMNS.values())


def dtu_stream(df: DataFrame, *, window: str = "5 minutes", late: str = "15 minutes",
               scope=("server_id",)) -> DataFrame:
    """The highest of the three percentages in every tumbling window."""
    peak = row_max("avg_cpu_percent", "avg_data_io_percent", "avg_log_write_percent")
    grouped = _timed(df, late).groupBy(*scope, F.window("end_time", window)).agg(
        F.max(peak).alias("avg_dtu_percent")
    )
    return _flat(grouped, scope, ["avg_dtu_percent"])
