"""Time and date dimensions of a warehouse."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_SECONDS_PER_DAY = 24 * 60 * 60


def time_of_day_dim(spark: SparkSession) -> DataFrame:
    """One row per second of the day: ``id`` and ``time`` as HH:mm:ss."""
    clock = F.concat_ws(
        ":",
        *[F.lpad(part.cast("string"), 2, "0") for part in (
            F.floor(F.col("id") / 3600), F.floor(F.col("id") % 3600 / 60), F.col("id") % 60,
        )],
    )
    return spark.range(_SECONDS_PER_DAY).select(F.col("id").cast("int").alias("id"),
                                                clock.alias("time"))


def date_dim(spark: SparkSession, epoch: str = "2015-01-01", years: int = 50) -> DataFrame:
    """One row per day from ``epoch``, ``years`` later excluded: ``id`` and ``date``."""
    start = date.fromisoformat(epoch)
    try:
        stop = start.replace(year=start.year + years)
    except ValueError:  # 29 February in a year without one
        stop = start.replace(year=start.year + years, day=28)
    days = (stop - start).days
    if days > 32_768:
        raise ValueError("the day number would not fit a SMALLINT")
    return spark.range(days).select(
        F.col("id").cast("smallint").alias("id"),
        F.date_add(F.lit(start), F.col("id").cast("int")).alias("date"),
    )


def time_of_day_id(ts) -> Column:
    """Key into ``time_of_day_dim``."""
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def date_id(ts, epoch: str = "2015-01-01") -> Column:
    """Key into ``date_dim``."""
    return F.datediff(ts, F.lit(date.fromisoformat(epoch)))


def write_dimensions(spark: SparkSession, base: str, epoch: str = "2015-01-01",
                     years: int = 50) -> None:
    """Create both dimension tables under ``base``."""
    time_of_day_dim(spark).coalesce(1).write.mode("overwrite").parquet(f"{base}/dim_time_of_day")
    date_dim(spark, epoch, years).coalesce(1).write.mode("overwrite").parquet(f"{base}/dim_date")
