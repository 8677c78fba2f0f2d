"""Aggregates with conditions. All of them combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import int_avg, percent


def fit_ratio(df: DataFrame, cols: dict[str, str], limit: float = 80, scope=()) -> DataFrame:
    """Share, from 0 to 1, of the rows whose value is not above ``limit``.

    ``cols`` maps a column to the name of its ratio. NULL counts as fitting; no
    rows at all give NULL.
    """
    n = F.count(F.lit(1))
    ratios = [
        F.try_divide(
            (n - F.coalesce(F.count_if(F.col(c) > limit), F.lit(0))).cast("double"),
            n.cast("double"),
        ).alias(name)
        for c, name in cols.items()
    ]
    return df.groupBy(*scope).agg(*ratios)


def conditional_rollup(df: DataFrame, keys, amount: str, uses: str, condition: Column) -> DataFrame:
    """Per key: rows, amount, average uses (truncated), and the part of rows and
    amount for which ``condition`` holds, also as percent of the amount."""
    hit = F.when(condition, F.col(amount)).otherwise(0)
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(amount).alias("amount"),
        int_avg(F.sum(uses), F.count(uses)).alias("avg_uses"),
        F.sum(hit).alias("amount_if"),
        F.count_if(condition).alias("n_if"),
    )
    return sums.withColumn("pct_if", percent("amount_if", "amount"))


def latest_or_label(left: DataFrame, right: DataFrame, key, ts: str, label: str,
                    name: str = "label") -> DataFrame:
    """For each key of ``left`` the newest ``ts`` of ``right``, and ``label`` where
    there is none. The right side is reduced to one row per key before the join."""
    key = list(key)
    newest = right.groupBy(*key).agg(F.max(ts).alias(ts))
    return (
        left.select(*key).distinct().join(newest, key, "left")
        .withColumn(name, F.when(F.col(ts).isNull(), F.lit(label)))
    )
