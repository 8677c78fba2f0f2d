"""Registered queries: each a function of (spark, sf_dir), most with an oracle.

The oracle is the same question in SQL over the same tables. Decimals are handed
out as doubles and flags as 0/1, so that values compare across engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from .views import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals to double, booleans to 0/1, small integers to BIGINT."""
    def column(f):
        if isinstance(f.dataType, T.DecimalType):
            return F.col(f.name).cast("double").alias(f.name)
        if isinstance(f.dataType, (T.BooleanType, T.ShortType, T.IntegerType)):
            return F.col(f.name).cast("long").alias(f.name)
        return F.col(f.name)

    return df.select(*[column(f) for f in df.schema])


def query(sql: str | None = None, views=(), name: str | None = None):
    """Register a query under its function's name."""
    def wrap(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
        if sql is not None:
            head = with_views(*views) + "\n" if views else ""
            body = sql.strip()
            if views and body.startswith(","):
                ORACLES[key] = head.rstrip() + body
            else:
                ORACLES[key] = head + body
        return fn

    return wrap
