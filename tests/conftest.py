from __future__ import annotations

import datetime as dt
import tempfile

import pytest
from pyspark.sql import SparkSession

from fleetstats.sources import Snapshot, schema

TS = dt.datetime(2024, 5, 1, 12, 0, 0)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def snap(spark):
    """Build a Snapshot from rows given as dicts; absent columns are NULL."""

    def build(**tables):
        frames = {}
        for name, rows in tables.items():
            declared = schema(name)
            full = [
                tuple({"server_id": "a", "snapshot_ts": TS, **r}.get(f.name) for f in declared)
                for r in rows
            ]
            frames[name] = spark.createDataFrame(full, declared)
        return Snapshot(frames)

    return build


def rows(df, *cols):
    """Rows as tuples of the named columns, in the order of the DataFrame."""
    return [tuple(r) for r in df.select(*cols).collect()]


DATABASES = [
    {"database_id": 1, "name": "master"}, {"database_id": 2, "name": "tempdb"},
    {"database_id": 4, "name": "msdb"}, {"database_id": 5, "name": "sales"},
    {"database_id": 6, "name": "stock"},
]
