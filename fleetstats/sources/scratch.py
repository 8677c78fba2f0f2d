"""Intermediate tables in the folder all executors share.

An iterative job, or one that must read a non-repeatable step twice, writes it
here and reads it back: the lineage ends at files that outlive any executor.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

_SETTING = "spark.checkpoint.dir"
#: Steps of one call that run at the same time.
_AT_ONCE = 4


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new path under the session's checkpoint folder.

    The setting is demanded: a machine's own temporary folder would be lost with the
    machine, and the other machines would not see it.
    """
    root = spark.conf.get(_SETTING, None)
    if not root:
        raise RuntimeError(f"set {_SETTING} to a folder that the cluster shares")
    app = spark.sparkContext.applicationId
    return f"{root.rstrip('/')}/fleetstats/{app}/{purpose}-{uuid.uuid4().hex}"


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once and return a scan of what was written."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, *steps: Callable) -> list:
    """What ``steps`` return, in their order; they run a few at a time, each in a thread of its own.

    For steps that need nothing of each other: the many small jobs of one leave cores idle
    that another can use. The first step that fails is raised once all have ended.
    """
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(min(_AT_ONCE, max(len(steps), 1))) as pool:
        return [f.result() for f in [pool.submit(inherit(step)) for step in steps]]
