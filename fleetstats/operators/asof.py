"""Joins and differences along time, for keys of any size.

Rows of a key are looked at in slices of time, so a key that holds a large share of all rows
is as many groups as it has slices. What a slice needs of earlier ones is one row of each,
carried over in a second step on as many rows as there are slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import settle
from .joins import join_same

#: The column that holds the time of rows which are valid from then on.
SINCE = "valid_since"
#: Seconds of a slice.
SLICE = 86_400


def _slice(time, seconds: int):
    return F.floor(F.unix_micros(time) / F.lit(seconds * 1_000_000)).cast("long")


def last_before(asked: DataFrame, there: DataFrame, by, time: str, since: str, slice_seconds: int = SLICE) -> DataFrame:
    """(*by, time, since): for each key and time in ``asked`` the newest time of the key in
    ``there``, at that moment or before. Without one, no row; NULL keys have none.
    """
    by = list(by)
    here = asked.select(*by, F.col(time).alias("_at")).dropna().distinct().withColumn("_asks", F.lit(True))
    seen = there.select(*by, F.col(since).alias("_at")).dropna().distinct()
    both = here.withColumn("_seen", F.lit(None).cast(seen.schema["_at"].dataType)).unionByName(
        seen.select(*by, "_at", F.lit(False).alias("_asks"), F.col("_at").alias("_seen"))
    ).withColumn("_slice", _slice(F.col("_at").cast("timestamp"), slice_seconds))
    # a range: rows of the same moment see each other
    within = Window.partitionBy(*by, "_slice").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_within", F.max("_seen").over(within)).filter("_asks")
    slices = both.groupBy(*by, "_slice").agg(F.max("_seen").alias("_last"), F.bool_or("_asks").alias("_asks"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("_carried", F.max("_last").over(earlier)).filter("_asks").select(*by, "_slice", "_carried")
    return (found.join(carried, [*by, "_slice"], "left")
            .withColumn(since, F.coalesce("_within", "_carried")).filter(F.col(since).isNotNull())
            .select(*by, F.col("_at").alias(time), since))


def lookup_as_of(df: DataFrame, dim: DataFrame, on: dict[str, str], take: dict[str, str], keys, time: str,
                 how: str = "left", since: str = SINCE) -> DataFrame:
    """``lookup`` of the rows of ``dim`` that were the newest of their key when a row was collected.

    ``keys`` are key columns of both sides but for ``time``, which ``dim`` has as ``since``.
    Only distinct keys and times go through the search; the join with ``df`` is by equality.
    What was found is written down, so that Spark knows its size: a small one is broadcast and
    ``df`` is not moved, beside a large one adaptive execution can split a busy key. ``df`` is
    read twice, so it is written down first: of lookups that follow each other each would
    double the work of all before it.
    """
    df = settle(df, "asked")
    keys = [k for k in keys if k != time]
    # helper names, as a column of df may be looked up under the name of one of its keys
    names = {**{k: f"_by_{k}" for k in keys}, **{c: f"_by_{n}" for n, c in enumerate(on)}}
    by = list(names.values())
    there = dim.select(
        *[F.col(k).alias(names[k]) for k in keys], *[F.col(c).alias(names[l]) for l, c in on.items()],
        F.col(since).alias("_since"), *[F.col(c).alias(f"_take_{n}") for n, c in enumerate(take)])
    asked = df.select(*[F.col(c).alias(n) for c, n in names.items()], F.col(time).alias("_asked"))
    seen = last_before(asked, there, by, "_asked", "_since")
    side = settle(seen.join(there, [*by, "_since"]).drop("_since"), "found")
    cond = F.col(time) == F.col("_asked")
    for c, n in names.items():
        cond &= F.col(c) == F.col(n)
    out = df.join(side, cond, how)
    if how in ("left_semi", "left_anti"):
        return out
    return out.drop(*by, "_asked").withColumnsRenamed({f"_take_{n}": name for n, name in enumerate(take.values())})


def deltas(df: DataFrame, by, time: str, counters, together=None, slice_seconds: int = SLICE) -> DataFrame:
    """What counters grew by between one collection of a key and the next.

    Returns (*by, since, time, seconds, restarted, *counters), one row for each collection of
    a key but its first. A counter that fell was reset in between: the key's counters then
    count from zero, and ``restarted`` is set. ``together`` names the columns of ``by`` whose
    counters are reset at once, such as a server: if one of their keys fell, all restarted.
    NULL is a key like any other; NULL counters count as zero. A row collected twice counts
    once.
    """
    by, counters = list(by), list(counters)
    rows = df.groupBy(*by, time).agg(*[F.max(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in counters])
    rows = rows.filter(F.col(time).isNotNull()).withColumn("_slice", _slice(F.col(time).cast("timestamp"), slice_seconds))
    held = F.struct(F.col(time).alias("at"), *[F.col(c) for c in counters])
    within = Window.partitionBy(*by, "_slice").orderBy(time)
    found = rows.withColumn("_within", F.lag(held).over(within))
    ends = rows.groupBy(*by, "_slice").agg(F.max(held).alias("_end"))
    ends = ends.withColumn("_carried", F.lag("_end").over(Window.partitionBy(*by).orderBy("_slice"))).drop("_end")
    found = join_same(found, ends, [*by, "_slice"]).withColumn("_was", F.coalesce("_within", "_carried"))
    found = found.filter(F.col("_was").isNotNull())
    fell = F.lit(False)
    for c in counters:
        fell |= F.col(c) < F.col(f"_was.`{c}`")
    found = found.withColumn("restarted", fell)
    if together:
        reset = found.filter("restarted").select(*together, time).distinct().withColumn("_reset", F.lit(True))
        found = join_same(found.drop("restarted"), reset, [*together, time]).withColumn(
            "restarted", F.coalesce("_reset", F.lit(False)))
    seconds = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("_was.at").cast("timestamp"))) / F.lit(1e6)
    return found.select(
        *by, F.col("_was.at").alias("since"), time, seconds.alias("seconds"), "restarted",
        *[(F.col(c) - F.when(F.col("restarted"), F.lit(0)).otherwise(F.col(f"_was.`{c}`"))).alias(c) for c in counters])
