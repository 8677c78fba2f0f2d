"""What several operators share: words, row batches, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from fleetstats.sources.scratch import scratch_dir

__all__ = ["SPACES", "LAST", "ROWS", "words", "lines", "table", "mapped", "text_function", "settle", "release", "packed", "unpacked", "whole_number",
           "components"]

#: Rows that a task turns into Python objects at once.
ROWS = 256
#: Stands for a null document id where ids are compared: it comes last.
LAST = (1 << 63) - 1

#: The characters between words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
_SPLIT = "[ \\t\\n\\x0B\\f\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Maximal runs of characters other than SPACES; null and empty texts have none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPLIT))


def lines(text: Column) -> Column:
    """The parts between line feeds; a null text has none."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the folder all executors share, and return a scan of it."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Remove settled tables that nothing reads any more: what was made of them is settled itself.

    Spark removes the shuffles of queries that are done when the driver collects their garbage,
    which a small driver heap may put off for long, so that is asked for here.
    """
    for df in frames:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    for spark in {df.sparkSession for df in frames}:
        spark._jvm.java.lang.System.gc()


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """``df`` as one column ``_row``, beside ``keys``: no name of ``df`` can clash with a key."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"),
                     *[v.alias(k) for k, v in keys.items()])


def unpacked(df: DataFrame, like: DataFrame, **changed: Column) -> DataFrame:
    """The columns that ``like`` had before ``packed``, some of them changed, others added."""
    rest = {k: v for k, v in changed.items() if k not in like.columns}
    return df.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in like.columns],
                     *[v.alias(k) for k, v in rest.items()])


def whole_number(id_: Column) -> Column:
    """An id as a number to compare; LAST for null and for what is no number."""
    return F.coalesce(id_.try_cast("long"), F.lit(LAST))


def mapped(df: DataFrame, schema: str, fn: Callable[[dict], Iterator[dict] | dict]) -> DataFrame:
    """Apply ``fn`` to parts of Arrow batches given as lists by column; it returns lists by column."""
    fields = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema)]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                out = fn(batch.slice(at, ROWS).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in fields], names=[n for n, _ in fields])

    return df.mapInArrow(run, schema)


def text_function(fn: Callable[[str | None], object], kind: str):
    """``fn`` of a text as a function of columns; a task turns few texts at once into Python objects."""
    of = to_arrow_type(StructType.fromDDL(f"x {kind}")[0].dataType)

    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array([fn(t) for t in texts.slice(at, ROWS).to_pylist()], of) for at in range(0, len(texts), ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], of)

    return arrow_udf(run, kind).asNondeterministic()


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b): the smallest node it is connected with.

    Rounds of the alternating large-star and small-star steps, each a shuffle over the
    edges. The number of rounds is logarithmic, every round's edges are a table in the
    shared folder, and no node gathers its neighbours: minima come from aggregation.
    Null ends and self loops of known nodes are allowed; null ends are ignored.
    """
    edges = edges.where("a is not null and b is not null")
    loops = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now = settle(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(), purpose)
    before = None
    while True:
        both = now.union(now.select("b", "a"))
        # minima are written down, so that the joins shuffle both sides and can split a large component
        low = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m")), purpose)
        # large star: larger neighbours go to the smallest node around
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        large = settle(large, purpose)
        # small star: a node and its smaller neighbours go to the smallest of them
        least = settle(large.groupBy("a").agg(F.min("b").alias("m")), purpose)
        small = (large.join(least, "a")
                 .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                           F.struct("a", F.col("m").alias("b")))).alias("e"))
                 .select("e.*").where("a <> b").distinct())
        done, now = now, settle(small, purpose)
        release(done, low, large, least)
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == before:
            break
        before = state
    found = now.groupBy("a").agg(F.min("b").alias("component"))
    return loops.join(found, loops.node == found.a, "left").select(
        "node", F.coalesce("component", "node").alias("component"))
