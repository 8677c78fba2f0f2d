"""Files as collectors send them: columns that drift are mapped to the declared schema, and nothing is lost silently."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from . import store
from .schemas import KEYS, schema


class Landed(NamedTuple):
    """``rows`` fit the declared schema; ``rejects`` (reasons, row) could not be read as it says;
    ``extras`` (server_id, snapshot_ts, row) are values of columns that it does not have."""

    rows: DataFrame
    rejects: DataFrame
    extras: DataFrame


def _as_json(df: DataFrame, columns):
    return F.to_json(F.struct(*[df[f"`{c}`"] for c in columns]) if columns else F.struct(F.lit(None).alias("none")))


def land(df: DataFrame, table: str, names: Mapping[str, str] | None = None) -> Landed:
    """Fit ``df`` to the declared schema of a table.

    Columns are found by name, whatever the case, or by ``names`` (theirs to declared). A
    missing column is NULL. A value that cannot be read as the declared type, a missing key,
    or two columns of one name that disagree, make a row a reject with its reasons; the whole
    row is kept as JSON. Columns that nothing declares are kept beside, where they have a value.
    """
    declared = schema(table)
    theirs: dict[str, list[str]] = {}
    known = {f.name.lower(): f.name for f in declared}
    given = {k.lower(): v for k, v in (names or {}).items()}
    for c in df.columns:
        name = given.get(c.strip().lower()) or known.get(c.strip().lower())
        theirs.setdefault(name or "", []).append(c)
    extra = theirs.pop("", [])
    picked, reasons = [], []
    for f in declared:
        sources = [df[f"`{c}`"] for c in theirs.get(f.name, [])]
        value = F.coalesce(*sources) if sources else F.lit(None)
        read = value.try_cast(f.dataType) if not isinstance(f.dataType, T.StringType) else value.cast("string")
        picked.append(read.alias(f.name))
        wrong = [value.isNotNull() & read.isNull()] + [s.isNotNull() & (s.cast("string") != value.cast("string")) for s in sources[1:]]
        wrong += [read.isNull()] if f.name in KEYS else []
        reasons += [F.when(w, F.lit(f.name)) for w in wrong]
    marked = df.select(
        F.struct(*picked).alias("_read"), F.array_compact(F.array(*reasons)).alias("_reasons"), _as_json(df, df.columns).alias("_row"),
        _as_json(df, extra).alias("_extra"), F.coalesce(*[df[f"`{c}`"].cast("string") for c in extra], F.lit(None)).isNotNull().alias("_has"))
    fits = F.size("_reasons") == 0
    return Landed(
        marked.filter(fits).select("_read.*"),
        marked.filter(~fits).select(F.array_distinct("_reasons").alias("reasons"), F.col("_row").alias("row")),
        marked.filter(fits & F.col("_has")).select(*[F.col(f"_read.{k}") for k in KEYS], F.col("_extra").alias("row")))


def publish_landed(spark: SparkSession, landed: Mapping[str, Landed], base: str, collection_id: str) -> bool:
    """Publish a collection; its rejects and extras are written first, under ``<base>/aside/<collection>``."""
    if store.exists(spark, store._published(base, collection_id)):
        return False
    for table, parts in landed.items():
        for name in ("rejects", "extras"):
            getattr(parts, name).write.mode("overwrite").parquet(f"{base}/aside/{collection_id}/{table}/{name}")
    return store.publish(spark, {t: parts.rows for t, parts in landed.items()}, base, collection_id)
