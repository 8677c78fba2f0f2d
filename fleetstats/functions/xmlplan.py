"""Values out of XML query plans, safe against text that is not well formed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .numbers import _c

#: Between the values of several paths: no character, so that no document can hold it.
_APART = "\uffff"
_BETWEEN = f", '{_APART}', "


def is_well_formed(xml) -> Column:
    """True for text that parses as XML. The permissive reader puts what it cannot
    parse into the corrupt-record field; the xpath functions would raise."""
    xml = _c(xml)
    probe = F.from_xml(
        xml, "bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}
    )
    return F.when(xml.isNull() | (F.trim(xml) == ""), False).otherwise(probe["bad"].isNull())


def plan_exists(xml, path: str) -> Column:
    """Does any node match? False for malformed text."""
    return F.when(is_well_formed(xml), F.xpath_boolean(_c(xml), F.lit(path))).otherwise(False)


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over as many tasks as a shuffle has.

    A table of documents is small beside the work of parsing it, so it is read by few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def plan_values(df: DataFrame, xml: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """Add one typed column per path: the first match, NULL without one.

    ``paths`` maps a column name to (xpath, Spark type). A document is searched once for all.
    """
    flag, texts, found = "_well_formed", "_texts", [path for path, _ in paths.values()]
    if not found:
        return df
    every = found[0] if len(found) == 1 else f"concat({_BETWEEN.join(found)})"
    out = df.withColumn(flag, is_well_formed(xml)).withColumn(
        texts, F.when(F.col(flag), F.split(F.xpath_string(F.col(xml), F.lit(every)), _APART)))
    for n, (name, (_, kind)) in enumerate(paths.items()):
        out = out.withColumn(name, F.nullif(F.get(F.col(texts), F.lit(n)), F.lit("")).try_cast(kind))
    return out.drop(flag, texts)


# Where a plan document keeps its missing-index hints.
_PLAN = (
    "BatchSequence struct<Batch: array<struct<Statements: array<struct<StmtSimple: array<struct<QueryPlan: array<struct<"
    "MissingIndexes: array<struct<MissingIndexGroup: array<struct<_Impact: string, "
    "MissingIndex: array<struct<_Database: string, _Table: string>>>>>>>>>>>>>>>, bad string"
)
_WAY = ("Statements", "StmtSimple", "QueryPlan", "MissingIndexes", "MissingIndexGroup")


def _all_of(items: Column, name: str) -> Column:
    """The arrays of a field as one array, in document order."""
    return F.flatten(F.filter(items[name], lambda x: x.isNotNull()))


def index_hints(xml) -> Column:
    """The missing-index hints of a plan document, as an array of (impact, database, table).

    The document is parsed once, into a declared structure; prefixes and namespaces of its
    elements do not matter. NULL for text that is not well formed; empty without hints. A group
    without an index gives one hint that has its impact only.
    """
    xml = _c(xml)
    parsed = F.from_xml(xml, _PLAN, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad", "ignoreNamespace": "true"})

    def hints(plan: Column) -> Column:
        groups = plan["BatchSequence"]["Batch"]
        for name in _WAY:
            groups = _all_of(groups, name)
        none = F.array(F.struct(F.lit(None).cast("string").alias("_Database"), F.lit(None).cast("string").alias("_Table")))
        each = F.transform(groups, lambda g: F.transform(F.coalesce(g["MissingIndex"], none), lambda i: F.struct(
            g["_Impact"].try_cast("decimal(18,4)").alias("impact"), i["_Database"].alias("database"), i["_Table"].alias("table"))))
        found = F.coalesce(F.flatten(each), F.array().cast("array<struct<impact:decimal(18,4),database:string,table:string>>"))
        return F.when(plan["bad"].isNull() & (F.trim(xml) != ""), found)

    # a lambda binds the parsed document, so that it is not parsed again for every field
    return F.get(F.transform(F.array(parsed), hints), F.lit(0))
