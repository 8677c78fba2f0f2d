"""Expressions over statement text, dotted object names and text sizes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import _c, idiv


_BEYOND = r"([\x{10000}-\x{10FFFF}])"
_SECOND_UNIT = "\uffff"  # no character


def _units(text: Column) -> Column:
    """The text with a mark after each character that takes two units, so that characters count units."""
    return F.when(text.rlike(_BEYOND), F.regexp_replace(text, _BEYOND, f"$1{_SECOND_UNIT}")).otherwise(text)


def text_bytes(text) -> Column:
    """Size of the text in two-byte units times two."""
    return F.length(_units(_c(text))) * 2


def statement_text(text, start, end, *, zero_end_is_open: bool = False) -> Column:
    """The statement that byte offsets ``start``..``end`` cut out of a batch.

    Offsets count bytes of two-byte text and include the last character; -1 means
    "to the end", and so does 0 when ``zero_end_is_open``. Characters outside the
    basic plane take two units, as in the offsets; one that is cut in two stays whole
    at the end and goes at the start.
    """
    text, start, end = _c(text), _c(start), _c(end)
    is_open = end == -1
    if zero_end_is_open:
        is_open = end.isNull() | end.isin(-1, 0)
        start = F.coalesce(start, F.lit(0))
    stop = F.when(is_open, text_bytes(text)).otherwise(end)
    cut = F.substring(_units(text), idiv(start, 2) + 1, idiv(stop - start, 2) + 1)
    return F.replace(cut, F.lit(_SECOND_UNIT), F.lit(""))


def split_object_name(col) -> dict[str, Column]:
    """Parts of ``[db].[schema].[table]``: before and after the first dot, and the
    last part without its brackets."""
    col = _c(col)
    dot = F.locate(".", col)
    last = F.regexp_extract(col, r"(?:\[((?:[^\]]|\]\])*)\]|([^.\[\]]+))\s*$", 1)
    plain = F.regexp_extract(col, r"([^.\[\]]+)\s*$", 1)
    return {
        "database": F.when(dot > 0, F.substring(col, F.lit(1), dot - 1)),
        "rest": F.substring(col, dot + 1, F.length(col)),
        "last": F.when(last != "", F.replace(last, F.lit("]]"), F.lit("]"))).otherwise(plain),
    }


def parse_kb(col) -> Column:
    """Leading number of a size such as ``123 KB``; a table may have terabytes."""
    return F.substring_index(_c(col), " ", 1).cast("long")


def index_ddl(group_handle, index_handle, statement, equality, inequality, included) -> Column:
    """Text of the CREATE INDEX statement a missing-index hint asks for."""
    equality, inequality, included = _c(equality), _c(inequality), _c(included)
    both = equality.isNotNull() & inequality.isNotNull()
    return F.concat(
        F.lit("CREATE INDEX [missing_index_"),
        _c(group_handle).cast("string"),
        F.lit("_"),
        _c(index_handle).cast("string"),
        F.lit("_"),
        F.left(split_object_name(statement)["last"], F.lit(32)),
        F.lit("] ON "),
        _c(statement),
        F.lit(" ("),
        F.coalesce(equality, F.lit("")),
        F.when(both, ",").otherwise(""),
        F.coalesce(inequality, F.lit("")),
        F.lit(")"),
        F.coalesce(F.concat(F.lit(" INCLUDE ("), included, F.lit(")")), F.lit("")),
    )


def account(domain, name) -> Column:
    """``domain\\name``, NULL if either part is."""
    return F.concat(_c(domain), F.lit("\\"), _c(name))


def temp_table_name(name) -> Column:
    """Display form of a temporary table's catalog name, NULL for other names.

    A hash sign and eight hex digits is a table variable or a dropped table; a
    128-character name carries padding after the part its owner wrote.
    """
    name = _c(name)
    return F.when(
        name.rlike("^#[0-9A-F]{8}$"), F.lit("#(tblvar or dropped temp table)")
    ).when(
        (F.length(name) == 128) & name.rlike("^#[^#]"), F.substring_index(name, "_____", 1)
    )
