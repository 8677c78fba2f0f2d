"""Integer, ratio and flag expressions shared by the reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def idiv(a, b) -> Column:
    """Integer quotient truncated towards zero; ``b`` must not be 0."""
    divisor = b if isinstance(b, (str, Column)) else F.lit(b)
    return F.call_function("div", _c(a), _c(divisor))


def int_avg(total, count) -> Column:
    """Truncated average, NULL when ``count`` is 0."""
    return F.when(_c(count) != 0, idiv(total, count))


def percent(part, whole) -> Column:
    """``100 * part / whole`` as a double, NULL when ``whole`` is 0."""
    return F.try_divide(_c(part).cast("double") * 100.0, _c(whole).cast("double"))


def dec2(value, digits: int = 12) -> Column:
    """Two-decimal presentation of a number of up to ``digits`` digits, rounded half up."""
    return _c(value).cast(f"decimal({digits},2)")


def usage_flag(*cols) -> Column:
    """1 if any counter is above zero, else 0; a NULL counter counts as zero."""
    used = reduce(lambda a, b: a | b, [F.coalesce(_c(c) > 0, F.lit(False)) for c in cols])
    return F.when(used, 1).otherwise(0)


def row_max(*cols) -> Column:
    """Largest of the columns in a row; NULLs are skipped."""
    return F.greatest(*[_c(c) for c in cols])


def band(value, edges, labels) -> Column:
    """Label of the first edge that ``value`` lies strictly under.

    ``labels`` has one entry more than ``edges``; the last one is for values at
    or over every edge, and for NULL.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("band needs one label more than edges")
    out = F
    for edge, label in zip(edges, labels):
        out = out.when(_c(value) < edge, label)
    return out.otherwise(labels[-1]) if edges else F.lit(labels[0])


def bit_flags(col, masks: dict[str, int]) -> list[Column]:
    """One 0/1 column per named mask."""
    return [
        F.when(_c(col).bitwiseAND(F.lit(mask)) == 0, 0).otherwise(1).alias(name)
        for name, mask in masks.items()
    ]


def bits_clear(col, masks) -> Column:
    """True when none of the masks is set in ``col``."""
    return _c(col).bitwiseAND(F.lit(reduce(lambda a, b: a | b, masks))) == 0
