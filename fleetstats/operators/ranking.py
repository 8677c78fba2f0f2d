"""Pareto cutoff, shares, top-n, paging and first rows, built so that no single
scope value has to fit into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions.numbers import percent
from ..sources.scratch import settle
from .joins import join_same

#: Rows up to which a scope is numbered in one task. Larger ones are cut into slices.
_WHOLE = 100_000
#: Parts into which a round of ``leading`` cuts the values still in question.
_PARTS = 4096
#: Numbers beyond this lie together; infinities, NaN and nulls have a place of their own behind.
_FAR = 4e307
_INFINITE, _NAN, _NULL = 1.25 * _FAR, 1.5 * _FAR, 2 * _FAR


def _named(value) -> tuple[str, bool] | None:
    """Name and direction of an order given as ``"name"`` or ``"name desc"``."""
    if not isinstance(value, str):
        return None
    falling = value.endswith(" desc")
    return value.removesuffix(" desc"), falling


def _col(value) -> Column:
    if not isinstance(value, str):
        return value
    name, falling = _named(value)
    return F.col(name).desc() if falling else F.col(name)


def running(df: DataFrame, order, scope=(), measure: str | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Row number and running total inside each scope, whatever the scope's size.

    Scopes of up to ``_WHOLE`` rows are numbered by a window each, which takes one shuffle
    by scope. The others are cut into slices (see ``_sliced``), so that none of them ends up
    in one task. The rows are written once, as they are counted first; not so where ``sizes``
    has at least as many rows of each scope and no scope is large, as these are counted then.

    Adds ``row_number`` and, with ``measure``, ``running`` and ``total``.
    """
    scope = list(scope)
    if not scope:
        return _sliced(df, order, scope, measure)
    df = settle(df, "rows") if sizes is None else df
    large = settle((df if sizes is None else sizes).groupBy(*scope).agg(F.count(F.lit(1)).alias("_size"))
                   .filter(F.col("_size") > _WHOLE).drop("_size"), "large")
    if large.isEmpty():
        return _whole(df, order, scope, measure)
    df = df if sizes is None else settle(df, "rows")
    return _sliced(join_same(df, large, scope, "left_semi"), order, scope, measure).unionByName(
        _whole(join_same(df, large, scope, "left_anti"), order, scope, measure))


def _whole(df: DataFrame, order, scope, measure: str | None) -> DataFrame:
    """``running`` by a window over each scope."""
    by = Window.partitionBy(*scope).orderBy(*[_col(o) for o in order])
    out = df.withColumn("row_number", F.row_number().over(by).cast("long"))
    if measure:
        amount = F.col(measure)
        out = out.withColumn("running", F.sum(amount).over(by.rowsBetween(Window.unboundedPreceding, 0)))
        out = out.withColumn("total", F.sum(amount).over(Window.partitionBy(*scope)))
    return out


def _sliced(df: DataFrame, order, scope, measure: str | None) -> DataFrame:
    """``running`` by slices of even size.

    Rows are range-partitioned by (scope, order), so a scope is cut into slices, ties and
    hot scopes included, as long as ``order`` is a total order.
    Each slice is numbered on its own and shifted by the totals of the slices
    before it; those totals are one row per slice. The slices are written once,
    because a range boundary drawn from a sample must not be drawn again.
    """
    amount = F.col(measure) if measure else F.lit(0)
    keyed = [F.col(c).asc() for c in scope] + [_col(o) for o in order]
    sliced = settle(
        df.repartitionByRange(*keyed).withColumn("_slice", F.spark_partition_id()), "slices"
    )

    before = Window.partitionBy(*scope).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy(*scope)
    sizes = sliced.groupBy(*scope, "_slice").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(amount).alias("_amount")
    )
    offsets = sizes.select(
        *scope, "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_amount").over(before), F.lit(0)).alias("_amount_before"),
        F.sum("_amount").over(whole).alias("_total"),
    )

    local = Window.partitionBy(*scope, "_slice").orderBy(*[_col(o) for o in order])
    out = join_same(
        sliced.withColumn("_local_n", F.row_number().over(local)).withColumn(
            "_local_amount",
            F.sum(amount).over(local.rowsBetween(Window.unboundedPreceding, 0)),
        ),
        offsets,
        [*scope, "_slice"],
    ).withColumn("row_number", F.col("_rows_before") + F.col("_local_n"))
    if measure:
        out = out.withColumn("running", F.col("_amount_before") + F.col("_local_amount"))
        out = out.withColumn("total", F.col("_total"))
    return out.drop(
        "_slice", "_rows_before", "_amount_before", "_total", "_local_n", "_local_amount"
    )


def _spot(df: DataFrame, name: str, falling: bool) -> tuple[Column, float] | None:
    """A double that never falls along the order of a column, and the size below which
    equal spots mean equal values; None where the type has no such double."""
    kind, value = df.schema[name].dataType, F.col(name)
    sure = _FAR
    if kind in (T.StringType(), T.BinaryType()):
        head = F.rpad(F.substring(F.hex(value), 1, 12), 12, "0")
        spot, sure = F.conv(head, 16, 10).cast("double"), 0.0
    elif isinstance(kind, T.DateType):
        spot = F.unix_date(value).cast("double")
    elif isinstance(kind, T.TimestampType):
        spot, sure = F.unix_micros(value).cast("double"), 2.0 ** 53
    elif isinstance(kind, T.DecimalType):
        spot, sure = value.cast("double"), _FAR if kind.precision <= 15 else 0.0
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        wide = value.cast("double")
        spot = (F.when(F.isnan(wide), F.lit(_NAN)).when(wide == F.lit(float("inf")), F.lit(_INFINITE))
                .when(wide == F.lit(float("-inf")), F.lit(-_INFINITE))
                .otherwise(F.greatest(F.least(wide, F.lit(_FAR)), F.lit(-_FAR))))
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        spot, sure = value.cast("double"), 2.0 ** 53
    else:
        return None
    # a case and no coalesce: the smaller of a number and a null is the number
    return F.when(value.isNull(), F.lit(_NULL if falling else -_NULL)).otherwise(-spot if falling else spot), sure


def leading(df: DataFrame, order, n: int, scope=(), slack: int = 4) -> DataFrame:
    """Rows among which are the first ``n`` of each scope, found without a sort.

    ``order`` holds names, ``"name"`` or ``"name desc"``. A round counts the rows of each
    scope by equal parts of the range of values that the n-th row lies in, and narrows it
    to one part; ties of one value are told apart by the next name. It ends when no more
    than ``slack * n`` rows of a scope lie in the range, so no more than (1 + slack) * n are
    returned of it, unless rows cannot be told apart: equal in all names, or in the first
    six bytes of a text. Those all stay, since the result must hold the first n of any
    order among them. Each round reads the scope and the names of ``df`` once and writes a
    row per scope. Nulls lie as in a sort: first, or last where it falls.
    """
    scope, names, spots = list(scope), [], []
    for name, falling in map(_named, order):
        found = _spot(df, name, falling)
        if found is None:
            break
        spots.append(found)
        names.append(f"_spot{len(names)}")
    if not spots or n < 1:
        return df.limit(0) if n < 1 else df
    placed = df.withColumns({k: spot for k, (spot, _) in zip(names, spots)})
    narrow = placed.select(*scope, *names)
    ends = [f"_end{k}" for k in range(len(names))]
    level, low, high = F.col("_level"), F.col("_low"), F.col("_high")
    here = F.get(F.array(*[F.col(k) for k in names]), level)
    sure = F.get(F.array(*[F.lit(limit) for _, limit in spots]), level)

    def beside(rows: DataFrame, state: DataFrame) -> DataFrame:
        """The row of its scope beside each row; without a scope there is but one."""
        if scope:
            return join_same(rows, state, scope, "inner")
        only = state.first()
        return rows.withColumns({f.name: F.lit(only[f.name]).cast(f.dataType) for f in state.schema})

    def narrowed(parts: DataFrame) -> DataFrame:
        """The part of each scope in which its n-th row lies, from counts and ends of the parts."""
        by_part = Window.partitionBy(*scope).orderBy("_part")
        parts = parts.withColumns({
            "_upto": F.sum("_n").over(by_part.rowsBetween(Window.unboundedPreceding, 0)),
            "_last": F.max("_part").over(Window.partitionBy(*scope)),
        })
        before = F.col("_upto") - F.col("_n")
        cut = parts.where((before < F.col("_need"))
                          & ((F.col("_upto") >= F.col("_need")) | (F.col("_part") == F.col("_last"))))
        few, one = F.col("_n") <= slack * n, F.col("_from") == F.col("_to")
        told = one & ((F.abs("_from") < sure) | (F.abs("_from") > _FAR))
        deeper = ~few & told & (level + 1 < len(names))
        stuck = one | (F.col("_from").eqNullSafe(low) & F.col("_to").eqNullSafe(high))
        return cut.select(
            *scope,
            *[F.when(level == k, F.col("_to")).otherwise(F.col(e)).alias(e) for k, e in enumerate(ends)],
            F.when(~deeper, F.col("_from")).alias("_low"), F.when(~deeper, F.col("_to")).alias("_high"),
            (F.col("_need") - before).alias("_need"),
            F.when(deeper, level + 1).otherwise(level).alias("_level"),
            (few | (stuck & ~deeper)).alias("_done"),
        )

    counts = (F.count(F.lit(1)).alias("_n"), F.min(here).alias("_from"), F.max(here).alias("_to"))
    nothing = F.lit(None).cast("double")
    start = {**dict.fromkeys([*ends, "_low", "_high"], nothing), "_need": F.lit(n).cast("long"),
             "_level": F.lit(0), "_part": F.lit(0).cast("long")}
    first = narrow.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("_n"), F.min(names[0]).alias("_from"), F.max(names[0]).alias("_to"))
    state = settle(narrowed(first.withColumns(start)), "cut")
    part = F.when(high > low, F.least(
        F.floor((here - low) / (high - low) * _PARTS), F.lit(_PARTS - 1).cast("long"))).otherwise(0)
    while not (left := state.where(~F.col("_done"))).isEmpty():
        known = [c for c in left.columns if c not in (*scope, "_need", "_done")]
        at = beside(narrow, left.select(*scope, *known))
        for k, (name, end) in enumerate(zip(names, ends)):
            at = at.where((level <= k) | (F.col(name) == F.col(end)))
        at = at.where(low.isNull() | here.between(low, high))
        parts = at.groupBy(*scope, part.alias("_part")).agg(*counts)
        state = settle(state.where("_done").unionByName(narrowed(beside(parts, left.drop("_done")))), "cut")
    within = F.lit(True)
    for name, end in reversed(list(zip(names, ends))):
        spot, end = F.col(name), F.col(end)
        within = end.isNull() | (spot < end) | ((spot == end) & within)
    return beside(placed, state.select(*scope, *ends)).where(within).select(*[F.col(f"`{c}`") for c in df.columns])


def _heads(df: DataFrame, order, n: int, scope) -> DataFrame:
    """``leading`` by the names that ``order`` begins with."""
    names = []
    for o in order:
        if _named(o) is None:
            break
        names.append(o)
    return leading(df, names, n, scope) if names else df


def pareto(df: DataFrame, measure: str, keys, threshold: float = 99, scope=(),
           small_scopes: bool = False) -> DataFrame:
    """The biggest contributors up to and including the one that crosses
    ``threshold`` percent of the scope's total.

    Adds ``pct`` and ``running_pct`` as unrounded doubles. Rows are ordered by
    ``measure`` descending with ``keys`` as tiebreak. ``small_scopes`` promises
    that a scope holds a bounded number of rows (say, one per wait type), which
    makes two window functions over the scope the cheapest plan; without the
    promise the running total is spread over slices of each scope.
    """
    order = [F.col(measure).desc(), *[F.col(k).asc() for k in keys]]
    if small_scopes:
        ordered = Window.partitionBy(*scope).orderBy(*order)
        ranked = df.withColumn(
            "running", F.sum(measure).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
        ).withColumn("total", F.sum(measure).over(Window.partitionBy(*scope)))
    else:
        ranked = running(df, order, scope, measure).drop("row_number")
    return (
        ranked.withColumn("pct", percent(measure, "total"))
        .withColumn("running_pct", percent("running", "total"))
        .filter(percent(F.col("running") - F.col(measure), "total") < threshold)
        .drop("running", "total")
    )


def share_of_total(df: DataFrame, measure: str, scope=(), name: str = "pct") -> DataFrame:
    """Percent of the scope's total in each row.

    Totals are aggregated with map-side combine and joined back, so a scope that
    holds much of the data is never gathered into one task.
    """
    if not scope:
        total = df.agg(F.sum(measure)).scalar()
        return df.withColumn(name, percent(F.col(measure), total))
    totals = df.groupBy(*scope).agg(F.sum(measure).alias("_total"))
    return (
        join_same(df, totals, scope)
        .withColumn(name, percent(measure, "_total"))
        .drop("_total")
    )


def top_n(df: DataFrame, order, n: int, scope=(), spread: bool = False) -> DataFrame:
    """First ``n`` rows by ``order`` in each scope, or overall without one.

    By default one task ends up with the first n rows of a scope, which suits the n of
    a report. ``spread`` is for an n of any size: where ``order`` begins with names,
    ``"name"`` or ``"name desc"``, ``leading`` first leaves a few times n rows; ranks come
    from ``running``, which cuts every scope into slices, and no task holds more than a slice.
    """
    named, order = order, [_col(o) for o in order]
    if spread:
        ranked = running(_heads(df, named, n, scope), order, scope)
        return ranked.filter(F.col("row_number") <= n).drop("row_number")
    if not scope:
        return df.orderBy(*order).limit(n)
    ranked = df.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    )
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def first_per_group(df: DataFrame, group, order) -> DataFrame:
    """The first row by ``order`` of each group."""
    return top_n(df, order, 1, group)


def page(df: DataFrame, order, page: int = 1, size: int = 10, scope=(), after=None,
         spread: bool = False) -> DataFrame:
    """Page number ``page`` with ``row_number`` and ``total_hits``.

    A page comes from a top-k of page * size rows in one task; ``spread`` cuts it out of
    row numbers spread over slices instead, for pages far back (see ``top_n`` for orders
    given by name). ``after``, a filter
    expression on the last key seen, replaces the page number for readers that walk
    forward; row numbers then count from that key.
    """
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    named, order = order, [_col(o) for o in order]
    first, last = (page - 1) * size + 1, page * size
    if scope:
        hits = df.groupBy(*scope).agg(F.count(F.lit(1)).alias("total_hits"))
    else:
        hits = df.agg(F.count(F.lit(1)).alias("total_hits"))
    rows = df.filter(after) if after is not None else df

    if spread:
        cut = running(_heads(rows, named, last, scope), order, scope).filter(F.col("row_number").between(first, last))
    else:
        # The window sees at most page * size rows per scope.
        head = top_n(rows, order, last, scope)
        cut = head.withColumn(
            "row_number",
            F.row_number().over(Window.partitionBy(*scope).orderBy(*order)).cast("long"),
        ).filter(F.col("row_number") >= first)
    if scope:
        return join_same(cut, hits, scope)
    return cut.withColumn("total_hits", hits.scalar())
