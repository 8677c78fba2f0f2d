"""Join helpers that keep NULL keys and never hint a strategy.

No broadcast is forced anywhere in the package: a side is broadcast when Spark's
own size check allows it (statically, or from shuffle statistics at run time), and
otherwise the join shuffles, with hot keys split by adaptive execution.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def join_same(left: DataFrame, right: DataFrame, keys, how: str = "left") -> DataFrame:
    """Join on equal ``keys`` where NULL equals NULL; right keys are dropped."""
    keys = list(keys)
    renamed = right.select(
        *[F.col(k).alias(f"_same_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    on = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys]
    )
    return left.join(renamed, on, how).drop(*[f"_same_{k}" for k in keys])


def lookup(df: DataFrame, dim: DataFrame, on: dict[str, str], take: dict[str, str],
           keys=(), how: str = "left") -> DataFrame:
    """Bring columns of a dimension into ``df``.

    ``on`` maps a column of ``df`` to one of ``dim``, ``take`` maps a column of
    ``dim`` to its name in the result, and ``keys`` are snapshot key columns that
    both sides have. Only the named columns of ``dim`` are read. A dimension with the time
    it holds from instead of the snapshot's (see ``sources.as_of``) gives what held then.
    """
    from .asof import SINCE, lookup_as_of

    missing = [k for k in keys if k not in dim.columns]
    if len(missing) == 1 and SINCE in dim.columns:
        return lookup_as_of(df, dim, on, take, keys, missing[0], how)
    side = dim.select(
        *[F.col(k).alias(f"_dim_{k}") for k in keys],
        *[F.col(r).alias(f"_on_{l}") for l, r in on.items()],
        *[F.col(c).alias(name) for c, name in take.items()],
    )
    cond = [F.col(k) == F.col(f"_dim_{k}") for k in keys]
    cond += [F.col(l) == F.col(f"_on_{l}") for l in on]
    out = df.join(side, reduce(lambda a, b: a & b, cond), how)
    if how in ("left_semi", "left_anti"):
        return out
    return out.drop(*[f"_dim_{k}" for k in keys], *[f"_on_{l}" for l in on])
