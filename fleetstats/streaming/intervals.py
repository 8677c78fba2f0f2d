"""Growth of counters between collections, as these arrive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def deltas_stream(df: DataFrame, by, time: str, counters) -> DataFrame:
    """``operators.deltas`` of a stream: each key's counters against those of its collection before.

    The state of a key is its last collection, so it grows with the number of keys and not
    with time. A key whose counter fell restarted, each key by itself. Rows of a collection
    that is not newer than the key's last are repeats or late, and are ignored.
    """
    by, counters = list(by), list(counters)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    keys = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    values = ", ".join(f"`{c}` bigint" for c in counters)
    columns = [*by, "since", time, "seconds", "restarted", *counters]

    def step(key, parts, state):
        rows = pd.concat(list(parts))
        rows[counters] = rows[counters].fillna(0).astype("int64")
        rows = rows.groupby("_at", as_index=False)[counters].max().sort_values("_at")
        held, out = (state.get if state.exists else None), []
        for row in rows.itertuples(index=False):
            if held is not None and row[0] > held[0]:
                fell = any(now < was for now, was in zip(row[1:], held[1:]))
                grown = [int(now) - (0 if fell else was) for now, was in zip(row[1:], held[1:])]
                out.append((*key, held[0], int(row[0]), (int(row[0]) - held[0]) / 1e6, fell, *grown))
            if held is None or row[0] > held[0]:
                held = tuple(int(x) for x in row)
        state.update(held)
        yield pd.DataFrame(out, columns=columns)

    narrow = df.where(F.col(time).isNotNull()).select(
        *by, F.unix_micros(F.col(time).cast("timestamp")).alias("_at"), *[F.col(c).cast("long").alias(c) for c in counters])
    found = narrow.groupBy(*by).applyInPandasWithState(
        step, f"{keys}, since bigint, `{time}` bigint, seconds double, restarted boolean, {values}", f"_at bigint, {values}",
        "append", GroupStateTimeout.NoTimeout)
    return found.withColumns({c: F.timestamp_micros(c) for c in ("since", time)})
