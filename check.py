"""Compare registered queries with their oracles in DuckDB.

usage: python check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

from fleetstats.catalog import ORACLES, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]").appName("check")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="fleetstats-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns, rows) -> tuple[list[str], list[tuple]]:
    """Columns by name and rows in a fixed order, numbers as exact doubles."""
    names = sorted(columns)
    at = [columns.index(n) for n in names]

    def value(x):
        if x is None:
            return "~"
        if isinstance(x, bool):
            return str(x)
        if hasattr(x, "as_integer_ratio") or hasattr(x, "as_tuple"):
            return repr(float(x))
        return str(x)

    return names, sorted(tuple(value(r[i]) for i in at) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> str:
    df = QUERIES[name](spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return f"rows only ({len(got[1])})"
    cur = con.execute(ORACLES[name])
    types = {d[0]: str(d[1]) for d in cur.description}
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    odd = {c: t for c, t in types.items() if "HUGE" in t or "DECIMAL" in t or t == "BOOLEAN"}
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} / {want[0]}"
    if got[1] != want[1]:
        first = next(((g, w) for g, w in zip(got[1], want[1]) if g != w), None)
        return f"VALUES {len(got[1])} / {len(want[1])} rows, first {first}"
    return f"ok ({len(got[1])})" + (f" types {odd}" if odd else "")


def main(argv) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = session(), oracle_connection(sf_dir)
    bad = 0
    for name in argv[1:] or QUERIES:
        start = time.time()
        try:
            result = compare(spark, con, sf_dir, name)
        except Exception as e:
            result = f"ERROR {str(e)[:700]}"
        bad += result.startswith(("COLUMNS", "VALUES", "ERROR"))
        print(f"{name}: {result} in {time.time() - start:.1f}s", flush=True)
    print(f"{bad} bad of {len(argv[1:] or QUERIES)}")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
