"""The generic operators, each on the sales tables or a view of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import (
    chain_levels, conditional_rollup, deadlock_tails, first_per_group, fit_ratio,
    latest_or_label, page, pareto, running, same_lead_only, share_of_total, shown_levels, top_n,
)
from ..plans import dimensions as dim
from ..sources import append, read, scratch_dir
from ..streaming import dtu_stream, resource_fit_stream
from .registry import query
from .reports import _FITS, pct, stmt
from .views import spark_view


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _revenue(spark, sf_dir):
    """Whole currency units of orders per customer."""
    return _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.sum(F.floor("o_totalprice").cast("long")).alias("revenue")
    )


_REVENUE = """revenue AS (SELECT o_custkey, sum(CAST(floor(o_totalprice) AS BIGINT))::BIGINT AS revenue
    FROM orders GROUP BY o_custkey)"""


@query(f"""
    WITH {_REVENUE}, r AS (
        SELECT *, sum(revenue) OVER () AS total,
            sum(revenue) OVER (ORDER BY revenue DESC, o_custkey ROWS UNBOUNDED PRECEDING) AS run
        FROM revenue)
    SELECT o_custkey, revenue, {pct('revenue', 'total')} AS pct, {pct('run', 'total')} AS running_pct
    FROM r WHERE {pct('run - revenue', 'total')} < 80""")
def pareto_customers(spark, sf_dir):
    return pareto(_revenue(spark, sf_dir), "revenue", ["o_custkey"], 80)


@query("""
    WITH r AS (
        SELECT o_orderpriority, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders)
    SELECT o_orderpriority, o_orderkey, price,
        row_number() OVER w AS row_number, CAST(sum(price) OVER w AS BIGINT) AS running,
        CAST(sum(price) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS total
    FROM r WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""")
def running_order_total(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderpriority", "o_orderkey", F.floor("o_totalprice").cast("long").alias("price")
    )
    return running(orders, ["o_orderkey"], ["o_orderpriority"], "price")


@query("""
    SELECT l_returnflag,
        (count(*) - count(CASE WHEN l_quantity > 40 THEN 1 END))::DOUBLE / count(*) AS quantity_fit,
        (count(*) - count(CASE WHEN l_linenumber > 40 THEN 1 END))::DOUBLE / count(*) AS line_fit
    FROM lineitem GROUP BY l_returnflag""")
def fit_ratio_lines(spark, sf_dir):
    return fit_ratio(
        _table(spark, sf_dir, "lineitem"),
        {"l_quantity": "quantity_fit", "l_linenumber": "line_fit"}, 40, ["l_returnflag"],
    )


@query("""
    SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3""")
def top_orders_per_customer(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_n(orders, [F.desc("o_totalprice"), "o_orderkey"], 3, ["o_custkey"])


@query("""
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def top_orders(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return top_n(orders, [F.desc("o_totalprice"), "o_orderkey"], 100)


@query("""
    SELECT o_orderstatus, o_orderkey FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) <= 1500""")
def top_many_orders_per_status(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    return top_n(orders, ["o_totalprice", "o_orderkey"], 1500, ["o_orderstatus"], spread=True
                 ).drop("o_totalprice")


@query("""
    SELECT o_orderkey, o_orderdate, row_number, total_hits FROM (
        SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS row_number,
            count(*) OVER () AS total_hits FROM orders) AS r
    WHERE row_number BETWEEN 51 AND 75""")
def page_orders(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return page(orders, [F.desc("o_orderdate"), "o_orderkey"], 3, 25)


@query("""
    SELECT o_orderkey, o_orderdate, row_number, total_hits FROM (
        SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS row_number,
            count(*) OVER () AS total_hits FROM orders) AS r
    WHERE row_number BETWEEN 1001 AND 1025""")
def page_deep(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return page(orders, ["o_orderdate desc", "o_orderkey"], 41, 25, spread=True)


@query("""
    SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS row_number,
        (SELECT count(*) FROM orders) AS total_hits FROM orders WHERE o_orderdate < DATE '1997-01-01'
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 25""")
def page_after(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return page(orders, [F.desc("o_orderdate"), "o_orderkey"], 1, 25,
                after=F.col("o_orderdate") < F.lit("1997-01-01").cast("date"))


@query("""
    SELECT o_custkey, o_orderkey, o_orderdate FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def first_order_per_customer(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return first_per_group(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(f"""
    WITH {_REVENUE}
    SELECT c_mktsegment, o_custkey, revenue,
        {pct('revenue', 'sum(revenue) OVER (PARTITION BY c_mktsegment)')} AS pct
    FROM revenue JOIN customer ON c_custkey = o_custkey""")
def share_of_segment(spark, sf_dir):
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = _revenue(spark, sf_dir).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return share_of_total(joined.drop("c_custkey"), "revenue", ["c_mktsegment"])


@query("""
    SELECT l_partkey, sum(l_linenumber)::BIGINT // count(*) AS avg_line,
        (sum(l_linenumber)::BIGINT - 5 * count(*)) // count(*) AS avg_difference,
        CASE WHEN count(CASE WHEN l_returnflag = 'R' THEN 1 END) > 0
             THEN count(*) // count(CASE WHEN l_returnflag = 'R' THEN 1 END) END AS per_return
    FROM lineitem GROUP BY l_partkey""")
def truncated_averages(spark, sf_dir):
    sums = _table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_linenumber").alias("s"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("l_returnflag") == "R").alias("r"),
    )
    return sums.select(
        "l_partkey", fn.int_avg("s", "n").alias("avg_line"),
        fn.int_avg(F.col("s") - 5 * F.col("n"), "n").alias("avg_difference"),
        fn.int_avg("n", "r").alias("per_return"),
    )


@query("""
    SELECT o_orderkey, CASE WHEN p < 1000 THEN 'small' WHEN p < 100000 THEN 'medium'
        WHEN p < 300000 THEN 'large' ELSE 'huge' END AS size
    FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders) AS x""")
def order_price_bands(spark, sf_dir):
    price = F.floor("o_totalprice").cast("long")
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        fn.band(price, (1000, 100000, 300000), ("small", "medium", "large", "huge")).alias("size"),
    )


@query(f"""
    SELECT p_partkey, {stmt('txt', 's', 'e')} AS statement
    FROM (SELECT p_partkey, p_name || ' ' || p_type AS txt, 2 * (p_size % 4) AS s,
              CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 2 * (p_size % 4) + 8 END AS e
          FROM part) AS x""")
def statement_texts(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("txt"),
        (2 * (F.col("p_size") % 4)).alias("s"),
        F.when(F.col("p_partkey") % 2 == 0, -1).otherwise(2 * (F.col("p_size") % 4) + 8).alias("e"),
    )
    return parts.select("p_partkey", fn.statement_text("txt", "s", "e").alias("statement"))


@query("""
    SELECT p_partkey, split_part(nm, '.', 1) AS database, substr(nm, instr(nm, '.') + 1) AS rest,
        replace(replace(split_part(nm, '.', 3), '[', ''), ']', '') AS last
    FROM (SELECT p_partkey, '[' || p_brand || '].[dbo].[' || p_name || ']' AS nm FROM part) AS x""")
def object_name_parts(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.lit("["), "p_brand", F.lit("].[dbo].["), "p_name", F.lit("]")).alias("nm"),
    )
    split = fn.split_object_name("nm")
    return parts.select("p_partkey", *[c.alias(n) for n, c in split.items()])


@query("""
    SELECT p_partkey, CASE WHEN p_partkey & 1 = 0 THEN 0 ELSE 1 END AS odd,
        CASE WHEN p_partkey & 16 = 0 THEN 0 ELSE 1 END AS sixteen
    FROM part WHERE p_partkey & 768 = 0""")
def part_bit_flags(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").filter(fn.bits_clear("p_partkey", (256, 512)))
    return parts.select("p_partkey", *fn.bit_flags("p_partkey", {"odd": 1, "sixteen": 16}))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS kb FROM part")
def parsed_sizes(spark, sf_dir):
    text = F.concat(F.col("p_size").cast("string"), F.lit(" KB"))
    return _table(spark, sf_dir, "part").select("p_partkey", fn.parse_kb(text).alias("kb"))


@query(f"""
    SELECT o_orderpriority, count(*) AS n, sum(p)::BIGINT AS amount,
        sum(o_custkey)::BIGINT // count(*) AS avg_uses,
        sum(CASE WHEN o_orderstatus = 'F' THEN p ELSE 0 END)::BIGINT AS amount_if,
        count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_if,
        {pct("sum(CASE WHEN o_orderstatus = 'F' THEN p ELSE 0 END)", 'sum(p)')} AS pct_if
    FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders) AS x
    GROUP BY o_orderpriority""")
def rollup_by_priority(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").withColumn("p", F.floor("o_totalprice").cast("long"))
    return conditional_rollup(orders, ["o_orderpriority"], "p", "o_custkey",
                              F.col("o_orderstatus") == "F")


@query("""
    SELECT c_custkey, max(o_orderdate) AS o_orderdate,
        CASE WHEN max(o_orderdate) IS NULL THEN 'No order' END AS label
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'
    GROUP BY c_custkey""")
def latest_order_or_label(spark, sf_dir):
    pending = _table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "P").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderdate"
    )
    return latest_or_label(_table(spark, sf_dir, "customer"), pending, ["c_custkey"], "o_orderdate",
                           "No order")


@query("""
    SELECT event_id, greatest(value, value2, 40.0) AS most
    FROM (SELECT event_id, value, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 2 * value END AS value2
          FROM events) AS x""")
def row_maximum(spark, sf_dir):
    second = F.when(F.col("event_id") % 3 != 0, 2 * F.col("value"))
    return _table(spark, sf_dir, "events").select(
        "event_id", fn.row_max("value", second, F.lit(40.0)).alias("most")
    )


@query("""
    SELECT p_partkey, 'CREATE INDEX [missing_index_' || p_partkey || '_' || p_size || '_'
        || left(p_name, 32) || '] ON [' || p_name || '] (' || concat_ws(',', a, b) || ')'
        || coalesce(' INCLUDE (' || c || ')', '') AS ddl
    FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN p_brand END AS a,
              CASE WHEN p_size % 3 = 0 THEN p_type END AS b,
              CASE WHEN p_size % 5 = 0 THEN p_brand END AS c FROM part) AS x""")
def index_statements(spark, sf_dir):
    size = F.col("p_size")
    return _table(spark, sf_dir, "part").select(
        "p_partkey",
        fn.index_ddl(
            "p_partkey", "p_size", F.concat(F.lit("["), "p_name", F.lit("]")),
            F.when(size % 2 == 0, F.col("p_brand")), F.when(size % 3 == 0, F.col("p_type")),
            F.when(size % 5 == 0, F.col("p_brand")),
        ).alias("ddl"),
    )


@query("""
    , p AS (SELECT *, query_plan LIKE '%</ShowPlanXML>' AS good FROM query_plan)
    SELECT server_id, plan_handle, (good AND query_plan LIKE '%MissingIndexes%')::BIGINT AS hinted,
        CASE WHEN good THEN CAST(nullif(regexp_extract(query_plan, 'Impact="([^"]*)"', 1), '')
            AS DOUBLE) END AS impact,
        CASE WHEN good THEN nullif(regexp_extract(query_plan, 'Table="([^"]*)"', 1), '') END
            AS "table"
    FROM p""", ["query_plan"])
def plan_documents(spark, sf_dir):
    plans = fn.dealt(spark_view(spark, sf_dir, "query_plan"))
    group = "//MissingIndexGroup"
    out = fn.plan_values(
        plans.withColumn("hinted", fn.plan_exists("query_plan", "//MissingIndex")), "query_plan",
        {"impact": (f"{group}/@Impact", "decimal(18,4)"),
         "table": (f"{group}/MissingIndex/@Table", "string")},
    )
    return out.select("server_id", "plan_handle", "hinted", "impact", "table")


@query("""
    SELECT l_suppkey, CASE WHEN count(CASE WHEN l_returnflag = 'R' AND l_quantity > 49 THEN 1 END) > 0
        OR count(CASE WHEN l_tax > 0.09 THEN 1 END) > 0 THEN 1 ELSE 0 END AS used
    FROM lineitem GROUP BY l_suppkey""")
def supplier_usage_flag(spark, sf_dir):
    counted = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49)).alias("a"),
        F.count_if(F.col("l_tax") > 0.09).alias("b"),
    )
    return counted.select("l_suppkey", fn.usage_flag("a", "b").alias("used"))


@query("""
    SELECT o_orderkey,
        CASE WHEN date_diff('day', o_orderdate, TIMESTAMP '2000-01-01 10:30:00.250') <= 400
             THEN date_diff('millisecond', o_orderdate, TIMESTAMP '2000-01-01 10:30:00.250') / 1000.0
        END AS seconds
    FROM orders""")
def order_age(spark, sf_dir):
    now = F.lit("2000-01-01 10:30:00.250").cast("timestamp_ntz")
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", fn.elapsed_seconds("o_orderdate", now, 400).alias("seconds")
    )


# --- wait-for graphs -------------------------------------------------------------

# Levels by walking from the heads; the depth limit is far beyond any chain here.
LEVELS = """, e AS MATERIALIZED (SELECT DISTINCT w, b FROM raw WHERE b IS NOT NULL),
    heads AS (SELECT DISTINCT b AS t FROM e
              WHERE b NOT IN (SELECT w FROM e)),
    walk(t, lead, d) AS (
        SELECT t, t, 0 FROM heads
        UNION SELECT e.w, walk.lead, walk.d + 1 FROM walk JOIN e ON e.b = walk.t WHERE walk.d < 200),
    dist AS MATERIALIZED (SELECT t, min(d) AS d FROM walk GROUP BY t),
    leads AS MATERIALIZED (SELECT walk.t, min(lead) AS lead FROM walk
        JOIN dist ON dist.t = walk.t AND dist.d = walk.d GROUP BY walk.t),
    rest AS MATERIALIZED (SELECT * FROM e WHERE b NOT IN (SELECT t FROM dist)),
    deep(t, d) AS (
        SELECT DISTINCT w, CASE WHEN w IN (SELECT b FROM e) THEN 2 ELSE 1 END
        FROM rest WHERE w NOT IN (SELECT b FROM rest)
        UNION SELECT rest.b, deep.d + 1 FROM deep JOIN rest ON rest.w = deep.t
        WHERE deep.d < 200 AND rest.b IN (SELECT w FROM rest)),
    tail AS MATERIALIZED (
        SELECT t, max(d) AS d FROM deep GROUP BY t HAVING max(d) < 150),
    chain AS MATERIALIZED (
        SELECT e.w, e.b, dist.d + 1 AS level, leads.lead
        FROM e JOIN dist ON dist.t = e.b JOIN leads ON leads.t = e.b
        UNION ALL SELECT rest.w, rest.b, -tail.d, NULL
        FROM rest LEFT JOIN tail ON tail.t = rest.w
        UNION ALL SELECT t, NULL, 0, t FROM heads)
"""
_EDGE_VIEW = ["edges"]
_RAW = ", raw AS (SELECT waiter AS w, blocker AS b FROM edges)"


def _chains(spark, sf_dir):
    return chain_levels(spark_view(spark, sf_dir, "edges"), ["waiter"], ["blocker"], ["server_id"])


@query(_RAW + LEVELS + """
    SELECT 'srv0' AS server_id, w AS waiter, b AS blocker, CASE WHEN level >= 0 THEN level END AS level,
        lead FROM chain""", _EDGE_VIEW)
def customer_chain_levels(spark, sf_dir):
    return _chains(spark, sf_dir)


@query(_RAW + LEVELS + """
    SELECT 'srv0' AS server_id, w AS waiter, b AS blocker, level, lead,
        CASE WHEN level < 0 THEN 1 + level - min(level) OVER () ELSE level END AS shown_level
    FROM chain""", _EDGE_VIEW)
def customer_deadlock_tails(spark, sf_dir):
    tails = deadlock_tails(_chains(spark, sf_dir), ["waiter"], ["blocker"], ["server_id"])
    return shown_levels(tails, ["server_id"])


_ORDER_KEYS = (["wait_session_id", "wait_task"], ["block_session_id", "block_task"])


# Here a row may wait on nobody, so heads are rows as well; sessions are customers.
@query("""
    , e AS MATERIALIZED (SELECT * FROM order_waits),
    walk AS (
        SELECT wait_session_id AS s, wait_task AS t, wait_session_id AS lead, 0 AS level FROM e
        WHERE block_session_id IS NULL AND wait_task IN (SELECT block_task FROM e)
        UNION ALL
        SELECT e.wait_session_id, e.wait_task, walk.lead, walk.level + 1
        FROM walk JOIN e ON e.block_session_id = walk.s AND e.block_task = walk.t),
    shared AS (SELECT DISTINCT lead FROM walk WHERE s <> lead)
    SELECT e.server_id, e.wait_session_id, e.wait_task, e.block_session_id, e.block_task,
        walk.level, walk.lead,
        coalesce(walk.s = walk.lead AND walk.lead NOT IN (SELECT lead FROM shared), FALSE)::BIGINT
            AS same_session_only
    FROM e LEFT JOIN walk ON walk.s = e.wait_session_id AND walk.t = e.wait_task""", ["order_waits"])
def order_chain_sessions(spark, sf_dir):
    chains = chain_levels(spark_view(spark, sf_dir, "order_waits"), *_ORDER_KEYS, ["server_id"])
    return same_lead_only(chains, _ORDER_KEYS[0], ["server_id"]).drop("wait_type", "wait_duration_ms")


# --- dimensions --------------------------------------------------------------------


@query("""
    SELECT CAST(i AS BIGINT) AS id, CAST(TIMESTAMP '1990-01-01' + to_days(CAST(i AS INT)) AS DATE) AS date,
        count(o_orderkey) AS orders, coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)), 0)::BIGINT AS amount
    FROM range(7305) AS r(i)
    LEFT JOIN orders ON date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) = i
    GROUP BY i""")
def orders_by_date_dim(spark, sf_dir):
    epoch = "1990-01-01"
    facts = _table(spark, sf_dir, "orders").groupBy(
        dim.date_id("o_orderdate", epoch).alias("id")
    ).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum(F.floor("o_totalprice").cast("long")).alias("amount"),
    )
    return dim.date_dim(spark, epoch, 20).join(facts, "id", "left").fillna(0, ["orders", "amount"])


@query("""
    SELECT CAST(i AS BIGINT) AS id, strftime(TIMESTAMP '2000-01-01' + to_seconds(i), '%H:%M:%S') AS time,
        count(event_id) AS events
    FROM range(86400) AS r(i)
    LEFT JOIN events ON hour(ts) * 3600 + minute(ts) * 60 + second(ts) = i GROUP BY i""")
def events_by_time_of_day_dim(spark, sf_dir):
    facts = _table(spark, sf_dir, "events").groupBy(dim.time_of_day_id("ts").alias("id")).agg(
        F.count(F.lit(1)).alias("events")
    )
    return dim.time_of_day_dim(spark).join(facts, "id", "left").fillna(0, ["events"])


# --- snapshots and streams -----------------------------------------------------------


@query("""
    SELECT server_id, wait_type, wait_time_ms FROM wait_stats WHERE server_id IN ('A', 'R')""",
    ["wait_stats"])
def snapshot_write_and_read(spark, sf_dir):
    base = scratch_dir(spark, "snapshots")
    waits = spark_view(spark, sf_dir, "wait_stats").withColumn(
        "snapshot_ts", F.lit("2024-01-01 12:00:00").cast("timestamp")
    )
    append(waits, base, "wait_stats")
    return read(spark, base, "wait_stats", servers=["A", "R"], since="2024-01-01").drop("snapshot_ts")


def _drain(stream, spark, purpose):
    """Run a stream over what is there now, and read what it wrote."""
    out = scratch_dir(spark, purpose)
    started = (
        stream.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows")
        .trigger(availableNow=True).start()
    )
    started.awaitTermination()
    flat = spark.read.schema(stream.schema).parquet(f"{out}/rows")
    return flat.withColumns({c: F.col(c).cast("timestamp_ntz")
                             for c in ("window_start", "window_end")})


def _resource_stream(spark, sf_dir):
    """The resource view on a stream of the events file."""
    declared = _table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(declared).option("pathGlobFilter", "events.parquet").parquet(
        sf_dir
    )
    return _of_events(events)


def _of_events(events):
    return events.select(
        F.col("event_type").alias("server_id"), F.col("ts").alias("end_time"),
        F.concat(F.lit("db"), F.col("user_id") % 5).alias("database_name"),
        F.col("value").alias("avg_cpu_percent"),
        F.when(F.col("event_id") % 10 != 0, F.col("value") / 2).alias("avg_data_io_percent"),
        (F.col("value") * 2).alias("avg_log_write_percent"),
    )


_FIT_WINDOWS = f"""
    , w AS (
        SELECT *, time_bucket(INTERVAL 15 MINUTE, end_time) - to_minutes(15 * k) AS window_start
        FROM resource_stats, unnest(range(4)) AS slides(k))
    SELECT server_id, window_start, window_start + INTERVAL 60 MINUTE AS window_end, {_FITS}
    FROM w
    WHERE window_start + INTERVAL 60 MINUTE
        <= (SELECT max(end_time) FROM resource_stats) - INTERVAL 15 MINUTE
    GROUP BY server_id, window_start"""


@query(_FIT_WINDOWS, ["resource_stats"], "resource_fit_stream")
def _resource_fit_stream(spark, sf_dir):
    return _drain(resource_fit_stream(_resource_stream(spark, sf_dir)), spark, "fit-stream")


@query(_FIT_WINDOWS, ["resource_stats"], "resource_fit_stream_repeats")
def _resource_fit_stream_repeats(spark, sf_dir):
    """Four collections of the series, each of which has the last quarter of the one before again."""
    rows = _of_events(_table(spark, sf_dir, "events"))
    first, last = rows.agg(F.unix_micros(F.min("end_time").cast("timestamp")), F.unix_micros(F.max("end_time").cast("timestamp"))).first()
    base, quarter = scratch_dir(spark, "series"), (last - first) // 4 + 1
    at = F.unix_micros(F.col("end_time").cast("timestamp")) - first
    for k in range(4):
        (rows.filter((at >= max(0, (k - 1) * quarter)) & (at < (k + 1) * quarter))
         .withColumn("snapshot_ts", F.timestamp_micros(F.lit(first + (k + 1) * quarter)))
         .coalesce(1).write.mode("append").parquet(base))
    stream = spark.readStream.schema(spark.read.parquet(base).schema).option("maxFilesPerTrigger", 1).parquet(base)
    return _drain(resource_fit_stream(stream), spark, "fit-stream")


@query("""
    SELECT server_id, time_bucket(INTERVAL 5 MINUTE, end_time) AS window_start,
        time_bucket(INTERVAL 5 MINUTE, end_time) + INTERVAL 5 MINUTE AS window_end,
        max(greatest(avg_cpu_percent, avg_data_io_percent, avg_log_write_percent)) AS avg_dtu_percent
    FROM resource_stats
    WHERE time_bucket(INTERVAL 5 MINUTE, end_time) + INTERVAL 5 MINUTE
        <= (SELECT max(end_time) FROM resource_stats) - INTERVAL 15 MINUTE
    GROUP BY server_id, time_bucket(INTERVAL 5 MINUTE, end_time)""", ["resource_stats"], "dtu_stream")
def _dtu_stream(spark, sf_dir):
    return _drain(dtu_stream(_resource_stream(spark, sf_dir)), spark, "dtu-stream")
