import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fleetstats import functions as fn


def one(spark, **cols):
    out = spark.range(1).select(*[c.alias(n) for n, c in cols.items()])
    return out.collect()[0]


def test_integer_division_truncates_and_guards_zero(spark):
    r = one(spark, a=fn.idiv(F.lit(-7), 2), b=fn.int_avg(F.lit(7), F.lit(2)),
            c=fn.int_avg(F.lit(7), F.lit(0)))
    assert (r.a, r.b, r.c) == (-3, 3, None)


@pytest.mark.parametrize("ms, data, log", [
    (4, "Good", "Good"), (5, "Good", "Acceptable"), (9, "Good", "Acceptable"),
    (10, "Acceptable", "Acceptable"), (14, "Acceptable", "Acceptable"),
    (15, "Acceptable", "Unacceptable"), (19, "Acceptable", "Unacceptable"),
    (20, "Unacceptable", "Unacceptable"),
])
def test_bands_have_strict_upper_edges(spark, ms, data, log):
    labels = ["Good", "Acceptable", "Unacceptable"]
    r = one(spark, d=fn.band(F.lit(ms), (10, 20), labels), l=fn.band(F.lit(ms), (5, 15), labels))
    assert (r.d, r.l) == (data, log)


def test_band_needs_matching_labels():
    with pytest.raises(ValueError):
        fn.band("x", (1, 2), ("a", "b"))


@pytest.mark.parametrize("start, end, want", [
    (0, -1, "SELECT 1; SELECT 2"), (0, 14, "SELECT 1"), (20, -1, "SELECT 2"), (20, 34, "SELECT 2"),
])
def test_statement_text_counts_two_byte_offsets(spark, start, end, want):
    text = F.lit("SELECT 1; SELECT 2")
    assert one(spark, s=fn.statement_text(text, F.lit(start), F.lit(end))).s == want


def test_statement_text_open_end(spark):
    args = (F.lit("abcdef"), F.lit(4), F.lit(0))
    assert one(spark, s=fn.statement_text(*args, zero_end_is_open=True)).s == "cdef"


def test_split_object_name(spark):
    parts = {n: c for n, c in fn.split_object_name(F.lit("[db].[dbo].[my.table]")).items()}
    r = one(spark, **parts)
    assert (r.database, r.rest, r["last"]) == ("[db]", "[dbo].[my.table]", "my.table")
    r = one(spark, **fn.split_object_name(F.lit("plain")))
    assert (r.database, r.rest, r["last"]) == (None, "plain", "plain")


def test_index_ddl_with_each_part_missing(spark):
    def ddl(eq, ineq, incl):
        return one(spark, s=fn.index_ddl(
            F.lit(7), F.lit(9), F.lit("[d].[s].[" + "t" * 40 + "]"),
            *[F.lit(x).cast("string") for x in (eq, ineq, incl)])).s

    head = "CREATE INDEX [missing_index_7_9_" + "t" * 32 + "] ON [d].[s].[" + "t" * 40 + "]"
    assert ddl("[a]", "[b]", "[c]") == head + " ([a],[b]) INCLUDE ([c])"
    assert ddl(None, "[b]", None) == head + " ([b])"
    assert ddl("[a]", None, "[c]") == head + " ([a]) INCLUDE ([c])"


def test_sizes_and_bits(spark):
    flags = fn.bit_flags(F.lit(18), {"clustered": 16, "unique": 2, "primary": 2048})
    r = spark.range(1).select(
        fn.parse_kb(F.lit("12345 KB")).alias("kb"), fn.parse_kb(F.lit("0 KB")).alias("zero"),
        *flags, fn.bits_clear(F.lit(16), (32, 64)).alias("clear"),
        fn.bits_clear(F.lit(48), (32, 64)).alias("set"),
    ).collect()[0]
    assert tuple(r) == (12345, 0, 1, 1, 0, True, False)


def test_usage_flag_and_row_max_skip_nulls(spark):
    n = F.lit(None).cast("long")
    r = one(spark, a=fn.usage_flag(n, F.lit(0)), b=fn.usage_flag(n, F.lit(2)),
            c=fn.row_max(n, F.lit(3), F.lit(1)))
    assert (r.a, r.b, r.c) == (0, 1, 3)


def test_elapsed_seconds_stops_after_twenty_midnights(spark):
    now = F.lit(dt.datetime(2024, 5, 21, 0, 0, 1))
    r = one(spark, kept=fn.elapsed_seconds(F.lit(dt.datetime(2024, 5, 1, 23, 59, 59)), now),
            old=fn.elapsed_seconds(F.lit(dt.datetime(2024, 4, 30, 23, 59, 59)), now))
    assert float(r.kept) == 19 * 86400 + 2 and r.old is None


def test_clock_text(spark):
    now = F.lit(dt.datetime(2024, 5, 21, 10, 0, 0))
    r = one(spark, today=fn.clock_text(F.lit(dt.datetime(2024, 5, 21, 9, 8, 7)), now),
            before=fn.clock_text(F.lit(dt.datetime(2024, 5, 20, 23, 0, 0)), now))
    assert (r.today, r.before) == ("09:08:07", "240520 23:00:00")


def test_temp_table_names(spark):
    names = ["#0A1B2C3D", "#0a1b2c3d", "#ab" + "_" * 125, "##global" + "_" * 120, "orders"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(fn.temp_table_name("n")).collect()]
    assert got == ["#(tblvar or dropped temp table)", None, "#ab", None, None]


def test_plan_values_take_first_match_and_survive_bad_xml(spark):
    plans = [
        ("<p xmlns='urn:x'><g i='12.5'><m d='a'/></g><g i='9'><m d='b'/></g></p>", 12.5, "a", True),
        ("<p><g i='x'/></p>", None, None, False),
        ("<p><g i='1'", None, None, False), ("", None, None, False), (None, None, None, False),
    ]
    df = spark.createDataFrame([(p[0],) for p in plans], "x string")
    df = df.withColumn("has", fn.plan_exists("x", "/p/g/m"))
    out = fn.plan_values(df, "x", {"i": ("/p/g/@i", "double"), "d": ("/p/g/m/@d", "string")})
    assert rows(out, "i", "d", "has") == [p[1:] for p in plans]


def test_statements_beyond_the_basic_plane(spark):
    text = "\U0001F600\U0001F600 SELECT 1 \U0001F600; SELECT 2"
    units = text.encode("utf-16-le")
    start = units.index("SELECT 2".encode("utf-16-le"))
    first = units.index("SELECT 1".encode("utf-16-le"))
    df = spark.createDataFrame(
        [(text, start, -1), (text, first, first + 14), (text, 0, start - 2), ("plain text", 12, 18), (None, 0, -1)],
        "t string, s int, e int")
    got = [r[0] for r in df.select(fn.statement_text("t", "s", "e")).collect()]
    assert got == ["SELECT 2", "SELECT 1", units[:start].decode("utf-16-le"), "text", None]


def test_sizes_over_two_billion(spark):
    row = spark.createDataFrame([("3000000000 KB",)], "s string").select(fn.parse_kb("s"), fn.dec2(F.lit(2e10), digits=20)).first()
    assert row[0] == 3_000_000_000 and row[1] == 20_000_000_000


def test_index_hints_come_from_one_parse(spark):
    def plan(groups, root="ShowPlanXML"):
        return (f"<{root}><BatchSequence><Batch><Statements><StmtSimple/><StmtSimple><QueryPlan><MissingIndexes>{groups}</MissingIndexes>"
                f"</QueryPlan></StmtSimple></Statements></Batch></BatchSequence></{root.split()[0]}>")

    group = '<MissingIndexGroup Impact="{}"><MissingIndex Database="{}" Table="{}"/></MissingIndexGroup>'
    two = group.format("1.5", "m", "t1") + group.format("x", "d", "t2")
    texts = [plan(two), plan(two, 'ShowPlanXML xmlns="http://x.org/plan" Version="1"'), plan('<MissingIndexGroup Impact="2"/>'), plan(""),
             "<ShowPlanXML/>", plan(two)[:-9], "", None, "no xml"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, x string")
    out = df.select("n", fn.index_hints("x").alias("h"))
    got = {r.n: None if r.h is None else [(h.impact and float(h.impact), h.database, h.table) for h in r.h] for r in out.collect()}
    both = [(1.5, "m", "t1"), (None, "d", "t2")]
    assert got == {0: both, 1: both, 2: [(2.0, None, None)], 3: [], 4: [], 5: None, 6: None, 7: None, 8: None}


def test_the_plan_report_parses_each_document_once(spark):
    from fleetstats.catalog import QUERIES

    plan = QUERIES["missing_index_plans"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("from_xml(") + plan.count("XmlToStructs") + plan.count("xmltostructs(") == 1 and "xpath" not in plan.lower()


def test_documents_are_dealt_over_tasks_and_searched_once(spark):
    from fleetstats.catalog import QUERIES

    plan = QUERIES["plan_documents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("XPathStringEvaluator") == 1 and "Repartition 8, true" in plan
    xml = "<a><b i='1'/><b i='2'>x</b><c>y,z</c></a>"
    df = spark.createDataFrame([(0, xml), (1, "<a/>"), (2, "<a>"), (3, None), (4, "")], "n int, x string")
    out = fn.plan_values(df, "x", {"i": ("//b/@i", "int"), "b": ("//b[2]", "string"), "c": ("//c|//d", "string")})
    assert sorted(rows(out, "n", "i", "b", "c")) == [(0, 1, "x", "y,z"), *[(n, None, None, None) for n in (1, 2, 3, 4)]]
