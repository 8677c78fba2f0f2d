import datetime
import random
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fleetstats.operators import (
    conditional_rollup, first_per_group, fit_ratio, latest_or_label, leading, page, pareto, ranking,
    running, share_of_total, top_n,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """20,000 rows; one scope has a third of them, and many values tie."""
    rng = random.Random(5)
    data = [("hot" if i % 3 == 0 else f"s{i % 50}", i, rng.choice([1, 1, 1, 5, 90]))
            for i in range(20_000)]
    return data, spark.createDataFrame(data, "scope string, id long, v long").repartition(16)


def brute_running(data, key):
    by = {}
    for s, i, v in data:
        by.setdefault(s, []).append((i, v))
    out = {}
    for s, items in by.items():
        total = sum(v for _, v in items)
        run = 0
        for n, (i, v) in enumerate(sorted(items, key=key), 1):
            run += v
            out[i] = (n, run, total)
    return out


def test_running_matches_brute_force_on_a_hot_scope(skewed):
    data, df = skewed
    got = running(df, [F.desc("v"), F.asc("id")], ["scope"], "v")
    want = brute_running(data, lambda p: (-p[1], p[0]))
    assert {r.id: (r.row_number, r.running, r.total) for r in got.collect()} == want


def test_running_without_scope_and_with_null_scope(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "s string, v long")
    got = running(df, ["v"], ["s"], "v")
    assert sorted(rows(got, "v", "row_number", "running")) == [(1, 1, 1), (2, 2, 3), (3, 1, 3)]
    assert sorted(rows(running(df, ["v"]), "v", "row_number")) == [(1, 1), (2, 2), (3, 3)]


@pytest.mark.parametrize("small", [True, False])
def test_pareto_keeps_the_crossing_row(spark, small):
    df = spark.createDataFrame(
        [("a", 50), ("b", 30), ("c", 15), ("d", 5), ("e", 0)], "k string, v long")
    out = pareto(df, "v", ["k"], 90, small_scopes=small).orderBy("running_pct")
    assert rows(out, "k", "pct", "running_pct") == [("a", 50, 50), ("b", 30, 80), ("c", 15, 95)]


def test_pareto_plans_agree_and_running_share_grows(skewed):
    _, df = skewed
    spread = pareto(df, "v", ["id"], 70, ["scope"])
    small = pareto(df, "v", ["id"], 70, ["scope"], small_scopes=True)
    cols = ["scope", "id", "pct", "running_pct"]
    a, b = sorted(rows(spread, *cols)), sorted(rows(small, *cols))
    assert a == b
    last = {}
    for s, _, pct, run in sorted(a, key=lambda r: r[3]):
        assert run >= last.get(s, (0, 0))[0]
        last[s] = (run, pct)
    assert all(run >= 70 > run - pct for run, pct in last.values())


def test_share_of_total_per_scope_and_overall(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), (None, 4)], "s string, v long")
    assert sorted(r[0] for r in rows(share_of_total(df, "v", ["s"]), "pct")) == [25, 75, 100]
    assert sorted(r[0] for r in rows(share_of_total(df, "v"), "pct")) == [12.5, 37.5, 50]


@pytest.mark.parametrize("n", [3, 1200])
def test_top_n_per_scope(skewed, n):
    data, df = skewed
    got = top_n(df, [F.desc("v"), "id"], n, ["scope"])
    want = set()
    for s in {d[0] for d in data}:
        mine = sorted((d for d in data if d[0] == s), key=lambda d: (-d[2], d[1]))
        want |= {d[1] for d in mine[:n]}
    assert {r.id for r in got.collect()} == want
    assert len(top_n(df, [F.desc("v"), "id"], 7).collect()) == 7


def test_first_per_group(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", None), ("b", 5)], "g string, v int")
    assert sorted(rows(first_per_group(df, ["g"], ["v"]), "g", "v")) == [("a", 1), ("b", None)]


@pytest.mark.parametrize("deep", [False, True])
def test_pages_join_to_the_full_order(spark, deep):
    df = spark.createDataFrame([(i * 37 % 25,) for i in range(25)], "v int")
    seen = []
    for p in (1, 2, 3):
        part = rows(page(df, ["v"], p, 10, spread=deep).orderBy("row_number"), "v", "row_number", "total_hits")
        assert all(hits == 25 for *_, hits in part)
        seen += [(v, n) for v, n, _ in part]
    assert seen == [(i, i + 1) for i in range(25)]


@pytest.mark.parametrize("deep", [False, True])
def test_page_per_scope(skewed, deep):
    data, df = skewed
    got = page(df, ["id"], 2, 5, ["scope"], spread=deep)
    hot = sorted(d[1] for d in data if d[0] == "hot")
    mine = sorted(rows(got.filter("scope = 'hot'"), "row_number", "id", "total_hits"))
    assert mine == [(i + 1, hot[i], len(hot)) for i in range(5, 10)]


def test_page_after_a_key_and_bad_arguments(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "v int")
    got = page(df, ["v"], 1, 3, after=F.col("v") > 4)
    assert rows(got.orderBy("v"), "v", "total_hits") == [(5, 10), (6, 10), (7, 10)]
    with pytest.raises(ValueError):
        page(df, ["v"], 0, 3)


def test_fit_ratio_is_strict_and_null_fits(spark):
    df = spark.createDataFrame([(80.0,), (80.1,), (None,), (10.0,)], "x double")
    assert rows(fit_ratio(df, {"x": "fit"}), "fit") == [(0.75,)]
    assert rows(fit_ratio(df.filter("false"), {"x": "fit"}), "fit") == [(None,)]


def test_conditional_rollup_truncates_the_average(spark):
    df = spark.createDataFrame(
        [("a", 10, 1), ("a", 30, 2), ("b", 0, 1)], "k string, size long, uses int")
    out = conditional_rollup(df, ["k"], "size", "uses", F.col("uses") == 1).orderBy("k")
    assert rows(out, "n", "amount", "avg_uses", "amount_if", "n_if", "pct_if") == [
        (2, 40, 1, 10, 1, 25.0), (1, 0, 1, 0, 1, None)]


def test_latest_or_label(spark):
    left = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    right = spark.createDataFrame([("a", 1), ("a", 3), ("z", 9)], "k string, t int")
    out = latest_or_label(left, right, ["k"], "t", "none").orderBy("k")
    assert rows(out, "k", "t", "label") == [("a", 3, None), ("b", None, "none")]


@pytest.fixture(scope="module")
def mixed(spark):
    """6,000 rows of one hot scope and others, with nulls, ties, extremes and equal beginnings."""
    rnd, data = random.Random(5), []
    for i in range(6000):
        scope = rnd.choice(["hot", "hot", "hot", "b", None]) if i else "one"
        v = rnd.choice([None, 3.0, 3.0, 3.0, rnd.gauss(0, 1) * 10 ** rnd.randint(-6, 9), float("inf"), float("-inf"), float("nan")])
        text = rnd.choice([None, "", "same", "same", "é" + str(rnd.random()), str(rnd.random())])
        data.append((scope, i, v, rnd.choice([None, 7, 7, 7, rnd.randint(-2 ** 62, 2 ** 62)]), text,
                     decimal_of(rnd), datetime.date(2020, 1, 1) + datetime.timedelta(rnd.randint(0, 3)),
                     datetime.datetime(2020, 1, 1) + datetime.timedelta(seconds=rnd.randint(0, 10 ** 6))))
    kinds = "scope string, id int, v double, w long, t string, m decimal(12,2), d date, h timestamp"
    return ranking.settle(spark.createDataFrame(data, kinds), "mixed")


@pytest.mark.parametrize("order, scope, n", [
    (["v", "id"], ["scope"], 20), (["v desc", "id"], [], 50), (["w desc", "id desc"], ["scope"], 20),
    (["t desc", "v", "id"], ["scope"], 5), (["m desc", "id"], [], 30), (["d", "h", "id"], ["scope"], 5),
])
def test_leading_rows_are_few_and_hold_the_first_of_every_scope(mixed, order, scope, n):
    few = ranking.settle(leading(mixed, order, n, scope), "few")
    assert few.columns == mixed.columns
    want = sorted(rows(top_n(mixed, order, n, scope), "id"))
    assert sorted(rows(top_n(few, order, n, scope), "id")) == want
    if order[0] != "t desc":
        assert few.count() <= 5 * n * (4 if scope else 1)


def test_spread_top_rows_by_name_are_those_of_the_window(mixed):
    order = ["v desc", "id"]
    want = sorted(rows(top_n(mixed, order, 40, ["scope"]), "id"))
    assert sorted(rows(top_n(mixed, order, 40, ["scope"], spread=True), "id")) == want


def decimal_of(rnd):
    return rnd.choice([None, Decimal("1.25"), Decimal(rnd.randint(-10 ** 6, 10 ** 6)) / 100])


def test_leading_of_nothing_of_none_and_of_what_has_no_order_of_numbers(spark):
    df = spark.createDataFrame([], "s string, v int, a array<int>")
    for scope in ([], ["s"]):
        assert leading(df, ["v"], 3, scope).count() == 0
        assert rows(top_n(df, ["v"], 3, scope, spread=True), "v") == []
    some = spark.createDataFrame([("x", k, [k]) for k in range(50)], df.schema)
    assert leading(some, ["v"], 0).count() == 0
    assert leading(some, ["a"], 1).count() == 50
    assert {r[0] for r in top_n(some, ["a desc"], 2, ["s"], spread=True).select("v").collect()} == {49, 48}


def test_rows_equal_in_every_name_all_stay(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("v"), "id")
    assert leading(df, ["v"], 5).count() == 500
    assert leading(df, ["v", "id"], 5).count() <= 25


def test_running_slices_large_scopes_only(skewed, spark, monkeypatch):
    from fleetstats.operators import ranking as r

    data, df = skewed
    want = brute_running(data, lambda p: (-p[1], p[0]))
    monkeypatch.setattr(r, "_WHOLE", 1000)
    sliced, original = [], r._sliced
    monkeypatch.setattr(r, "_sliced", lambda part, *more: sliced.append(set(rows(part.select("scope").distinct(), "scope"))) or original(part, *more))
    got = running(df, [F.desc("v"), F.asc("id")], ["scope"], "v")
    assert {x.id: (x.row_number, x.running, x.total) for x in got.collect()} == want and sliced == [{("hot",)}]
    monkeypatch.setattr(r, "_WHOLE", 100_000)
    running(df, [F.desc("v"), F.asc("id")], ["scope"], "v")
    assert len(sliced) == 1


def test_running_counts_sizes_and_writes_large_scopes_only(skewed, monkeypatch):
    from fleetstats.operators import ranking as r

    data, df = skewed
    want = brute_running(data, lambda p: (-p[1], p[0]))
    written, write = [], r.settle
    monkeypatch.setattr(r, "settle", lambda df, purpose: written.append(purpose) or write(df, purpose))
    for whole, purposes in ((100_000, ["large"]), (1000, ["large", "rows", "slices"])):
        monkeypatch.setattr(r, "_WHOLE", whole)
        got = running(df, [F.desc("v"), F.asc("id")], ["scope"], "v", sizes=df.select("scope"))
        assert {x.id: (x.row_number, x.running, x.total) for x in got.collect()} == want
        assert written == purposes
        written.clear()
