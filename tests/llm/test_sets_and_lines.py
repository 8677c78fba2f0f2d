"""Groups of alike shingle sets and repeated line runs, against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetstats.llm import line_dedup, ngram_join


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_groups(rows, n, num, den):
    """Smallest id reachable by links, for rows of distinct ids."""
    sets = {d: shingles(t, n) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(rng):
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "delta"]) + str(rng.randrange(400))
    rows = []
    for family in range(12):
        base = [word() for _ in range(rng.choice([1, 2, 4, 30, 80, 200]))]
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100)])
def test_groups_lose_no_link(spark, n, num, den, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    rows = corpus(random.Random(n)) + [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "Éa x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n", "'x' as _row", "2 as _id")
    want = brute_groups(rows, n, num, den)
    assert sum(c != d for d, (_, c) in want.items()) > 10
    got = ngram_join.groups(docs, n, num, den)
    assert {r.doc_id: (r.n_grams, r.component_id) for r in got.collect()} == want
    kept = ngram_join.firsts(docs, n, num, den)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (5, "a b c d e f g"), (5, "a b c d e f g"), (None, "only here x"),
            (None, "only here x"), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_grams, r.component_id) for r in ngram_join.groups(docs, 3, 90, 100).collect()), key=str)
    assert got == sorted([(None, 5, 5)] * 2 + [(5, 5, 5)] * 2 + [(None, 1, None)] * 2 + [(None, 0, None)] * 2, key=str)
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.firsts(docs, 3, 90, 100).collect()), key=str)
    assert kept == sorted([(5, "a b c d e f g"), (None, "only here x"), (None, None), (None, None)], key=str)
    assert ngram_join.groups(docs.where("false"), 3, 90, 100).count() == 0


def brute_lines(rows, least_lines, least_chars):
    """Line numbers to delete and the longest repeated run that starts at one, for each document."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    seqs = []
    for d, t in order:
        lines = [] if t is None else t.split("\n")
        seqs.append([(n, x) for n, x in enumerate(lines) if len(x.strip(" \t\n\x0b\x0c\r")) >= least_chars])
    starts = [(k, i) for k, s in enumerate(seqs) for i in range(len(s))]

    def common(a, b):
        (k, i), (m, j) = a, b
        n = 0
        while i + n < len(seqs[k]) and j + n < len(seqs[m]) and seqs[k][i + n][1] == seqs[m][j + n][1]:
            n += 1
        return n

    gone = {d: set() for d, _ in order}
    longest = {d: 0 for d, _ in order}
    for at, here in enumerate(starts):
        if any(common(here, other) >= least_lines for other in starts[:at]):
            run = max(common(here, o) for o in starts if o != here)
            d = order[here[0]][0]
            gone[d] |= {seqs[here[0]][here[1] + n][0] for n in range(least_lines)}
            longest[d] = max(longest[d], run)
    return gone, longest


@pytest.mark.parametrize("least_lines", [1, 2, 3])
def test_later_copies_of_line_runs_go(spark, least_lines):
    rng = random.Random(least_lines)
    pool = [f"line number {n} of the pool" for n in range(25)] + ["short", ""]
    rows = []
    for d in range(30):
        lines = [rng.choice(pool) if rng.random() < 0.7 else f"own line {rng.random()} of {d}" for _ in range(rng.randrange(0, 14))]
        if d and rng.random() < 0.4:
            lines += rows[rng.randrange(d)][1].split("\n")[:9]
        rows.append((d, "\n".join(lines)))
    rows += [(90, None), (91, ""), (92, "\n\n"), (93, "   "), (None, rows[3][1] + "\nlast words of nobody")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as doc", "2 as t", "3 as gone")
    gone, longest = brute_lines(rows, least_lines, 15)
    out = line_dedup.dedup(docs, least_lines=least_lines, least_chars=15, deleted_col="k", longest_col="l")
    assert out.columns == [*docs.columns, "k", "l"]
    for r in out.collect():
        t = dict(rows)[r.doc_id]
        kept = t if not gone[r.doc_id] else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[r.doc_id])
        # a covered line counts the run of the suffixes that start on it
        assert (r.text, r.k) == (kept, len(gone[r.doc_id])), r.doc_id
        if least_lines == 1:
            assert r.l == longest[r.doc_id]


def brute_runs(rows, least):
    """Line numbers in maximal runs of so many characters that stand elsewhere before."""
    seqs = [(d, [(n, x) for n, x in enumerate((t or "").split("\n")) if x.strip()]) for d, t in rows]
    starts = [(k, i) for k, (_, s) in enumerate(seqs) for i in range(len(s))]
    gone = {d: set() for d, _ in rows}
    for at, (k, i) in enumerate(starts):
        for m, j in starts[:at]:
            (d, a), (_, b), n = seqs[k], seqs[m], 0
            while i + n < len(a) and j + n < len(b) and a[i + n][1] == b[j + n][1]:
                n += 1
            if sum(len(x.strip()) for _, x in a[i:i + n]) >= least:
                gone[d] |= {no for no, _ in a[i:i + n]}
    return gone


def test_runs_of_short_lines_go(spark):
    rng = random.Random(7)
    pool = ["a", "be", "sea", "tree", " root", "a line of twenty characters", "", "some eleven"]
    rows = [(0, "\n".join(f"verse {n}" for n in range(8))), (1, "own\n" + "\n".join(f"verse {n}" for n in range(8)) + "\nend"),
            (2, "a line of twenty characters\nshort"), (3, "a line of twenty characters\nshort")]
    for d in range(4, 30):
        rows.append((d, "\n".join(rng.choice(pool) if rng.random() < 0.9 else str(rng.random()) for _ in range(rng.randrange(12)))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    gone = brute_runs(rows, 20)
    assert gone[1] == set(range(1, 9)) and gone[3] == {0, 1}
    got = {r.doc_id: (r.text, r.k) for r in line_dedup.dedup(docs, least_run_chars=20, deleted_col="k").collect()}
    assert got == {d: ("\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d]), len(gone[d])) for d, t in rows}


def test_equal_suffixes_share_all_their_lines(spark):
    text = "\n".join(f"line number {n} of the text" for n in range(9))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string")
    assert [r.l for r in line_dedup.dedup(docs, longest_col="l").orderBy("doc_id").collect()] == [0, 9]


def test_nothing_repeated_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a line that stands alone\nanother one like that")], "doc_id bigint, text string")
    assert line_dedup.dedup(docs).collect() == docs.collect()
    assert line_dedup.dedup(docs.where("false")).count() == 0
    twice = docs.union(docs)
    assert line_dedup.dedup(twice).collect() == twice.collect()


def test_suffixes_are_in_order(spark):
    letters = "abracadabra"
    rows = [(1, 0, i, ord(c), 0) for i, c in enumerate(letters)] + [(2, 0, i, ord(c), 0) for i, c in enumerate("cadab")]
    got = line_dedup.suffix_array(spark.createDataFrame(rows, "doc bigint, t bigint, i int, h1 bigint, h2 int"))
    found = [(r.doc, r.i, r.lcp) for r in got.orderBy("idx").collect()]
    texts = {1: letters, 2: "cadab"}
    want = sorted(((d, i) for d in texts for i in range(len(texts[d]))), key=lambda x: (texts[x[0]][x[1]:], x))
    assert [x[:2] for x in found] == want
    for a, b in zip(found, found[1:]):
        x, y = texts[a[0]][a[1]:], texts[b[0]][b[1]:]
        assert b[2] == next((n for n, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    assert got.agg(F.min("idx"), F.max("idx")).first()[:] == (0, len(want) - 1)


@pytest.mark.parametrize("depth", [None, 3, 8, 11])
def test_suffixes_longer_than_a_head_are_in_order(spark, depth):
    rng = random.Random(depth)
    texts = {1: "ab" * 13, 2: "".join(rng.choice("ab") for _ in range(40)), 3: "abcdefghijklm" * 2, 4: "cdefghijklmabcdefghij", 5: "ij"}
    texts[6] = texts[2][5:37] + "a"
    rows = [(d, 0, i, ord(c), 0, i) for d, x in texts.items() for i, c in enumerate(x) if (d, i) != (4, 15)]
    got = line_dedup.suffix_array(spark.createDataFrame(rows, "doc bigint, t bigint, i int, h1 bigint, h2 int, own int"), depth).orderBy("idx").collect()
    # a missing line ends the suffixes before it
    ends = {d: texts[d] for d in texts}

    def said(d, i):
        return ends[d][i:15 if d == 4 and i < 15 else None][:depth]

    assert [r.idx for r in got] == list(range(len(rows))) and all(r.own == r.i for r in got)
    order = [said(r.doc, r.i) for r in got]
    assert order == sorted(order) and sorted((r.doc, r.i) for r in got) == [r[:1] + r[2:3] for r in rows]
    for x, y, r in zip(order, order[1:], got[1:]):
        assert r.lcp == next((n for n, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_one_sort_settles_short_suffixes(spark, monkeypatch):
    sorts = []
    order = line_dedup._order
    monkeypatch.setattr(line_dedup, "_order", lambda df, *keys: sorts.append(keys) or order(df, *keys))
    rows = [(d, 0, i, (d % 3) * i, 0) for d in range(9) for i in range(7)]
    line_dedup.suffix_array(spark.createDataFrame(rows, "doc bigint, t bigint, i int, h1 bigint, h2 int"))
    # the lines, then the suffixes
    assert len(sorts) == 2


def test_settled_suffixes_take_no_part_in_later_rounds(spark, monkeypatch):
    paired = []
    settle = line_dedup.settle

    def watched(df, purpose):
        out = settle(df, purpose)
        if purpose == "lines-pairs":
            paired.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "settle", watched)
    # two copies of 40 lines; many of 12 lines that tie on a head and split, or end, in the first round
    texts = [[*range(40)], [*range(40), 99], *[[*range(50, 61), 70 + k % 10] for k in range(60)]]
    rows = [(d, 0, i, h, h) for d, text in enumerate(texts) for i, h in enumerate(text)]
    got = line_dedup.suffix_array(spark.createDataFrame(rows, "doc bigint, t bigint, i int, h1 bigint, h2 int")).orderBy("idx").collect()
    suffix = {(r.doc, r.i): texts[r.doc][r.i:] for r in got}
    assert [suffix[r.doc, r.i] for r in got] == sorted(suffix.values())
    for a, b in zip(got, got[1:]):
        x, y = suffix[a.doc, a.i], suffix[b.doc, b.i]
        assert b.lcp == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    assert len(paired) > 2 and paired[0] >= 60 * 4
    # of the first two texts only, and fewer each time
    assert all(n <= 2 * 40 for n in paired[1:]) and paired[-1] < paired[1]


def test_tiles_of_up_to_three_classes_end_with_the_first_comparison(spark, monkeypatch):
    rng, rows, seen, blocks = random.Random(5), [], [], ngram_join._blocks
    for size in (2, 3, 6):
        base = [f"word{rng.randrange(5000)}" for _ in range(100)]
        for k in range(size):
            rows.append((len(rows), " ".join(base[:k] + [f"own{size}{k}"] + base[k + 1:])))

    def spy(tiles, *rest):
        seen.extend(r["count"] for r in tiles.groupBy("h", "band").count().collect())
        return blocks(tiles, *rest)

    monkeypatch.setattr(ngram_join, "_blocks", spy)
    got = ngram_join.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90, 100).collect()
    assert {r.doc_id: (r.n_grams, r.component_id) for r in got} == brute_groups(rows, 3, 90, 100)
    assert seen and min(seen) > 3
