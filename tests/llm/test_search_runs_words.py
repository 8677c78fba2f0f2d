"""Nearest vectors, periodic runs, spelling variants: against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetstats.llm import neighbours, periodic_runs, queries, spelling_variants

# nearest vectors

VECTORS = "vec_id bigint, embedding array<float>, rank int, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 7, "clash")
                                  for i, v in rows], VECTORS)


def brute_nearest(rows, k, every):
    """The k nearest of every query over distinct rows that take part."""
    part = {(i, tuple(np.float32(v).tolist())) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in part:
        if q % every == 0:
            best = out.setdefault(q, {})
            for i, w in part:
                if i != q and len(w) == len(v):
                    a, b = np.array(v, float), np.array(w, float)
                    cos = float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
                    best[i] = max(best.get(i, -2), cos)
    return {q: sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k] for q, best in out.items() if best}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_neighbours_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 24))
    v[500:900] = v[500] + 0.05 * rng.normal(size=(400, 24))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got, want = found(neighbours.nearest(frame(spark, rows))), brute_nearest(rows, 5, 50)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    exact = {q: dict(found_) for q, found_ in brute_nearest(rows, 3000, 50).items()}
    assert all(s == pytest.approx(exact[q][i], abs=1e-14) for q, near in got.items() for i, s in near)


def test_copies_of_a_vector_are_ranked_by_id(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(400)] + [(1000 + i, rng.normal(size=4).tolist()) for i in range(100)]
    got = found(neighbours.nearest(frame(spark, rows)))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5]
    assert [i for i, _ in got[350]] == [0, 1, 2, 3, 4]
    assert len({s for _, s in got[350]}) == 1


def test_rows_that_take_no_part_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0, 0]), (1, [0, 1, 0]), (2, [-1, 0, 0]), (3, None), (4, []), (5, [0, 0, 0]), (6, [1, None, 0]), (7, [nan, 1, 0]),
            (8, [inf, 1, 0]), (None, [1, 0, 0]), (50, [2, 0, 0]), (50, [2, 0, 0]), (9, [1, 0]), (1, [1, 1, 0])]
    got = found(neighbours.nearest(frame(spark, rows)))
    want = brute_nearest(rows, 5, 50)
    assert got.keys() == {0, 50} == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
    assert neighbours.nearest(frame(spark, [])).collect() == []
    assert neighbours.nearest(frame(spark, [(0, [1.0])])).collect() == []


def test_an_id_on_many_vectors_counts_once(spark):
    rng = np.random.default_rng(5)
    rows = [(1, [1.0, 0.01 * n, 0.0, 0.0]) for n in range(30)] + [(0, [1.0, 0, 0, 0])] + [
        (10 + n, rng.normal(size=4).tolist()) for n in range(8)]
    got, want = found(neighbours.nearest(frame(spark, rows))), brute_nearest(rows, 5, 50)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}


def test_an_axis_is_the_nearest_of_the_turned_vector():
    rng = np.random.default_rng(6)
    unit = rng.normal(size=(50, 20))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    turn = neighbours.Rotation(3, 20)
    turned = turn.turn(unit)
    assert np.allclose(np.linalg.norm(turned, axis=1), 1)
    assert np.allclose(turned @ turned.T, unit @ unit.T)
    axes = np.stack([turned, -turned], axis=2).reshape(50, -1)
    assert (turn.axis(unit) == axes.argmax(axis=1)).all()
    assert all(set(a) == set(np.argsort(-b)[:5]) for a, b in zip(turn.axes(unit, 5), axes))


# periodic runs

def brute_runs(seq, least, folds):
    out = set()
    for q in range(1, len(seq) // folds + 1):
        equal = [seq[i] == seq[i + q] for i in range(len(seq) - q)] + [False]
        i = 0
        while i < len(equal):
            j = i
            while equal[j]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, folds * q) and not any(
                    all(seq[k] == seq[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                out.add((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequence(rng):
    seq = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randrange(80))]
    for _ in range(rng.randrange(3)):
        unit = [rng.randrange(6) for _ in range(rng.randrange(1, 11))]
        n, at = rng.randrange(2 * len(unit), 5 * len(unit) + 20), rng.randrange(len(seq) + 1)
        seq[at:at] = (unit * (n // len(unit) + 1))[:n]
    return seq


def test_runs_equal_brute_force():
    rng = random.Random(7)
    for _ in range(1500):
        seq, (least, folds) = sequence(rng), rng.choice([(24, 3), (6, 2), (9, 3), (2, 2), (12, 4)])
        text = [b"w%d" % x for x in seq]
        assert periodic_runs.Runs(least, folds).of(text) == brute_runs(seq, least, folds)


def altered(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected_report(doc_id, text):
    words = altered(doc_id, re.findall("[^\x20\x09-\x0D]+", text or ""))
    runs = brute_runs(words, 24, 3)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_report_of_documents(spark, tmp_path):
    rng = random.Random(8)
    docs = [(i, " ".join(f"w{x}" for x in sequence(rng))) for i in range(400)]
    docs += [(i, "\n\t".join(f"é{rng.randrange(10 ** 6)}" for _ in range(200))) for i in range(400, 500)]
    docs += [(900, None), (901, ""), (902, " \n "), (None, "a b " * 30), (903, "x " * 5000), (904, "x " * 5000), (905, "a\x0bb\x0cc\x1cd\xa0e " * 9)]
    docs += [docs[0], docs[0]]
    spark.createDataFrame([(*d, "clash") for d in docs], "doc_id bigint, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((expected_report(*d) for d in docs), key=repr)
    assert sum(r[1] > 0 for r in got) > 50


def test_runs_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert periodic_runs.report(periodic_runs.runs(none)).collect() == []


# spelling variants

def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_variants(docs, slips):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            if h % slips == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += len(run) >= 7
    n = {w: c for w, c in count.items() if c >= 2}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n}


def spelt(rng, base, n):
    out = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(60)):
            w = rng.choice(base) if rng.random() < 0.7 else base[0]
            if rng.random() < 0.1:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "x", w[at] + "é", "Ÿ"]) + w[at + rng.randrange(2):]
            words.append(w)
        out.append((i if rng.random() < 0.95 else None, rng.choice([" ", "\n", "-", "1"]).join(words)))
    return out


@pytest.mark.parametrize("shard", [spelling_variants.SHARD, 8])
def test_variants_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(spelling_variants, "SHARD", shard)
    rng = random.Random(9)
    base = ["".join(rng.choice("abAéß÷") for _ in range(rng.randrange(6, 13))) for _ in range(40)]
    docs = spelt(rng, base, 150) + [(1, None), (2, ""), (3, "kurz "), (4, "sehrlangeswort" * 400 + " " + "sehrlangeswort" * 400)]
    docs += [docs[0], docs[0]]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, word int")
    got = [tuple(r) for r in spelling_variants.variants(df, slips=5).collect()]
    want = brute_variants(docs, 5)
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(w[1] is not None for w in want) > 10


def test_roots_follow_chains_of_forms(spark):
    text = " ".join(["straight"] * 2000 + ["straighy"] * 200 + ["straighyz"] * 20 + ["xtraighyz"] * 2 + ["different"] * 2)
    got = {r.word: r for r in spelling_variants.variants(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()}
    assert got["xtraighyz"].form == "straighyz" and got["xtraighyz"].root == "straight"
    assert got["straight"].root == "straight" and got["straight"].form is None and got["different"].n_near == 0


def test_variants_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling_variants.variants(df, slips=31).collect() == []
    assert spelling_variants.variants(df.union(spark.createDataFrame([(1, "short words")], df.schema))).collect() == []


def test_suffixes_are_in_order():
    rng = random.Random(10)
    for n in range(1, 60):
        text = [rng.randrange(3) for _ in range(n)]
        assert spelling_variants.suffix_array(np.array(text)).tolist() == sorted(range(n), key=lambda i: text[i:])
