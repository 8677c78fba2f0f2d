"""Main text, url verdicts, quality score and quality rules on small tables."""

from __future__ import annotations

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetstats.llm import html_text, quality_classifier, quality_rules, queries, url_filters
from fleetstats.llm.common import components

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>x</article>";</script></head>
<body><header>Site <b>head</b></header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- <article>no</article> -->
<div class="ad">Buy &amp; go</div><article><header><h1>Ti&eacute;tle</h1></header><p>One  <b>bo</b>ld&nbsp;word<br>two
<p>Three &lt;b&gt; &#x41;<aside>aside</aside><form><input>send</form><ul><li>x<li>y</ul><div class="reader comments">no</div></article>
<div id=cookie-notice>cookies</div><footer>&copy; foot</footer>"""


def test_article_without_what_surrounds_it():
    text = " ".join(t for role, _, t in html_text.blocks(PAGE) if role == "main")
    assert text == "Tiétle One bold word two Three <b> A x y"


def test_blocks_of_broken_markup():
    assert html_text.blocks(None) == [] and html_text.blocks("") == []
    assert [b[2] for b in html_text.blocks("<p>a<p>b</i></div>c<script>x")] == ["a", "b", "c"]
    assert [b[2] for b in html_text.blocks("1 < 2 and <b>x</b>y")] == ["1 < 2 and xy"]
    assert [(b[0], b[2]) for b in html_text.blocks("<nav>m</nav>t<nav>open")] == [("chrome", "m"), ("open", "t"), ("chrome", "open")]


def test_head_without_its_end_tag():
    start = "<html><head><meta charset=utf-8><title>T</title><script>x</script>"
    assert html_text.blocks(start + "<body><p>a</body>") == [("open", "html/body/p", "a")]
    assert html_text.blocks(start + "<article>a</article>") == [("main", "html/article", "a")]


def test_places_without_names_are_judged_by_repetition(spark, monkeypatch):
    monkeypatch.setattr(html_text, "PAGES", 4)
    rng = random.Random(4)
    own = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    rows, want = [], {}
    for n in range(12):
        host = "a.org" if n < 8 else "b.org"
        body = own(30)
        head = "<div class=top><p>welcome to the best of all sites</p><p>news and more</p></div>" if host == "a.org" else ""
        rows.append((n, f"http://{host}/{n}", f"{head}<section><p>{body}</p></section><div class=foot>{own(3)}</div>"))
    for n, _, page in rows:
        text = " ".join(t for _, path, t in html_text.blocks(page) if ".top" not in path)
        want[n] = text
    rows += [(20, "http://a.org/x", PAGE), (21, None, None), (22, "http://a.org/y", ""), (None, "http://c.org/", "<p>alone"),
             (20, "http://a.org/x", PAGE)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as t", "2 as id", "3 as host")
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id in want:
            assert r.text == want[r.page_id]
    special = Counter((r.page_id, r.text) for r in got if r.page_id not in want)
    assert special == Counter({(20, "Tiétle One bold word two Three <b> A x y"): 2, (21, ""): 1, (22, ""): 1, (None, "alone"): 1})
    assert html_text.extract(pages.where("false")).count() == 0


def test_runs_go_block_by_block_on_hosts_of_any_size(spark):
    body = "<body><div><p>{0} first own words here</p><p>all rights to these pages are reserved</p><p>{0} second own words here</p></div>"
    rows = [(n, f"http://small.org/{n}", body.format(f"p{n}")) for n in range(2)] + [(2, "http://other.org/", body.format("p2"))]
    again = "<p>twice on this page only</p>" * 2
    rows += [(3, "http://small.org/3", again), (4, "http://small.org/4", "<p>a mirrored page</p>"), (5, "http://small.org/5", "<p>a mirrored page</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == {
        **{n: f"p{n} first own words here p{n} second own words here" for n in range(2)},
        2: "p2 first own words here all rights to these pages are reserved p2 second own words here",
        3: "twice on this page only twice on this page only", 4: "a mirrored page", 5: "a mirrored page"}


def test_attributes_are_told_by_name():
    def roles(page):
        return [(b[0], b[2]) for b in html_text.blocks(page)]

    for inside in ('style="overflow:hidden"', 'aria-hidden="false"', 'title="a hidden gem"', "data-id=share", 'data-role="banner"', "class='related-work'",
                   "class=notice-period", "data-x=it's"):
        assert roles(f"<article {inside}><p {inside}>the text</p></article>") == [("main", "the text")]
    assert roles("<article><p hidden>no</p><p class='x ads'>no</p><p id=Share>no</p>yes</article>")[-1] == ("main", "yes")
    assert {r for r, t in roles("<article><p hidden>no</p><p class='x ads'>no</p><p id=Share>no</p></article>")} == {"chrome", "named"}
    assert roles('<p title="a > b">x<a href="y=\'z">y</a>') == [("open", "xy")]


def test_time_does_not_grow_with_the_square_of_nesting():
    def seconds(n):
        start = time.perf_counter()
        assert len(html_text.blocks("<div class=a>t" * n + "</div>" * n)) == n
        html_text.blocks("<a =" * n)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40_000) < 30 * seconds(4000) + 1


def test_a_page_with_an_article_is_its_article(spark):
    rows = [(n, f"http://a.org/{n}", f"<nav><p>home news sport weather</p></nav><div>more</div><div>own teaser of page {n}</div>"
             f"<article><p>a sentence that recurs here</p><p>own sentence {n}</p></article><div>call us at any time</div>") for n in range(2)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: (r.text, r.n_blocks, r.n_dropped) for r in html_text.extract(pages).collect()}
    assert got == {n: (f"a sentence that recurs here own sentence {n}", 6, 4) for n in range(2)}


def test_verdicts_by_rule_and_along_aliases(spark):
    link = '<html><link href="{}" rel="canonical">'
    rows = [
        (1, "https://WWW.Example.com/en/a", None), (2, "https://m.example.com/en/a?q#f", ""), (3, "http://x.net/es/1", "<p>"),
        (4, "http://x.net/de/1", link.format("http://x.net/es/1")), (5, "http://y.org/1", '<meta http-equiv=refresh content="0; url=/2">'),
        (6, "http://y.org/2", link.format("//x.net/de/1")), (7, "http://y.com/2", link.format("http://y.org/2")),
        (8, "no address", link.format("http://x.net/es/1")), (9, None, None), (10, "http://z.org", "x"), (None, "://h/p?x", "x"),
        (11, "http://elsewhere.org/", link.format("http://q.net/fr/nowhere")), (12, "http://notexample.com/en/", ""),
        (3, "http://x.net/es/1", "<p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as host", "2 as rule", "3 as a")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, queries.URL_RULES).collect())
    want = Counter([
        (1, "www.example.com", "/en/a", "www.example.com/en/", "allow"), (2, "m.example.com", "/en/a", "example.com/en/", "block"),
        (3, "x.net", "/es/1", "net/es/", "block"), (3, "x.net", "/es/1", "net/es/", "block"), (4, "x.net", "/de/1", None, "block"),
        (5, "y.org", "/1", None, "block"), (6, "y.org", "/2", None, "block"), (7, "y.com", "/2", "com/", "allow"),
        (8, "", "", None, "allow"), (9, "", "", None, "allow"), (10, "z.org", "", None, "allow"), (None, "h", "/p", None, "allow"),
        (11, "elsewhere.org", "/", None, "block"), (12, "notexample.com", "/en/", "com/", "allow")])
    assert got == want
    assert url_filters.judge(pages.where("false"), queries.URL_RULES).count() == 0


def test_links_of_all_tags(spark):
    html = ('<link rel=canonical><link rel="canonical" href="/a"><link rel="canonical" href="/b">'
            '<meta http-equiv=refresh content="5"><meta http-equiv=refresh content="0; url=/c">')
    pages = spark.createDataFrame([("http://h.org/", html), ("http://h.org/n", None)], "url string, html string")
    assert sorted(r.b_url for r in url_filters.links(pages).collect()) == [f"http://h.org/{x}" for x in "abc"]


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(8)
    edges = [(n, n + 1) for n in range(100, 160)] + [(n, 7) for n in range(8, 40)] + [(3, 3), (None, 4), (5, None), (2, 1), (1, 2)]
    edges += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "test").collect()}
    root = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in (e for e in edges if None not in e):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}


def plain_counts(text, window=8):
    words = [w for w in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    spots = defaultdict(list)
    for i in range(len(words) - window + 1):
        spots[tuple(words[i:i + window])].append(i)
    covered = {i + j for at in spots.values() if len(at) > 1 for i in at for j in range(window)}
    lines = [x for x in (text or "").split("\n") if x.strip()]
    joined = "".join(words)
    return (len(words), len(joined), sum(c in "#*$%&|<>" for c in joined), len(lines) - len(set(lines)), len(covered))


def test_counts_are_those_of_plain_python(spark):
    rng = random.Random(9)
    texts = [None, "", " ", "a", "x " * 9, "é# 🙂*\n\né# 🙂*", "one two three four five six seven eight " * 2]
    for _ in range(60):
        texts.append("".join(rng.choice(["a", "b", "cc", "d#", "\n", " "]) + rng.choice([" ", " ", "\n"]) for _ in range(rng.randrange(120))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r[0]: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
           for r in quality_rules.counts(docs).collect()}
    assert got == {n: plain_counts(t) for n, t in enumerate(texts)}


def test_buckets_hold_what_they_say(spark):
    values = sorted({*range(300), *(2 ** k + d for k in range(6, 40) for d in (-1, 0, 1))})
    rows = (spark.createDataFrame([(v,) for v in values], "v bigint").select("v", quality_rules.bucket(F.col("v")).alias("b"))
            .select("*", quality_rules.floor_of(F.col("b")).alias("low")).collect())
    for r in rows:
        assert r.low <= r.v <= r.low + r.v / 32
    assert [r.b for r in sorted(rows)] == sorted(r.b for r in rows)


def test_merged_sketches_equal_the_sketch_of_all(spark):
    docs = spark.createDataFrame([(n, "w " * (n + 1) + "#" * (n % 7), "ab"[n % 2]) for n in range(80)], "doc_id bigint, text string, s string")
    counted = quality_rules.counts(docs, keep=("doc_id", "s")).withColumn("all", F.lit(1))
    whole = quality_rules.sketches(counted, ("all",))
    parts = quality_rules.merged(quality_rules.sketches(counted, ("all", "s")), ("all",))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_rules_reject_what_stands_out(spark):
    rng = random.Random(10)
    plain = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(60))
    rows = [(n, plain(), "en", "s") for n in range(150)]
    rows += [(200, plain().replace(" ", "### "), "en", "s"), (201, plain().replace(" ", ""), "en", "s"), (202, None, "en", None),
             (203, "", None, "s"), (204, plain(), None, None), (204, plain(), None, None), (None, plain(), "xx", "new")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "1 as n_words", "2 as _lang")
    got = {(r.doc_id, r.base_failed, r.kept) for r in quality_rules.judge(docs).collect()}
    assert got == {(n, False, True) for n in range(150)} | {(200, False, False), (201, True, False), (202, True, False), (203, True, False),
                                                             (204, False, True), (None, False, True)}
    assert quality_rules.judge(docs.where("false")).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    good = lambda: " ".join(rng.choice(["the", "of", "house", "tree", "Runs", "over."]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["BUY", "NOW!!", "$$$", "||", "click"]) for _ in range(40))
    rows = [(n, good() if n % 3 else bad()) for n in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as label", "2 as score", "3 as id")
    labels = spark.createDataFrame([(n, int(n % 3 > 0)) for n in range(240)] + [(None, 1), (5, None), (999, 0)], "doc_id bigint, quality int")
    return docs, labels


def test_score_tells_classes_apart_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    model = quality_classifier.fit(docs, labels)
    out = quality_classifier.score(docs, model).withColumn("h", quality_classifier.held_out(F.col("doc_id"))).collect()
    import zlib
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.h]
    assert held and all((r.score >= 0.5) == (r.doc_id % 3 > 0) for r in held)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x " * 50000)], "doc_id bigint, text string")
    assert all(0 <= r.score <= 1 for r in quality_classifier.score(odd, model).collect())
    assert quality_classifier.score(odd.where("false"), model).count() == 0
    nothing = quality_classifier.fit(docs, labels.where("false"))
    assert {r.score for r in quality_classifier.score(odd, nothing).collect()} == {0.5}


def test_sample_is_bounded_and_never_held_out(labelled):
    chosen = quality_classifier.sample_of(labelled[1], sample=50)
    assert chosen.count() == 50
    assert chosen.where(quality_classifier.held_out(F.col("id"))).count() == 0


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(60)]
    labels = np.array([int(r[0] < 4) for r in rows])
    values = [np.full(8, 1 / math.sqrt(8)) for _ in rows]
    w = quality_classifier.descend(rows, values, labels, rounds=400)

    def loss(w):
        y = np.where(labels == 1, 1.0, -1.0)
        cost = np.where(y > 0, 30 / max(1, (y > 0).sum()), 30 / max(1, (y < 0).sum()))
        margins = np.array([w[r] @ v + w[-1] for r, v in zip(rows, values)])
        return 0.5 * w @ w + (cost * np.maximum(0, 1 - y * margins)).sum()

    best = loss(w)
    for _ in range(200):
        step = np.zeros_like(w)
        step[rng.integers(0, 40, 5)] = rng.normal(0, 0.05, 5)
        step[-1] = rng.normal(0, 0.05)
        assert loss(w + step) > best - 1e-3
