"""The main text of web pages.

A page becomes blocks: the text between block-level tags, each with the path of tags and
classes above it. All blocks of a host's pages are one sequence, and a suffix array finds
the runs that stand on several pages: these are boilerplate, block by block. What is unique
stays. Markup overrules this both ways: menus, headers, footers, asides, forms, scripts and
the like go though unique, and an article stays though its sentences recur. A page with an
article is its article, whatever stands around it.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter

from pyspark.sql import DataFrame, Window, functions as F

from .common import mapped, release, settle
from .line_dedup import suffix_array
from .url_filters import host_of

#: Elements without running text, and elements around the main text.
CHROME = frozenset((
    "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "button",
    "select", "textarea", "dialog", "head", "title", "menu", "canvas", "object", "audio", "video"))
CHROME_ROLES = frozenset((
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu"))
CHROME_NAMES = frozenset((
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "sidebar", "widget",
    "cookie", "cookies", "consent", "gdpr", "notice", "newsletter", "subscribe", "popup", "modal", "overlay", "comment",
    "comments", "disqus", "replies", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer",
    "share", "social", "related", "pagination", "pager", "login", "search"))
MAIN = frozenset(("article", "main"))
INLINE = frozenset((
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub",
    "sup", "time", "tt", "u", "var", "wbr"))
VOID = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noscript", "xmp"))
#: Elements that a start tag closes when it comes inside them.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
          "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that leave a head open.
IN_HEAD = frozenset(("base", "basefont", "bgsound", "head", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"))

# a quote only opens a value after an equals sign; possessive, so that no tag is read twice
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?)*+)>", re.S)
_COMMENT = re.compile(r"<!--.*()()()", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?)?")
#: Paths longer than this go on from their digest, so that deep nesting costs no more.
_LONG_PATH = 1000
#: A run of blocks is long enough to tell from this many words.
LONG_WORDS = 4
#: Distinct pages of its host that a block must stand on to be part of a run.
PAGES = 2


def _kind(tag: str, attributes: str, in_main: bool) -> tuple[str, str]:
    """(chrome by element, named so by class, main or empty; label for the path) of an element."""
    found: dict[str, str] = {}
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            # of an attribute given twice the first counts
            found.setdefault(name.lower(), "".join(values))
    label = tag + "".join("." + c for c in found.get("class", "").split())
    names = {x.lower() for x in (*found.get("class", "").split(), found.get("id", ""))}
    role = found.get("role", "").lower()
    if tag in CHROME or (tag == "header" and not in_main) or role in CHROME_ROLES or "hidden" in found:
        return "chrome", label
    if names & CHROME_NAMES and tag not in ("html", "body"):
        return "named", label
    if tag in MAIN or role == "main" or found.get("itemprop") == "articleBody":
        return "main", label
    return "", label


def blocks(page: str | None) -> list[tuple[str, str, str]]:
    """(role, path, text) of every block with text: role is main, open, named or chrome."""
    page = page or ""
    stack: list[tuple[str, str, str]] = []
    roles, tags = Counter(), Counter()
    out: list[tuple[str, str, str]] = []
    parts: list[str] = []
    where = ("open", "")

    def settle_block() -> None:
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append((*where, text))
            parts.clear()

    def push(tag: str, role: str, label: str) -> None:
        path = stack[-1][2] if stack else ""
        if tag not in INLINE:
            if len(path) > _LONG_PATH:
                path = hashlib.sha256(path.encode()).hexdigest()
            path = f"{path}/{label}" if path else label
        stack.append((tag, role, path))
        roles[role] += 1
        tags[tag] += 1

    def pop() -> None:
        tag, role, _ = stack.pop()
        roles[role] -= 1
        tags[tag] -= 1

    def place() -> tuple[str, str]:
        role = next((r for r in ("chrome", "named", "main") if roles[r]), "open")
        return role, stack[-1][2] if stack else ""

    at, last = 0, page.rfind(">")
    while True:
        # behind the last of these no tag can end, and each that begins would be looked for to the end
        m = (_TOKEN if at <= last else _COMMENT).search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at:m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        inline = tag in INLINE
        if not inline:
            settle_block()
        if m[1]:
            left = tags[tag]
            while left and tags[tag] == left:
                pop()
        else:
            if tag == "body" or (tag not in IN_HEAD and stack and stack[-1][0] == "head"):
                # the end tag of a head may be left out
                while tags["head"]:
                    pop()
            if tag in CLOSES:
                while stack and stack[-1][0] in (*CLOSES[tag], *INLINE):
                    pop()
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif tag not in VOID and not page[m.start():m.end()].endswith("/>"):
                role, label = _kind(tag, m[3], roles["main"] > 0)
                # inline elements matter where they hide what they hold
                if not inline or role:
                    push(tag, role, label)
        if not inline:
            where = place()
    settle_block()
    return out


def _placed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"),
                        F.xxhash64(F.coalesce(pages[html_col], F.lit(""))).alias("t"),
                        host_of(pages[url_col]).alias("host"))

    def run(b: dict) -> dict:
        got = [blocks(x) for x in b["html"]]
        return {k: b[k] for k in ("id", "url", "t", "host")} | {
            "blocks": [[dict(zip(("role", "path", "text"), x)) for x in page] for page in got]}

    return mapped(rows, f"id {kind}, url string, t bigint, host string, "
                        "blocks array<struct<role:string,path:string,text:string>>", run)


def boilerplate(placed: DataFrame) -> DataFrame:
    """(doc, t, i) of open blocks in runs that two or more pages of a host have, settled: doc is the host, t the page.

    Runs go through blocks of every role. Pages of a host with equal markup are one page.
    """
    each = (placed.select(F.xxhash64("host").alias("doc"), "t", "host", F.posexplode("blocks").alias("i", "b"))
            .select("doc", "t", "i", F.xxhash64("host", "b.path", "b.text").alias("h1"),
                    F.xxhash64(F.lit(1), "host", "b.path", "b.text").alias("h2"),
                    F.size(F.split("b.text", " ")).alias("words"), (F.col("b.role") == "open").alias("open")).distinct())
    each = settle(each, "html-blocks")
    # written down, so that the join shuffles both sides and can split a frequent block
    several = settle(each.groupBy("h1", "h2").agg(F.count_distinct("t").alias("pages")).where(F.col("pages") >= PAGES)
                     .select("h1", "h2", F.monotonically_increasing_id().alias("sym")), "html-several")
    repeated = settle(each.join(several, ["h1", "h2"]).drop("h1", "h2"), "html-repeated")
    release(each, several)
    # every block has a word: a run of more blocks than LONG_WORDS is covered by its stretches of so many
    array = suffix_array(repeated, LONG_WORDS)
    release(repeated)

    # neighbours in the array may be of one page, so look on to the nearest suffix of another, both ways
    slice_, every = Window.partitionBy("part").orderBy("idx"), Window.orderBy("part")
    edges = array.groupBy("part").agg(
        F.max_by(F.struct("doc", "t"), "idx").alias("last"), F.min_by("lcp", "idx").alias("first")).select(
        "part", F.lag("last").over(every).alias("last"), F.lead("first").over(every).alias("first"))
    sided = settle(
        array.withColumn("prev", F.lag(F.struct("doc", "t")).over(slice_)).withColumn("after", F.lead("lcp").over(slice_))
        .join(edges, "part").withColumn("prev", F.coalesce("prev", "last")).withColumn("turn", F.when(
            (F.col("doc") == F.col("prev.doc")) & (F.col("t") == F.col("prev.t")), 0).otherwise(1).cast("long"))
        .select("doc", "t", "i", "part", "idx", "lcp", F.coalesce("after", "first", F.lit(0)).alias("after"), "turn",
                "words", "open"), "html-sides")
    release(array)
    turns = sided.groupBy("part").agg(F.sum("turn").alias("n"))
    earlier = turns.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))
    stretch = F.sum("turn").over(Window.partitionBy("part").orderBy("idx")) + F.col("earlier")
    same = Window.partitionBy("stretch").orderBy("idx")
    runs = (sided.join(earlier, "part").withColumn("stretch", stretch)
            .select("doc", "t", "i", "words", "open", F.greatest(
                F.min("lcp").over(same.rowsBetween(Window.unboundedPreceding, 0)),
                F.min("after").over(same.orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0))).alias("run"))
            .where("run > 0"))

    page = Window.partitionBy("doc", "t").orderBy("i")
    length = sum((F.when(F.col("run") > k, F.lead("words", k).over(page)).otherwise(0) for k in range(1, LONG_WORDS)),
                 F.col("words"))
    seen = runs.withColumn("length", length)
    reach = F.max(F.when(F.col("length") >= LONG_WORDS, F.col("i") + F.col("run"))).over(
        page.rowsBetween(Window.unboundedPreceding, 0))
    found = settle(seen.withColumn("reach", reach).where("reach > i and open").select("doc", "t", "i"), "html-boilerplate")
    release(sided)
    return found


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_dropped) of every row.

    Null and empty pages have an empty text. Character references are decoded, white space
    in a block becomes single spaces, and blocks follow each other after one space. A page
    is its article or, if it has none, all blocks that are neither named as boilerplate by
    their markup nor part of a run that other pages of the host have. Pages without a host form
    one host. Repeated rows get the same result each; pages of any length are read whole;
    other columns are ignored.
    """
    placed = settle(_placed(pages, id_col, url_col, html_col), "html-placed")
    found = boilerplate(placed)
    gone = found.groupBy("doc", "t").agg(F.collect_set("i").alias("gone"))
    columns = ["id", "url", "blocks"]
    # pages that markup settles need no verdict
    asks = F.exists("blocks", lambda b: b["role"] == "open") & ~F.exists("blocks", lambda b: b["role"] == "main")
    asked = (placed.where(asks).withColumn("doc", F.xxhash64("host")).join(gone, ["doc", "t"], "left")
             .select(*columns, F.coalesce("gone", F.array().cast("array<int>")).alias("gone")))
    both = placed.where(~asks).select(*columns, F.array().cast("array<int>").alias("gone")).union(asked)
    both = both.withColumn("article", F.exists("blocks", lambda b: b["role"] == "main")).withColumn("kept", F.filter(
        "blocks", lambda b, n: F.when(F.col("article"), b["role"] == "main").otherwise(
            (b["role"] == "open") & ~F.array_contains("gone", n))))
    text = F.array_join(F.transform("kept", lambda b: b["text"]), " ")
    return both.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text"),
        F.length(text).cast("long").alias("n_chars"), F.size("blocks").cast("long").alias("n_blocks"),
        (F.size("blocks") - F.size("kept")).cast("long").alias("n_dropped"))
