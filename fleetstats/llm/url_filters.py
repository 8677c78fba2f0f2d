"""URL rules, and block decisions that follow redirects and canonical links.

Rules name a host and the start of a path; they hold for the host and its subdomains, and
the longest that fits wins. Pages that redirect to each other or name each other as
canonical are one page under several addresses: the connected components of those edges.
A block of one address holds for all addresses of its component that no rule names; an
address with a rule of its own keeps that rule's verdict, so an explicit allow comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from .common import components, settle

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = T.StructType([T.StructField(n, T.StringType(), False) for n in ("verdict", "host", "path")])
#: The address inside a tag found by LINKS: after the attribute, with or without quotes.
LINKS = {
    "canonical": (r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"),
    "refresh": (r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", r"(?i)\burl\s*=\s*[\"']?([^\"'\s>;]+)"),
}


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """What tells two addresses apart: host, path and query, without scheme and fragment."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a_url, b_url): each page with all its canonical links and redirects, absolute."""
    url, html = pages[url_col], pages[html_col]
    found = [F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, where, 1))
             for tag, where in LINKS.values()]
    made = pages.select(url.alias("a_url"), F.explode(F.concat(*found)).alias("to")).where("`to` <> ''")
    scheme = F.substring_index("a_url", "://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(F.col("a_url")))
    folder = F.regexp_extract(path_of(F.col("a_url")), "^(.*/)?", 0)
    to = F.regexp_replace("to", "&amp;", "&")
    return made.where("instr(a_url, '://') > 0").select("a_url", F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.startswith("/"), F.concat(site, to))
        .when(to.startswith("#") | to.startswith("?"), F.concat(site, path_of(F.col("a_url")), to))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), to)).alias("b_url"))


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with _host, _path) and their longest fitting rule: _rule, _verdict, null if none.

    Rules are looked up by the host's endings, once for each distinct host; what a host
    brings along is the rules that fit it. Of two rules as long, allow wins.
    """
    labels = F.split("_host", "\\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.select("_host").distinct().select("_host", F.explode(endings).alias("ending"))
    # written down, so that the join shuffles both sides and can split a large host
    of_host = settle(hosts.join(rules.withColumnRenamed("host", "ending"), "ending")
               .groupBy("_host").agg(F.collect_set(F.struct(
                   F.length(F.concat("ending", "path")).alias("long"),
                   (F.col("verdict") == "allow").alias("allow"),
                   F.concat("ending", "path").alias("rule"), "path", "verdict")).alias("_rules")), "url-hosts")
    path = F.coalesce("_path", F.lit(""))
    best = F.array_max(F.filter("_rules", lambda r: path.startswith(r["path"])))
    return (urls.join(of_host, "_host", "left").withColumn("_best", best)
            .withColumn("_rule", F.col("_best.rule")).withColumn("_verdict", F.col("_best.verdict"))
            .drop("_rules", "_best"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, id_col: str = "page_id",
          url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, inherited) of every row.

    Rules are (verdict, host, path). Null urls and those without ``://`` have an empty host
    and path, fit no rule and are allowed; a null page has no links. Repeated rows are judged
    each. Other columns are ignored. ``inherited`` tells a verdict that came along an alias.
    """
    spark = pages.sparkSession
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, RULES)
    base = pages.select(pages[id_col].alias("_id"), pages[url_col].alias("_url"))
    edges = settle(links(pages, url_col, html_col).select(
        "a_url", "b_url", address(F.col("a_url")).alias("a"), address(F.col("b_url")).alias("b")),
        "url-links")
    group = components(edges.select("a", "b"), "url-aliases")
    ends = edges.select(F.col("a").alias("node"), F.col("a_url").alias("_url")).union(
        edges.select("b", "b_url")).where("node is not null")
    marked = ruled(ends.select("node", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"))
                   .distinct(), table)
    blocked = (group.join(marked.where("_verdict = 'block'").select("node").distinct(), "node")
               .select("component").distinct().withColumn("_hit", F.lit(True)))
    aliases = group.join(blocked, "component").select(F.col("node").alias("_node"), "_hit")
    own = ruled(base.select("_id", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"),
                            address(F.col("_url")).alias("_node")), table)
    return own.join(aliases, "_node", "left").select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_rule").alias("rule"),
        F.when(F.col("_verdict").isNotNull(), F.col("_verdict"))
        .when(F.col("_hit"), "block").otherwise("allow").alias("verdict"),
        (F.col("_verdict").isNull() & F.coalesce("_hit", F.lit(False))).alias("inherited"))
