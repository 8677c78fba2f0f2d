"""The operators over the given tables, and their SQL where it can be said in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    byte_bpe, decontaminate, html_text, line_dedup, neighbours, ngram_join, periodic_runs, quality_classifier,
    quality_rules, spelling_variants, substring_dedup, token_counts, url_filters,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes they decode to, as digests."""
    return byte_bpe.digests(table(spark, sf_dir, "documents"))


#: The rules of the url query.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


@query
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url, by rules and along redirects and canonical links."""
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES)


_NODE = "CASE WHEN {h} <> '' THEN {h} || {p} || regexp_extract({r}, '^[^?#]*(\\?[^#]*)?', 1) END"
_HOST = "translate(regexp_extract({r}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract({r}, '^[^/?#]*([^?#]*)', 1)"
_REST = "CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"

ORACLES["op8_url_filters"] = f"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES
  {", ".join(str(r) for r in URL_RULES)}),
p AS (SELECT page_id, url, html, {_REST.format(u="url")} AS r FROM pages),
q AS (SELECT *, {_HOST.format(r="r")} AS h, {_PATH.format(r="r")} AS pa FROM p),
tags AS (
  SELECT *, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?i)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'),
      lambda x: regexp_extract(x, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?i)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'),
      lambda x: regexp_extract(x, '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>;]+)', 1)))) AS raw
  FROM q WHERE instr(url, '://') > 0),
ends AS (
  SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
      WHEN t LIKE '//%' THEN split_part(url, '://', 1) || ':' || t
      WHEN t LIKE '/%' THEN split_part(url, '://', 1) || '://' || h || t
      WHEN t LIKE '#%' OR t LIKE '?%' THEN split_part(url, '://', 1) || '://' || h || pa || t
      ELSE split_part(url, '://', 1) || '://' || h
        || CASE WHEN pa = '' THEN '/' ELSE regexp_extract(pa, '^(.*/)?') END || t END AS target
  FROM (SELECT *, replace(raw, '&amp;', '&') AS t FROM tags WHERE raw <> '')),
seen AS (SELECT DISTINCT u, {_REST.format(u="u")} AS r
  FROM (SELECT url AS u FROM pages UNION SELECT target FROM ends)),
parts AS (SELECT *, {_HOST.format(r="r")} AS h, {_PATH.format(r="r")} AS pa FROM seen),
named AS (SELECT *, {_NODE.format(h="h", p="pa", r="r")} AS node FROM parts),
ruled AS (
  SELECT n.u, n.h, n.pa, n.node, b.rule, b.verdict
  FROM named n LEFT JOIN LATERAL (
    SELECT host || path AS rule, verdict FROM rules
    WHERE (n.h = host OR n.h LIKE '%.' || host) AND starts_with(n.pa, path)
    ORDER BY length(host || path) DESC, verdict LIMIT 1) b ON true),
edges AS (
  SELECT DISTINCT a.node AS a, b.node AS b FROM ends e JOIN named a ON a.u = e.url JOIN named b ON b.u = e.target
  WHERE a.node IS NOT NULL AND b.node IS NOT NULL),
spread(node) AS (
  SELECT node FROM ruled WHERE verdict = 'block' AND node IN (SELECT a FROM edges UNION SELECT b FROM edges)
  UNION SELECT CASE WHEN e.a = s.node THEN e.b ELSE e.a END
  FROM spread s JOIN edges e ON e.a = s.node OR e.b = s.node)
SELECT p.page_id, coalesce(r.h, '') AS host, coalesce(r.pa, '') AS path, r.rule,
  CASE WHEN r.verdict IS NOT NULL THEN r.verdict WHEN s.node IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  r.verdict IS NULL AND s.node IS NOT NULL AS inherited
FROM pages p LEFT JOIN ruled r ON r.u = p.url LEFT JOIN (SELECT DISTINCT node FROM spread) s ON s.node = r.node
"""


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, with thresholds by language and source."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def _quality_sql() -> str:
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    bucket = "CASE WHEN v < 64 THEN v ELSE 32 * (length(bin(v)) - 5) + (v >> (length(bin(v)) - 6)) - 32 END"
    floor = "CASE WHEN {b} < 64 THEN {b} ELSE (({b} - 64) % 32 + 32) << (({b} - 64) // 32 + 1)::BIGINT END"
    ratios = quality_rules.RATIOS
    each = ", ".join(f"{{'ratio': '{n}', 'v': {f} * {a} // {b}}}" for n, (a, b, f, _, _) in ratios.items())
    least = " ".join(f"WHEN '{n}' THEN {s}" for n, (_, _, _, s, _) in ratios.items())
    broken = " OR ".join(
        f"(ratio = '{n}' AND (v > high{' OR v < low' if low else ''}))" for n, (_, _, _, _, low) in ratios.items())
    level = """
{name}_run AS (SELECT {by}, ratio, bucket, sum(sum(n)) OVER (PARTITION BY {by}, ratio ORDER BY bucket) AS upto,
  sum(sum(n)) OVER (PARTITION BY {by}, ratio) AS total FROM sketch GROUP BY {by}, ratio, bucket),
{name}_q AS (SELECT {by}, ratio, max(total) AS total, min(bucket) FILTER (4 * upto >= total) AS b1,
  min(bucket) FILTER (4 * upto >= 3 * total) AS b3 FROM {name}_run GROUP BY {by}, ratio),
{name} AS (SELECT {by}, ratio, total, q1 - 3 * greatest(q3 - q1, least) AS low, q3 + 3 * greatest(q3 - q1, least) AS high
  FROM (SELECT *, {q1} AS q1, {q3} AS q3, CASE ratio {least} END AS least FROM {name}_q)),"""
    levels = "".join(level.format(name=n, by=by, q1=floor.format(b="b1"), q3=floor.format(b="b3"), least=least)
                     for n, by in (("own", "lang, source"), ("of_lang", "lang"), ("of_all", "everything")))
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
    coalesce('=' || lang, 'null') AS lang, coalesce('=' || source, 'null') AS source FROM documents),
w AS (SELECT k, list_filter(string_split_regex(trim(text, {spaces}), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: trim(x, {spaces}) <> '') AS l FROM d),
win AS (SELECT k, i, list_slice(w, i, i + 7) AS g FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c > 1),
cover AS (SELECT k, count(DISTINCT i + j) AS n FROM twice, range(8) r(j) GROUP BY k),
c AS (SELECT d.k, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(array_to_string(w, '')) - length(translate(array_to_string(w, ''), '#*$%&|<>', '')) AS n_symbols,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words
  FROM d JOIN w USING (k) LEFT JOIN cover USING (k)),
each AS (SELECT k, lang, source, 1 AS everything, unnest([{each}], recursive := true) FROM c WHERE n_words > 0),
sketch AS (SELECT lang, source, everything, ratio, {bucket} AS bucket, count(*) AS n FROM each GROUP BY ALL),{levels}
bad AS (SELECT DISTINCT k FROM (
  SELECT e.k, e.ratio, e.v,
    CASE WHEN a.total >= 100 THEN a.low WHEN b.total >= 100 THEN b.low ELSE z.low END AS low,
    CASE WHEN a.total >= 100 THEN a.high WHEN b.total >= 100 THEN b.high ELSE z.high END AS high
  FROM each e JOIN own a USING (lang, source, ratio) JOIN of_lang b USING (lang, ratio) JOIN of_all z USING (ratio))
  WHERE {broken})
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND k NOT IN (SELECT k FROM bad) AS kept
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
"""


ORACLES["op10_quality_rules"] = _quality_sql()


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).select(
        "doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in documents, within the edit budget."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share nine tenths of their three-word shingles."""
    found = ngram_join.groups(table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return found.select("doc_id", F.col("n_grams").alias("n_shingles"), "component_id")


ORACLES["op7_ngram_join"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(
    list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) END AS s FROM w),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
n AS (SELECT doc_id, len(s) AS n FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.b) AS component_id FROM n JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that are later copies of a repeated run."""
    found = line_dedup.dedup(table(spark, sf_dir, "documents"), deleted_col="n_deleted", longest_col="longest_run", least_run_chars=20)
    return found.select("doc_id", "text", "n_deleted", "longest_run")


ORACLES["op6_line_dedup"] = """
WITH RECURSIVE raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
seq AS (
  SELECT doc_id, line, line_no, chars, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i
  FROM (SELECT *, length(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS chars FROM raw) AS r
  WHERE chars > 0),
-- the shortest stretches of 20 characters or more from each line on (1) and up to each line (-1)
upto AS (
  SELECT a.doc_id, a.i, way, k, sum(b.chars) OVER w AS chars, list(b.line) OVER w AS said
  FROM seq a, (VALUES (1), (-1)) AS ways(way), range(20) AS r(k)
  JOIN seq b ON b.doc_id = a.doc_id AND b.i = a.i + way * k
  WINDOW w AS (PARTITION BY a.doc_id, a.i, way ORDER BY k)),
shortest AS (SELECT * FROM upto WHERE chars >= 20 QUALIFY row_number() OVER (PARTITION BY doc_id, i, way ORDER BY k) = 1),
later AS (SELECT * FROM shortest QUALIFY row_number() OVER (PARTITION BY way, said ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + way * unnest(range(k + 1)) AS i FROM later),
marked AS (SELECT seq.*, gone.i IS NOT NULL AS later FROM seq LEFT JOIN gone USING (doc_id, i)),
run(doc_id, i, odoc, oi, n) AS (
  SELECT a.doc_id, a.i, b.doc_id, b.i, 1 FROM marked a JOIN marked b
  ON a.line = b.line AND (a.doc_id <> b.doc_id OR a.i <> b.i) WHERE a.later
  UNION ALL
  SELECT r.doc_id, r.i, r.odoc, r.oi, n + 1 FROM run r
  JOIN marked a ON a.doc_id = r.doc_id AND a.i = r.i + n JOIN marked b ON b.doc_id = r.odoc AND b.i = r.oi + n
  WHERE a.line = b.line),
longest AS (SELECT doc_id, max(n) AS longest_run FROM run GROUP BY doc_id),
rest AS (SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.line_no) FILTER (m.later IS NOT TRUE) AS text,
    count(*) FILTER (m.later) AS n_deleted
  FROM raw r LEFT JOIN marked m USING (doc_id, line_no) GROUP BY r.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(rest.text, '') END AS text,
  coalesce(n_deleted, 0)::BIGINT AS n_deleted, coalesce(longest_run, 0)::BIGINT AS longest_run
FROM documents d LEFT JOIN rest USING (doc_id) LEFT JOIN longest USING (doc_id)
"""


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the unigram model."""
    return token_counts.count(table(spark, sf_dir, "documents"))


@query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents that are later copies, by characters."""
    found = substring_dedup.spans(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "start", "end", "n_words", F.col("first_doc").alias("first_doc_id"))


@query
def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of every document that say the same words three times or more."""
    docs = table(spark, sf_dir, "documents")
    texts = docs.select("doc_id", periodic_runs.with_repeats(docs["text"], docs["doc_id"]).alias("text"))
    return periodic_runs.report(periodic_runs.runs(texts, least=24, folds=3))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word, its neighbours by one character, and the form it is a variant of."""
    return spelling_variants.variants(table(spark, sf_dir, "documents"), least_chars=7, least_n=2, times=10, slips=31)
