"""Quality rules whose thresholds follow from the data, by language and source.

Counts of each text become ratios in thousandths. A quantile sketch of every ratio is kept
for every (language, source): counts of logarithmic buckets with 32 steps to each doubling,
so a quantile is at most 1/32 too low. Sketches merge by adding counts, which aggregation
does before the shuffle; the result is the same in whatever order rows arrive. A text is
rejected where a ratio lies beyond its group's quartile by three times the distance of the
quartiles. Only built-in functions run; no text leaves the row it is in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACES, lines, settle, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Ratio: (numerator, denominator, factor, least spread, whether low values are rejected too).
RATIOS = {
    "symbols": ("n_symbols", "word_chars", 1000, 20, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 200, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 100, False),
    "word_length": ("word_chars", "n_words", 100, 60, True),
}
#: Quartile distances between the quartile and the limit.
REACH = 3
#: Groups with fewer texts use the merged sketch of their language, or of all texts.
LEAST = 100


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once, also where lambdas inside use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """How many words of a word array lie in runs of ``window`` words that it has twice or more."""
    def found(hashes: Column) -> Column:
        def starts(at: Column) -> Column:
            same = lambda s, i: (
                ((i > 0) & (F.get(at, i - 1)["h"] == s["h"]))
                | ((i < F.size(at) - 1) & (F.get(at, i + 1)["h"] == s["h"])))
            return F.array_sort(F.transform(F.filter(at, same), lambda s: s["i"]))

        ordered = F.array_sort(F.transform(
            hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        covered = F.aggregate(
            let(ordered, starts), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, p: F.struct(
                (acc["n"] + p + window - F.greatest(acc["end"], p)).alias("n"),
                (p + window).alias("end")),
            lambda acc: acc["n"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered)

    def whole(v: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(v) - (window - 1)),
                             lambda i: F.xxhash64(F.slice(v, i, window)))
        return F.when(F.size(v) < window, F.lit(0)).otherwise(let(hashes, found))

    return let(w, whole)


def counts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the counts of every text; null and empty texts count nothing."""
    text = docs[text_col]
    full = F.filter(lines(text), lambda x: F.trim(x, F.lit(SPACES)) != "")
    parts = docs.select(*[docs[c] for c in keep], words(text).alias("_w"), full.alias("_l"))

    def numbers(w: Column) -> Column:
        def chars(joined: Column) -> Column:
            return F.struct(
                F.length(joined).cast("long").alias("word_chars"),
                (F.length(joined) - F.length(F.translate(joined, SYMBOLS, ""))).cast("long").alias("n_symbols"))

        return let(F.array_join(w, ""), chars)

    made = parts.select(
        *keep, F.size("_w").cast("long").alias("n_words"), numbers(F.col("_w")).alias("_n"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w")).cast("long").alias("n_repeat_words"))
    return made.select(*keep, "n_words", "_n.word_chars", "_n.n_symbols", "n_lines",
                       "n_dup_lines", "n_repeat_words")


def bucket(v: Column) -> Column:
    """The sketch's bucket of a whole number from 0: itself below 64, then 32 to each doubling."""
    e = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(32 * (e + 1) + F.call_function("shiftright", v, e.cast("int")) - 32)


def floor_of(b: Column) -> Column:
    """The smallest number of a bucket."""
    e = (F.floor((b - 64) / 32) + 1).cast("int")
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", (b - 64) % 32 + 32, e))


def sketches(counted: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by..., ratio, bucket, n): one mergeable sketch of each ratio for each group."""
    ratio = [
        F.struct(F.lit(name).alias("ratio"),
                 F.floor(factor * F.col(a) / F.col(b)).cast("long").alias("v"))
        for name, (a, b, factor, _, _) in RATIOS.items()]
    return (counted.where("n_words > 0").select(*by, F.explode(F.array(*ratio)).alias("r"))
            .groupBy(*by, F.col("r.ratio").alias("ratio"), bucket(F.col("r.v")).alias("bucket"))
            .agg(F.count("*").alias("n")))


def merged(sketch: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Sketches of coarser groups, by adding counts."""
    return sketch.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by..., n_texts, <ratio>_low, <ratio>_high): what a sketch allows, one row a group."""
    group = Window.partitionBy(*by, "ratio")
    run = sketch.select(
        "*", F.sum("n").over(group).alias("all"),
        F.sum("n").over(group.orderBy("bucket")).alias("upto"))
    q = run.groupBy(*by, "ratio").agg(
        F.max("all").alias("all"),
        F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("bucket"))).alias("b1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("bucket"))).alias("b3"),
    ).select(*by, "ratio", "all", floor_of(F.col("b1")).alias("q1"), floor_of(F.col("b3")).alias("q3"))
    columns = [F.max("all").alias("n_texts")]
    for name, (_, _, _, least, low) in RATIOS.items():
        mine = F.col("ratio") == name
        spread = REACH * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        columns.append(F.max(F.when(mine, F.col("q3") + spread)).alias(f"{name}_high"))
        if low:
            columns.append(F.max(F.when(mine, F.col("q1") - spread)).alias(f"{name}_low"))
    return q.groupBy(*by).agg(*columns)


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          id_col: str = "doc_id", least_words: int = 20, most_repeats: int = 30) -> DataFrame:
    """One row for every row: counts, the base rules' failure, and whether to keep the text.

    A null language or source is a group of its own. Texts without words fail the base
    rules. Repeated rows are counted and judged each. Other columns are ignored.
    """
    named = docs.select(
        docs[id_col].alias("doc_id"), docs[text_col].alias("text"),
        *[F.coalesce(F.concat(F.lit("="), docs[c].cast("string")), F.lit("null")).alias(n)
          for c, n in ((lang_col, "_lang"), (source_col, "_source"))])
    counted = settle(counts(named, keep=("doc_id", "_lang", "_source")), "quality-counts")
    sketch = settle(sketches(counted, ("_lang", "_source")), "quality-sketches")
    own = limits(sketch, ("_lang", "_source"))
    names = [c for c in own.columns if c.endswith(("_high", "_low"))]
    of_lang = limits(merged(sketch, ("_lang",)), ("_lang",))
    of_all = limits(merged(sketch.withColumn("_all", F.sign("n")), ("_all",)), ("_all",))

    def under(df: DataFrame, mark: str, *keys: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(f"{mark}{c}") for c in ("n_texts", *names)])

    level = (under(own, "a_", "_lang", "_source").join(under(of_lang, "b_", "_lang"), "_lang")
             .withColumn("_all", F.sign("a_n_texts")).join(under(of_all, "c_", "_all"), "_all"))
    chosen = level.select("_lang", "_source", *[
        F.when(F.col("a_n_texts") >= LEAST, F.col(f"a_{c}"))
        .when(F.col("b_n_texts") >= LEAST, F.col(f"b_{c}")).otherwise(F.col(f"c_{c}")).alias(c)
        for c in names])
    broken = F.lit(False)
    for name, (a, b, factor, _, low) in RATIOS.items():
        v = F.floor(factor * F.col(a) / F.col(b))
        broken = broken | (v > F.col(f"{name}_high"))
        if low:
            broken = broken | (v < F.col(f"{name}_low"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    return (counted.join(chosen, ["_lang", "_source"], "left")
            .withColumn("base_failed", failed)
            .select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", "base_failed",
                    F.when(F.col("base_failed"), False)
                    .otherwise(~F.coalesce(broken, F.lit(False))).alias("kept")))
