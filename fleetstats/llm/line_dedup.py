"""Line runs that occur again: all copies but the first are deleted.

Each text is a sequence of line ids. Lines that occur once in all texts end a sequence, as
no repeated run can hold them, and lines that are too short to tell anything take no part.
A suffix array comes from prefix doubling that begins at HEAD lines: one sort by so many lines
settles most suffixes; where they tie and go on, round k sorts the distinct pairs of a suffix's
rank and the rank HEAD * 2^k lines on, until no rank splits any more. A suffix that is told from
all others, or equals its copies up to the end, takes no part in later rounds. Neighbours' longest common
prefixes come from their heads and the ranks of all rounds, longest step first. Where these stay at
or above the least length, suffixes form one interval: the copies of one run. Its first
position, by document id and line, keeps its lines.

All of it is joins, aggregation and range sorts over narrow rows; only the last join moves
texts. Ranks are positions in a sorted table: they order, but have gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACES, lines, packed, release, settle, unpacked, whole_number
from .quality_rules import let

_KEY = ["doc", "t"]
#: Lines that suffixes are sorted by at once.
HEAD = 8


def _order(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with ``at``: 64-bit numbers that grow with the keys, written down as they are not repeatable."""
    return settle(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                  .withColumn("at", F.monotonically_increasing_id()), "lines-order")


def positions(docs: DataFrame, id_col: str, text_col: str, least_chars: int, chars: bool = False) -> DataFrame:
    """(doc, t, i, line_no, h1, h2): the i-th counting line of each document, and its id as two hashes.

    With ``chars``, also its characters without white space around.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    counted = F.filter(
        F.transform(lines(docs[text_col]), lambda x, n: F.struct(n.alias("line_no"), x.alias("line"))),
        lambda s: F.length(F.trim(s["line"], F.lit(SPACES))) >= least_chars)
    return (docs.select(whole_number(docs[id_col]).alias("doc"),
                        F.xxhash64(text).alias("t"), F.posexplode(counted).alias("i", "s"))
            .select(*_KEY, "i", "s.line_no", F.xxhash64("s.line").alias("h1"),
                    F.xxhash64(F.lit(1), F.col("s.line")).alias("h2"),
                    *([F.length(F.trim("s.line", F.lit(SPACES))).alias("chars")] if chars else [])).distinct())


def _heads(repeated: DataFrame, width: int) -> DataFrame:
    """``repeated`` with the next ``width`` lines of each suffix in ``s0``, ``s1``, ...: -1 beyond its end.

    ``stretch`` tells the stretches of a text apart, ``whole`` is the lines of one, ``left`` those to its end.
    """
    text, stretch = Window.partitionBy(*_KEY).orderBy("i"), Window.partitionBy(*_KEY, "stretch")
    ahead = [F.when(F.lead("i", k).over(text) == F.col("i") + k, F.lead("sym", k).over(text)).otherwise(-1)
             for k in range(1, width)]
    return (repeated.select("*", (F.col("i") - F.row_number().over(text)).alias("stretch"),
                            *[x.alias(f"s{k + 1}") for k, x in enumerate(ahead)])
            .withColumnRenamed("sym", "s0")
            .withColumn("left", F.max("i").over(stretch) - F.col("i") + 1)
            .withColumn("whole", F.max("i").over(stretch) - F.min("i").over(stretch) + 1))


def _ranks(tied: DataFrame, width: int, depth: int | None) -> list[DataFrame]:
    """Rank tables (doc, t, i, left, rank, open) by ``width``, 2 ``width``, 4 ``width``, ... lines, until ranks split no more or tell ``depth`` lines.

    A rank is how many suffixes come before those that share it, so it stays comparable when others split.
    Only suffixes that share their rank and did not end are ``open``: a round pairs and sorts these, and
    the ranks of all others stand as they are.
    """
    first = [f"s{k}" for k in range(width)]
    ids = _order(tied.groupBy(*first).agg(F.count("*").alias("n")), *first)
    levels = [settle(tied.join(_before(ids), first).select(
        *_KEY, "i", "left", F.col("before").alias("rank"), ((F.col("n") > 1) & (F.col("left") >= width)).alias("open")),
        "lines-rank")]
    release(ids)
    while True:
        step = width << (len(levels) - 1)
        if depth is not None and step >= depth:
            break
        now = levels[-1]
        ahead = now.select(*_KEY, (F.col("i") - step).alias("i"), F.col("rank").alias("next"))
        # an open suffix has so many lines at least; one that ends there comes before those that go on
        pairs = (now.where("open").drop("open").join(ahead, [*_KEY, "i"], "left")
                 .withColumn("next", F.coalesce("next", F.lit(-1))))
        pairs = settle(pairs, "lines-pairs")
        keys = _order(pairs.groupBy("rank", "next").agg(F.count("*").alias("n")), "rank", "next")
        settled = keys.groupBy("rank").agg(F.count("*").alias("k")).where("k > 1").isEmpty()
        if not settled:
            placed = _before(keys)
            start = placed.groupBy("rank").agg(F.min("before").alias("start"))
            split = placed.join(start, "rank").select(
                "rank", "next", "n", (F.col("rank") + F.col("before") - F.col("start")).alias("to"))
            moved = pairs.join(split, ["rank", "next"]).select(
                *_KEY, "i", "left", F.col("to").alias("rank"), ((F.col("n") > 1) & (F.col("left") >= 2 * step)).alias("open"))
            levels.append(settle(now.where("not open").union(moved), "lines-rank"))
        release(pairs, keys)
        if settled:
            break
    return levels


def _before(sorted_: DataFrame) -> DataFrame:
    """Rows of ``_order`` with ``before``: the sum of ``n`` over all rows before, whichever task sorted them."""
    cut = sorted_.withColumn("part", F.expr("shiftright(at, 33)"))
    # one row for each task of the sort
    shift = cut.groupBy("part").agg(F.sum("n").alias("all")).select(
        "part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("shift"))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return (cut.withColumn("upto", upto).join(shift, "part")
            .withColumn("before", F.col("shift") + F.col("upto") - F.col("n")).drop("at", "part", "upto", "shift"))


def _shared(mine: list[Column], other: list[Column]) -> Column:
    """How many lines two heads share from their first on."""
    n = F.lit(len(mine))
    for k in reversed(range(len(mine))):
        n = F.when((mine[k] == other[k]) & (mine[k] != -1), n).otherwise(k)
    return n


def suffix_array(repeated: DataFrame, depth: int | None = None) -> DataFrame:
    """(doc, t, i, part, idx, lcp): suffixes in order, and the lines each shares with the one before; settled.

    ``repeated`` has (doc, t, i, h1, h2) of lines that occur twice or more; a suffix ends
    before the first line that is missing there. With ``depth``, order and common prefixes
    look at that many lines of each suffix, for callers that ask nothing about longer ones.
    A number ``sym`` for each distinct line is taken if it is there, else made here; where
    ``asks`` is false, no suffix begins. Further columns are kept.

    One sort by the first ``HEAD`` lines settles most suffixes. Only stretches of text with
    suffixes that tie there and go on take the rounds of doubling, from that length on.
    """
    width = HEAD if depth is None else min(HEAD, depth)
    head = [f"s{k}" for k in range(width)]
    rest = [c for c in repeated.columns if c not in (*_KEY, "i", "h1", "h2", "sym", "asks")]
    ids = None
    if "sym" not in repeated.columns:
        ids = _order(repeated.select("h1", "h2").distinct(), "h1", "h2")
        repeated = repeated.join(ids, ["h1", "h2"]).withColumnRenamed("at", "sym")
    asks = F.col("asks") if "asks" in repeated.columns else F.lit(True)
    heads = settle(_heads(repeated.select(*_KEY, "i", "sym", asks.alias("asks"), *rest), width), "lines-heads")
    release(*[ids] if ids else [])

    tied, levels = None, []
    deeper = F.col("asks") & (F.col("left") > width)
    if depth is None or depth > width:
        equal = settle(heads.where(deeper).groupBy(*head).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "lines-equal")
        if not equal.isEmpty():
            long = heads.where(F.col("whole") > width).select(*_KEY, "i", "stretch", "left", "asks", *head)
            theirs = settle(long.where(deeper).join(equal, head).select(*_KEY, "stretch").distinct(), "lines-stretches")
            tied = settle(long.join(theirs, [*_KEY, "stretch"], "left_semi").select(*_KEY, "i", "left", *head), "lines-tied")
            release(theirs)
            levels = _ranks(tied, width, depth)
        release(equal)
    suffixes = heads.where("asks").select(*_KEY, "i", "left", *head, *rest, F.lit(-1).cast("long").alias("deep"))
    if levels:
        beyond = (heads.where(deeper).join(levels[-1].select(*_KEY, "i", "rank"), [*_KEY, "i"], "left")
                  .select(*_KEY, "i", "left", *head, *rest, F.coalesce("rank", F.lit(-1)).alias("deep")))
        suffixes = suffixes.where(F.col("left") <= width).unionByName(beyond)
    sorted_ = _order(suffixes, *head, "deep", *_KEY, "i")
    release(heads)

    cut = sorted_.withColumn("part", F.expr("shiftright(at, 33)")).withColumn("row", F.expr("at & 8589934591L"))
    me = F.struct(*_KEY, "i", "left", *head)
    # one row for each task of the sort
    every = Window.orderBy("part")
    edges = cut.groupBy("part").agg(F.count("*").alias("n"), F.max_by(me, "row").alias("last")).select(
        "part", (F.sum("n").over(every) - F.col("n")).alias("before"), F.lag("last").over(every).alias("edge"))
    paired = (cut.withColumn("prev", F.lag(me).over(Window.partitionBy("part").orderBy("row")))
              .join(edges, "part").withColumn("prev", F.coalesce("prev", "edge"))
              .withColumn("lcp", F.when(F.col("prev").isNull(), 0).otherwise(
                  _shared([F.col(s) for s in head], [F.col(f"prev.{s}") for s in head])))
              .withColumn("idx", F.col("before") + F.col("row")))
    columns = [*_KEY, "i", "part", "idx", "lcp", *rest]
    if not levels:
        array = settle(paired.select(*columns), "lines-array")
        release(sorted_)
        return array
    found = settle(paired.select(*columns, "left", *[F.col(f"prev.{c}").alias(f"p{c}") for c in (*_KEY, "i", "left")]),
                   "lines-paired")
    release(sorted_)
    on = F.coalesce((F.col("lcp") == width) & (F.col("left") > width) & (F.col("pleft") > width), F.lit(False))
    pairs, shared = found.where(on).withColumn("l", F.lit(0)), []
    for k in reversed(range(len(levels))):
        # ranks that split no more, or tell all that is asked: the rest is equal too, or does not count
        step = F.lit(width << k) if k < len(levels) - 1 else F.col("left")
        same = F.when(F.col("rank") == F.col("prank"), step).otherwise(0)
        pairs = _beside(pairs, levels[k], ["rank"]).withColumn("l", F.col("l") + same).drop("rank", "prank")
        done, pairs = shared, settle(pairs, "lines-common")
        release(*done, levels[k])
        shared = [pairs]
    within = _shared([F.col(s) for s in head], [F.col(f"p{s}") for s in head])
    ends = ["l", "left", "pleft"] if depth is None else ["l", "left", "pleft", F.lit(depth)]
    common = (_beside(pairs, tied, head).withColumn("l", F.col("l") + within)
              .withColumn("lcp", F.least(*ends).cast("int")).select(*columns))
    array = settle(found.where(~on).select(*columns).unionByName(common), "lines-array")
    release(tied, found, *shared)
    return array


def _beside(pairs: DataFrame, what: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with ``columns`` of ``what`` at both suffixes, ``l`` lines on; those of the one before begin with p."""
    mine = what.select(*_KEY, F.col("i").alias("on"), *columns)
    other = what.select(*[F.col(c).alias(f"p{c}") for c in _KEY], F.col("i").alias("pon"),
                        *[F.col(c).alias(f"p{c}") for c in columns])
    return (pairs.withColumn("on", F.col("i") + F.col("l")).withColumn("pon", F.col("pi") + F.col("l"))
            .join(mine, [*_KEY, "on"], "left").join(other, ["pdoc", "pt", "pon"], "left").drop("on", "pon"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_lines: int = 1,
           least_chars: int = 20) -> DataFrame:
    """(doc, t, line_no, run): lines to delete, and how long the longest repeated run from there is.

    A line goes where it lies in a run of ``least_lines`` lines or more whose first copy is
    elsewhere before it. Line numbers count from 0. ``doc`` is the id, the largest number for
    null; ``t`` is the text's hash.
    """
    all_lines = settle(positions(docs, id_col, text_col, least_chars), "lines-all")
    # written down, so that the joins shuffle both sides and can split a frequent line
    twice = settle(all_lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "lines-twice")
    repeated = settle(all_lines.join(twice, ["h1", "h2"]), "lines-repeated")
    release(all_lines, twice)
    array = suffix_array(repeated)

    # an interval is a stretch of suffixes whose lcp with the one before is long enough
    opens = (F.col("lcp") < least_lines).cast("long")
    inside = F.sum(opens).over(Window.partitionBy("part").orderBy("idx"))
    by_part = array.groupBy("part").agg(F.sum(opens).alias("n"))
    before = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    after = array.select((F.col("idx") - 1).alias("idx"), F.col("lcp").alias("after"))
    runs = (array.withColumn("inside", inside).join(before, "part").join(after, "idx", "left")
            .select(*_KEY, "i", (F.col("inside") + F.col("before")).alias("interval"),
                    F.greatest("lcp", F.coalesce("after", F.lit(0))).alias("run"))
            .where(F.col("run") >= least_lines))
    runs = settle(runs, "lines-runs")
    release(array)
    place = F.struct(*_KEY, "i")
    firsts = settle(runs.groupBy("interval").agg(F.min(place).alias("first")), "lines-firsts")
    later = runs.join(firsts, "interval").where(place != F.col("first")).select(*_KEY, "i", "run")
    covered = (later.select(*_KEY, F.explode(F.sequence(F.col("i"), F.col("i") + least_lines - 1)).alias("i"), "run")
               .groupBy(*_KEY, "i").agg(F.max("run").alias("run")))
    return covered.join(repeated.select(*_KEY, "i", "line_no"), [*_KEY, "i"]).select(*_KEY, "line_no", "run")


def _windows(repeated: DataFrame, least: int, depth: int | None) -> DataFrame:
    """(doc, t, i, line_no, n, interval, run): n lines from i have ``least`` characters, one less has not; equal ones share an interval.

    ``run`` is the longest repeated run from i, up to ``depth``. Only windows of more than one
    line are sought with a ``depth``.
    """
    text, stretch = Window.partitionBy(*_KEY).orderBy("i"), Window.partitionBy(*_KEY, "island")
    # a line that counts has a character at least, so sums grow and no window has more than ``least`` lines
    reach = stretch.orderBy("sum").rangeBetween(0, least - 1)
    sized = (repeated.withColumn("island", F.col("i") - F.row_number().over(text))
             .withColumn("sum", F.sum("chars").over(stretch.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) - F.col("chars"))
             .withColumn("n", F.when(F.max(F.col("sum") + F.col("chars")).over(reach) - F.col("sum") >= least,
                                     F.max("i").over(reach) - F.col("i") + 1)))
    asks = F.lit(True) if depth is None else F.col("n") > 1
    array = suffix_array(sized.select(*_KEY, "i", "line_no", "sym", "n", F.coalesce(asks, F.lit(False)).alias("asks")), depth)
    opens = F.coalesce(F.col("lcp") < F.col("n"), F.lit(True)).cast("long")
    cut = array.withColumn("opens", opens)
    every = Window.orderBy("part")
    edges = cut.groupBy("part").agg(F.sum("opens").alias("k"), F.min_by("lcp", "idx").alias("first")).select(
        "part", (F.sum("k").over(every) - F.col("k")).alias("before"), F.lead("first").over(every).alias("edge"))
    slice_ = Window.partitionBy("part").orderBy("idx")
    windows = settle(
        cut.withColumn("inside", F.sum("opens").over(slice_)).withColumn("after", F.lead("lcp").over(slice_))
        .join(edges, "part").select(
            *_KEY, "i", "line_no", "n", (F.col("inside") + F.col("before")).alias("interval"),
            F.greatest("lcp", F.coalesce("after", "edge", F.lit(0))).alias("run")), "lines-windows")
    release(array)
    return windows


def long_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_run_chars: int = 20) -> DataFrame:
    """``copies`` with the minimum on the run: every line with a word counts, and a run's lines have so many characters.

    A line goes where it lies in such a run whose first copy is elsewhere before it. Shortest
    windows that are long enough, from each line on and, on the reversed lines, up to each
    line, make up every such run from end to end. A line that is long enough alone is the same
    window both ways, so on the reversed lines only suffixes that begin with other lines are sorted.
    """
    all_lines = settle(positions(docs, id_col, text_col, 1, chars=True), "lines-all")
    twice = settle(all_lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
                   .select("h1", "h2", F.monotonically_increasing_id().alias("sym")), "lines-twice")
    repeated = settle(all_lines.join(twice, ["h1", "h2"]).drop("h1", "h2"), "lines-repeated")
    release(all_lines, twice)
    gone, runs = None, None
    for way in (1, -1):
        turned = repeated.withColumn("i", F.col("i") * way)
        found = _windows(turned, least_run_chars, None if way == 1 else least_run_chars)
        runs = found.select(*_KEY, "i", "line_no", "run") if way == 1 else runs
        place = F.struct(*_KEY, (F.col("i") * way).alias("i"))
        # equal windows are neighbours in the array
        found = found.where("run >= n")
        firsts = settle(found.groupBy("interval").agg(F.min(place).alias("first")), "lines-firsts")
        covered = (found.join(firsts, "interval").where(place != F.col("first"))
                   .select(*_KEY, F.explode(F.sequence("i", F.col("i") + F.col("n") - 1)).alias("i"))
                   .select(*_KEY, (F.col("i") * way).alias("i")))
        gone = covered if gone is None else gone.union(covered)
    return gone.distinct().join(runs, [*_KEY, "i"]).select(*_KEY, "line_no", "run")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_lines: int = 1,
          least_chars: int = 20, deleted_col: str | None = None, longest_col: str | None = None,
          least_run_chars: int | None = None) -> DataFrame:
    """The rows with all their columns, their text without copied lines, and two counts if named.

    ``deleted_col`` counts the lines gone, ``longest_col`` the lines of the longest repeated
    run that a deleted line begins. A null text stays null, an empty one empty. Lines
    shorter than ``least_chars`` without white space around stay and do not interrupt runs.
    With ``least_run_chars`` instead, every line with a word takes part, and a run counts
    from so many characters in all its lines; the two other minima do not apply.
    Rows of equal id and text are one document and get the same result; null ids come last.
    Extra columns pass through, whatever their names.
    """
    found = (copies(docs, id_col, text_col, least_lines, least_chars) if least_run_chars is None
             else long_copies(docs, id_col, text_col, least_run_chars))
    gone = found.groupBy(*_KEY).agg(
        F.collect_set("line_no").alias("gone"), F.max("run").alias("longest"))
    text = docs[text_col]
    rows = packed(docs, doc=whole_number(docs[id_col]), t=F.xxhash64(F.coalesce(text, F.lit(""))))
    both = rows.join(gone, _KEY, "left")

    def rest(parts: Column) -> Column:
        kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone")))
        return F.array_join(F.transform(kept, lambda n: F.get(parts, n)), "\n")

    old = F.col(f"_row.`{text_col}`")
    changed = {text_col: F.when(F.col("gone").isNull(), old).otherwise(let(F.split(old, "\n"), rest))}
    if deleted_col:
        changed[deleted_col] = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    if longest_col:
        changed[longest_col] = F.coalesce("longest", F.lit(0)).cast("long")
    return unpacked(both, docs, **changed)
