"""Words that differ by one character, and the form each is a variant of.

The vocabulary is searched for the neighbours of every word by a pair of search schemes over
an FM-index of its words between delimiters: one scheme matches a word's first half exactly
and goes on to the right through the second half, where one character may be replaced,
inserted or left out; the other matches the second half and goes on to the left. An index for
each direction turns a character into an interval of suffix ranks, for many words at once.

A neighbour has the exact half in common, so words meet in shards by that half, each with its
own index. A half that more words share than a shard may hold is dealt over several shards,
and those who ask for it ask in each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import settle

#: Words of a shard, about; more than twice as many of one half are dealt out.
SHARD = 1 << 16
#: Words that are searched for at once, and their characters.
_ASKED, _CELLS = 1 << 12, 1 << 20
LETTERS = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (numbers from 0) in order; a prefix comes before what it begins."""
    width = max(1, int(text.max()).bit_length() + 1) if len(text) else 1
    told = max(1, 62 // width)
    rank = np.zeros(len(text), np.int64)
    for j in range(told):
        rank <<= width
        rank[:max(0, len(text) - j)] += text[j:] + 1
    while True:
        order = np.argsort(rank, kind="stable")
        first = np.r_[True, rank[order][1:] != rank[order][:-1]][:len(text)]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(first)
        if first.all():
            return order
        ahead = np.zeros_like(rank)
        ahead[:max(0, len(text) - told)] = rank[told:]
        rank = rank * (len(text) + 1) + ahead
        told *= 2


class Index:
    """FM-index of words, read from their first character on; each lies between delimiters."""

    def __init__(self, words: list[str]):
        self.words = words
        joined = "\n" + "".join(w[::-1] + "\n" for w in words)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.letters = np.unique(points[points != 10])
        text = np.where(points == 10, 0, np.searchsorted(self.letters, points) + 1).astype(np.int64)
        self.suffixes = suffix_array(text)
        self.before = text[self.suffixes - 1]
        self.span = len(text) + 1
        # sorted by character and rank: what comes before (c, i) is where suffixes c + rank i begin
        self.places = np.sort(self.before * self.span + np.arange(len(text)))
        self.starts = np.nonzero(text == 0)[0]

    def codes(self, words: list[str]) -> np.ndarray:
        """Characters as numbers, a row for each word, filled up with 0; unknown ones are beyond all others."""
        width = max(map(len, words))
        points = np.frombuffer("".join(w.ljust(width, "\n") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), width)
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(points == 10, 0, np.where(self.letters[at] == points, at + 1, len(self.letters) + 1)).astype(np.int64)

    def extend(self, letter: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that go on with ``letter`` from those in [lo, hi)."""
        return (np.searchsorted(self.places, letter * self.span + lo), np.searchsorted(self.places, letter * self.span + hi))

    def branches(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, letter) of every letter that may follow: from the ranks of small intervals, else all letters."""
        size, few = hi - lo, len(self.letters)
        small, large = np.nonzero(size <= few)[0], np.nonzero(size > few)[0]
        each = size[small]
        rank = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(lo[small], each)
        seen = np.unique(np.repeat(small, each) * (few + 1) + self.before[rank])
        seen = seen[seen % (few + 1) > 0]
        which, letter = np.divmod(seen, few + 1)
        return (np.concatenate([which, np.repeat(large, few)]),
                np.concatenate([letter, np.tile(np.arange(1, few + 1), len(large))]))

    def near(self, asked: list[str], exact: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(asked, indexed) numbers of words that differ by one character after the exact beginning of the first."""
        x, size, exact = self.codes(asked), np.array([len(w) for w in asked]), np.array(exact)
        x = np.concatenate([x, np.zeros((len(x), 1), np.int64)], axis=1)
        word = np.arange(len(asked))
        lo, hi = np.zeros(len(asked), np.int64), np.full(len(asked), len(self.starts), np.int64)
        changed = []
        for j in range(int(size.max()) + 1):
            on = j >= exact[word]
            if on.any():
                w, a, b = word[on], lo[on], hi[on]
                inside = j < size[w]
                # left out
                changed.append(np.stack([w[inside], np.full(inside.sum(), j + 1), a[inside], b[inside]]))
                at, letter = self.branches(a, b)
                other = letter != x[w[at], j]
                at, letter = at[other], letter[other]
                na, nb = self.extend(letter, a[at], b[at])
                there = nb > na
                at, na, nb = at[there], na[there], nb[there]
                # inserted, then replaced
                changed.append(np.stack([w[at], np.full(len(at), j), na, nb]))
                whole = inside[at]
                changed.append(np.stack([w[at][whole], np.full(whole.sum(), j + 1), na[whole], nb[whole]]))
            go = j < size[word]
            word, lo, hi = word[go], lo[go], hi[go]
            lo, hi = self.extend(x[word, j], lo, hi)
            there = hi > lo
            word, lo, hi = word[there], lo[there], hi[there]
        word, j, lo, hi = np.concatenate(changed, axis=1)
        found = [np.zeros((2, 0), np.int64)]
        while len(word):
            # after the last character comes the delimiter, 0 in x
            done = j == size[word]
            lo, hi = self.extend(x[word, j], lo, hi)
            there = hi > lo
            end = done & there
            found.append(np.stack([word[end], np.searchsorted(self.starts, self.suffixes[lo[end]])]))
            go = there & ~done
            word, j, lo, hi = word[go], j[go] + 1, lo[go], hi[go]
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1))


def _exact(length: Column, side: int) -> Column:
    """Characters that must agree: the first half of a word, or the rest of it as seen from the end."""
    return F.floor((length + side) / 2).cast("int")


def _shards(words: DataFrame) -> DataFrame:
    """(shard, side, word, asks, holds): every word where it asks, and where it may be found."""
    size = F.char_length("word")

    def seen(side: int) -> Column:
        own = _exact(size, side)
        halves = F.array_distinct(F.array(own, _exact(size - 1, side), _exact(size + 1, side)))
        return F.transform(halves, lambda k: F.struct(F.lit(side).alias("side"), k.alias("half"), (k == own).alias("asks")))

    met = (words.select("word", F.explode(F.concat(seen(0), seen(1))).alias("m")).select("word", "m.*")
           .withColumn("turned", F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")))
           .select("word", "side", "asks", F.xxhash64("side", F.substring("turned", F.lit(1), F.col("half"))).alias("half")))
    met = settle(met, "spelling-halves")
    crowded = settle(met.groupBy("half").agg(F.count("*").alias("n")).where(F.col("n") > 2 * SHARD)
                     .select("half", F.ceil(F.col("n") / SHARD).cast("int").alias("parts")), "spelling-crowded")
    shards = max(1, -(-met.count() // SHARD))
    met = met.join(crowded, "half", "left")
    one = met.where("parts is null").select("*", F.lit(0).alias("part"), F.lit(True).alias("holds"))
    many = met.where("parts is not null")
    held = many.select("*", F.pmod(F.xxhash64("word"), "parts").cast("int").alias("part"), F.lit(True).alias("holds")).withColumn("asks", F.lit(False))
    asked = many.where("asks").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("holds"))
    every = one.unionByName(held).unionByName(asked)
    # a crowded half has shards of its own
    shard = F.when(F.col("parts").isNull(), F.pmod("half", F.lit(shards))).otherwise(F.xxhash64("half", "part"))
    return every.select(shard.alias("shard"), "side", "word", "asks", "holds").repartition(shards, "shard")


def pairs(words: DataFrame) -> DataFrame:
    """(word, near) for every two of ``word`` that differ by one inserted, deleted or replaced character, both ways.

    ``word`` is distinct, not null and has two characters or more.
    """
    names = {"word": pa.string(), "near": pa.string()}

    def search(batches):
        def ended(side, asked, held):
            if not (asked and held):
                return
            held = sorted(held)
            index = Index([w[::-1] if side else w for w in held])
            asked = sorted(asked, key=len)
            while asked:
                # the longest comes last and sets the width
                n = min(len(asked), _ASKED, max(1, _CELLS // len(asked[-1])))
                some, asked = asked[-n:], asked[:-n]
                of, found = index.near([w[::-1] if side else w for w in some], [(len(w) + side) // 2 for w in some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([some[i] for i in of.tolist()], pa.string()), pa.array([held[i] for i in found.tolist()], pa.string())],
                    names=list(names))

        now, asked, held = None, set(), set()
        for batch in batches:
            for shard, side, word, asks, holds in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (shard, side) != now:
                    if now:
                        yield from ended(now[1], asked, held)
                    now, asked, held = (shard, side), set(), set()
                if asks:
                    asked.add(word)
                if holds:
                    held.add(word)
        if now:
            yield from ended(now[1], asked, held)

    return _shards(words).sortWithinPartitions("shard", "side").mapInArrow(search, "word string, near string").distinct()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 7, least_n: int = 2,
               slips: int | None = None) -> DataFrame:
    """(word, n): runs of letters of all texts, A-Z in lower case, that are long and frequent enough.

    With ``slips``, a run loses the character crc32 mod its length, from 0, where ``slips``
    divides the crc32 of ``<id>:<run>``; without an id it stays. Null texts have no words.
    """
    low = F.translate(docs[text_col], _UPPER, _LOWER)
    rows = docs.select(docs[id_col].cast("string").alias("id"),
                       F.explode(F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))).alias("word"))
    if slips:
        h, size = F.crc32(F.concat("id", F.lit(":"), "word")), F.char_length("word")
        rows = rows.select("word", h.alias("h"), F.pmod(h, size).cast("int").alias("at")).select(
            F.when(F.pmod("h", F.lit(slips)) == 0, F.concat(F.substring("word", F.lit(1), F.col("at")), F.expr("substring(word, at + 2)")))
            .otherwise(F.col("word")).alias("word")).where(F.char_length("word") >= least_chars)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 7, least_n: int = 2,
             times: int = 10, slips: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    ``n_near`` counts the words that differ from it by one character. ``form`` is the most
    frequent of these, ties to the first in code-point order, where it is ``times`` as
    frequent as the word or more, else null; ``root`` is where following forms ends, the word
    itself if it has none. Repeated rows count each, null and empty texts have no words, texts
    of any length count whole, a table without words gives no rows, other columns are ignored.
    """
    if times < 2 or least_chars < 3:
        raise ValueError("forms must be more frequent than their variants, words have three characters or more")
    words = settle(vocabulary(docs, id_col, text_col, least_chars, least_n, slips), "spelling-words")
    found = settle(pairs(words.select("word")), "spelling-pairs")
    # frequencies come first, so that the largest is the smallest pair
    best = (found.join(words.select(F.col("word").alias("near"), (-F.col("n")).alias("less")), "near")
            .groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct("less", "near")).alias("best")))
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= times * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("n"))).alias("f"))
    judged = settle(judged.select("word", "n", "n_near", F.col("f.form").alias("form"), F.col("f.n").alias("form_n")), "spelling-forms")
    # a form is many times as frequent, so chains are short; each round doubles what is followed
    roots = judged.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        roots = settle(roots, "spelling-roots")
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if roots.join(on, "root", "left_semi").isEmpty():
            break
        roots = roots.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), F.col("n").cast("long").alias("n"), "n_near", "form_n")
