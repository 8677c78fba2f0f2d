"""Stretches of words that repeat a period, and texts with each repetition said once.

A suffix automaton takes the words one by one. Its suffix links are a tree; the path from the
newest prefix to the root holds all that ends here, and every state on it has a colour, the
place where its words last ended before. Paths are kept as splay trees of one colour each
(a link-cut tree), so that recolouring the path of every new word costs logarithmic time on
average and passes each piece of an old path once. A piece last seen d words ago whose longest
words have length L says that L + d words up to here have period d; as the last occurrence is
the nearest, d is the smallest period, and as L is the longest, the stretch cannot begin
earlier. It is a run where the next word ends it.

Before, windows of words that do not occur again in their text cut it up: no run lies across
one. What is left goes through the automaton whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ROWS, words

_REMEMBERED = 300_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class PathColours:
    """The suffix links of an automaton as a link-cut tree whose preferred paths have one colour.

    Node 0 is none and node 1 the root. A colour is kept where its splay tree has its root.
    """

    def __init__(self):
        self.up, self.left, self.right, self.colour = [0, 0], [0, 0], [0, 0], [-1, -1]

    def leaf(self, parent: int) -> int:
        """A new node below ``parent``, a path of its own without colour."""
        self.up.append(parent)
        self.left.append(0)
        self.right.append(0)
        self.colour.append(-1)
        return len(self.up) - 1

    def between(self, node: int) -> int:
        """A new node as parent of ``node``, on its path and of its colour."""
        self._splay(node)
        new = self.leaf(node)
        self.left[new] = above = self.left[node]
        if above:
            self.up[above] = new
        self.left[node] = new
        return new

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            left[p] = b = right[x]
            right[x] = p
        else:
            right[p] = b = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p] = x
        up[x] = g
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x

    def _splay(self, x: int) -> None:
        up, left, right, colour, rotate = self.up, self.left, self.right, self.colour, self._rotate
        p = up[x]
        while p and (left[p] == x or right[p] == x):
            g = up[p]
            top = p
            if g and (left[g] == p or right[g] == p):
                top = g
                rotate(p if (left[g] == p) == (left[p] == x) else x)
            rotate(x)
            colour[x] = colour[top]
            p = up[x]

    def recolour(self, node: int, new: int) -> list[tuple[int, int]]:
        """Give the path from the root to ``node`` a colour; (lowest node, old colour) of its pieces."""
        up, right, colour = self.up, self.right, self.colour
        pieces, x, below = [], node, 0
        while x:
            self._splay(x)
            old = colour[x]
            if old >= 0:
                pieces.append((x, old))
            cut = right[x]
            if cut:
                colour[cut] = old
            right[x] = below
            below, x = x, up[x]
        self._splay(node)
        colour[node] = new
        return pieces


def _find(seq: list[int], least: int, folds: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a sequence, ordered."""
    paths = PathColours()
    length, link, follow = [0, 0], [0, 0], [{}, {}]
    last, found, n = 1, [], len(seq)

    for i, word in enumerate(seq):
        p, to = last, 1
        while p and word not in follow[p]:
            p = link[p]
        if p:
            q = follow[p][word]
            if length[q] == length[p] + 1:
                to = q
            else:
                to = paths.between(q)
                length.append(length[p] + 1)
                link.append(link[q])
                follow.append(dict(follow[q]))
                link[q] = to
                at = p
                while at and follow[at].get(word) == q:
                    follow[at][word] = to
                    at = link[at]
        new = paths.leaf(to)
        length.append(length[last] + 1)
        link.append(to)
        follow.append({})
        at = last
        while at != p:
            follow[at][word] = new
            at = link[at]
        last = new
        for node, ended in paths.recolour(new, i):
            same, period = length[node], i - ended
            if same >= (folds - 1) * period and same + period >= least and not (
                    i + 1 < n and seq[i + 1] == seq[i + 1 - period]):
                found.append((i - period - same + 1, same + period, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


class Runs:
    """Finds the runs of texts given as words: ``least`` words and ``folds`` periods at least."""

    def __init__(self, least: int, folds: int):
        if folds < 2 or least < 2:
            raise ValueError("a run has two words and two periods at least")
        self.least, self.folds = least, folds
        # every window of so many words of a run occurs a period before or after it in the run:
        # the run has 3q words and 3w - 5 words at least, in either case 2q + w - 1
        self.window = (least + 5) // 3 if folds >= 3 else 1
        self._known: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        self._known[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def _stretches(self, text: list[bytes]) -> list[tuple[int, int]]:
        """Where windows that occur again lie side by side; equal hashes of others only keep more."""
        if len(text) < self.least:
            return []
        if len(self._known) > _REMEMBERED:
            self._known.clear()
        known, fresh = self._known.get, self._hash
        h = np.array([known(w) or fresh(w) for w in text], np.uint64)
        grams = h[:len(h) - self.window + 1].copy()
        for j in range(1, self.window):
            grams = (grams ^ (grams >> np.uint64(31))) * _STEP + h[j:len(h) - self.window + 1 + j]
        _, first, count = np.unique(grams, return_inverse=True, return_counts=True)
        again = np.nonzero(count[first] > 1)[0]
        if not len(again):
            return []
        # all windows of a run occur again, so a run lies in one stretch
        cuts = np.nonzero(np.diff(again) > 1)[0]
        starts, ends = again[np.r_[0, cuts + 1]], again[np.r_[cuts, len(again) - 1]] + self.window
        return [(a, b) for a, b in zip(starts.tolist(), ends.tolist()) if b - a >= self.least]

    def of(self, text: list[bytes]) -> list[tuple[int, int, int]]:
        """(start, length, period), ordered by start and period."""
        out = []
        for a, b in self._stretches(text):
            number: dict[bytes, int] = {}
            seq = [number.setdefault(w, len(number)) for w in text[a:b]]
            out += [(a + s, n, q) for s, n, q in _find(seq, self.least, self.folds)]
        return out


def collapsed(text: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return text
    depth = np.zeros(len(text) + 1, np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [w for w, d in zip(text, np.cumsum(depth[:-1]).tolist()) if not d]


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, folds: int = 3) -> DataFrame:
    """(id, runs, collapsed) of every row: its runs as (start, length, period) by start and period,
    and its words without repetition, joined by one space.

    A run is a stretch of words with smallest period q, of ``least`` words and ``folds`` times
    q at least, that neither neighbour extends. Words lie between ASCII white space and count
    from 0. Null and empty texts have no words, no runs and an empty text. Every row is judged
    by itself: null and repeated ids, and repeated rows, change nothing. Texts count whole;
    memory grows with the longest repetitive stretch of one text. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    fields = {"id": to_arrow_type(kind), "runs": pa.list_(run), "collapsed": pa.string()}

    def find(batches):
        finder = Runs(least, folds)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            out = {name: [] for name in fields}
            out["id"] = batch.column(0).to_pylist()
            for text in batch.column(1).to_pylist():
                text = (text or "").encode().split()
                found = finder.of(text)
                out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in found])
                out["collapsed"].append(b" ".join(collapsed(text, found)).decode())
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in fields.items()], names=list(fields))

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(
        find, f"id {kind.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    ).withColumnRenamed("id", id_col)


def with_repeats(text: Column, id_: Column) -> Column:
    """The text, in one of ten documents with its end replaced by repetitions of some of its words.

    With h the crc32 of the id as text and g = h div 10, a document of n words where 10 divides
    h keeps its first a = g mod n words; the 1 + (n - a) div (3 + g mod 8) words that follow are
    repeated up to n words. Documents with a null id or without words stay.
    """
    h, w = F.crc32(id_.cast("string")), words(text)
    n, g = F.size(w).cast("long"), F.floor(h / 10)
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    period = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
    part = F.slice(w, (a + 1).cast("int"), period.cast("int"))
    tail = F.flatten(F.array_repeat(part, F.ceil((n - a) / period).cast("int")))
    whole = F.concat(F.slice(w, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int")))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(whole, " ")).otherwise(text)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of the result of ``runs``: how many, the one with the most repetitions, and digests.

    The most repetitions are the greatest exact length over period; ties go to the smaller
    start, then period. Without a run its four columns are null.
    """
    def more(x: Column, y: Column) -> Column:
        return x["length"] * y["period"] > y["length"] * x["period"]

    # runs come by start and period, so the first of equal ones stays
    best = F.aggregate(F.slice("runs", F.lit(1), F.size("runs")), F.get("runs", F.lit(0)),
                       lambda b, r: F.when(more(r, b), r).otherwise(b))
    said = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
