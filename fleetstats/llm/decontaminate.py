"""Benchmark passages in documents, up to an edit budget.

An item with a budget of k edits is cut into k + 1 pieces. Any passage within k edits of it
holds one of the pieces unchanged, so exact piece hits, found for all items in one pass over
a text, lead to every match. Around each hit the bit-parallel edit distance of Myers decides.

Texts are compared in lower case with white space as single spaces. Items are a query set:
they go out in blocks of bounded size, and every block meets every whole text.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, functions as F

from .common import text_function

#: Edits allowed, in thousandths of an item's characters.
EDITS_PER_MILLE = 50
#: Characters of items that one pass over the documents looks for.
BLOCK_CHARS = 4_000_000
MATCHES = "array<struct<item_id: bigint, edits: int, start: int, end: int>>"


def normal(text: str | None) -> str:
    """Lower case, with white space as single spaces and none at the ends."""
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget`` + 1 parts of as even lengths as can be, each with its offset."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """Myers' bit vectors of one item, for finding it in a text within a distance."""

    def __init__(self, item: str):
        self.size = len(item)
        self._bits: dict[str, int] = defaultdict(int)
        for i, c in enumerate(item):
            self._bits[c] |= 1 << i

    def best(self, text: str, budget: int, anchored: bool = False) -> tuple[int, int] | None:
        """(distance, end) of the closest passage, the first of equals; None beyond the budget.

        An anchored search takes passages that begin where the text does.
        """
        full = (1 << self.size) - 1
        top = 1 << (self.size - 1)
        plus, minus, score, found = full, 0, self.size, None
        get = self._bits.get
        for at, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | ~(xh | plus) & full
            mh = plus & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = (ph << 1 | anchored) & full
            mh = mh << 1 & full
            plus = mh | ~(xv | ph) & full
            minus = ph & xv
            if score <= budget and (found is None or score < found[0]):
                found = (score, at + 1)
                if not score:
                    break
        return found


class Finder:
    """The items of one block, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], per_mille: int):
        import ahocorasick

        self._items = [(i, text, len(text) * per_mille // 1000) for i, text in items if text]
        hits: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text, budget) in enumerate(self._items):
            for offset, piece in pieces(text, budget):
                hits[piece].append((n, offset))
        self._auto = ahocorasick.Automaton()
        for piece, where in hits.items():
            self._auto.add_word(piece, (len(piece), where))
        if hits:
            self._auto.make_automaton()
        self._patterns: dict[int, tuple[Pattern, Pattern]] = {}

    def matches(self, raw: str | None) -> list[dict]:
        """The closest passage for every item that the text holds."""
        text = normal(raw)
        if not self._items or not text:
            return []
        spans: dict[int, list[list[int]]] = defaultdict(list)
        for end, (length, where) in self._auto.iter(text):
            for n, offset in where:
                _, item, budget = self._items[n]
                begin = end + 1 - length - offset
                a, b = max(0, begin - budget), begin + len(item) + budget
                last = spans[n][-1] if spans[n] else None
                if last and last[0] <= b and a <= last[1]:
                    last[0], last[1] = min(last[0], a), max(last[1], b)
                else:
                    spans[n].append([a, b])
        out = []
        for n, windows in spans.items():
            key, item, budget = self._items[n]
            if n not in self._patterns:
                self._patterns[n] = Pattern(item), Pattern(item[::-1])
            forward, backward = self._patterns[n]
            found = None
            for a, b in windows:
                hit = forward.best(text[a:b], budget)
                if hit and (found is None or hit[0] < found[0]):
                    found = hit[0], a + hit[1]
                    if not hit[0]:
                        break
            if found:
                edits, end = found
                back = backward.best(text[max(0, end - len(item) - budget):end][::-1], edits, True)
                out.append({"item_id": key, "edits": edits, "start": end - back[1], "end": end})
        return sorted(out, key=lambda m: m["item_id"])


def finders(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
            per_mille: int = EDITS_PER_MILLE, block_chars: int = BLOCK_CHARS):
    """For each block of items, a function from a text column to its matches.

    Null and empty items match nothing; items with a null id count as none.
    """
    spark = items.sparkSession
    some = items.select(items[id_col].cast("long").alias("i"), items[text_col].alias("t")).where("i is not null")
    n_blocks = 1 + (some.agg(F.sum(F.length("t"))).first()[0] or 0) // block_chars
    for block in range(n_blocks):
        rows = some.where(F.pmod(F.xxhash64("i"), F.lit(n_blocks)) == block).collect()
        sent = spark.sparkContext.broadcast(sorted({(r.i, normal(r.t)) for r in rows}))
        yield _look(sent, per_mille)


def _look(sent, per_mille: int):
    made: list[Finder] = []

    def look(text: str | None) -> list[dict]:
        if not made:
            made.append(Finder(sent.value, per_mille))
        return made[0].matches(text)

    return text_function(look, MATCHES)


def matches(text: Column, items: DataFrame, **options) -> Column:
    """All matches of every item in a text column, as MATCHES."""
    return F.concat(*[find(text) for find in finders(items, **options)])


def leaks(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text",
          **options) -> DataFrame:
    """(doc_id, item_id, edits, start, end): the closest passage for each item a text holds.

    Offsets count characters of the normal form. Null and empty texts hold nothing; repeated
    rows give repeated results; items of equal text are all reported; other columns are
    ignored.
    """
    found = docs.select(docs[doc_col].alias(doc_col), matches(docs[text_col], items, **options).alias("m"))
    return found.select(doc_col, F.inline("m"))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows, with all their columns, whose text holds no item."""
    return docs.where(F.size(matches(docs[text_col], items, **options)) == 0)
