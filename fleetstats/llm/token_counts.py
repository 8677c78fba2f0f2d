"""Token counts under a unigram model, shared along a trie.

The most likely segmentation of a pre-token is a forward pass over its bytes: the best score
up to a position comes from the best scores before it. Pre-tokens with a common start have
the same scores up to there. New pre-tokens are therefore taken in sorted order, which walks
their trie depth first: scores are kept for the path to the current node, so each shared
prefix is scored once, and only the counts at terminal nodes stay in memory.
"""

from __future__ import annotations

import math

import public_tokenizers
from pyspark.sql import DataFrame

from .byte_bpe import read_ranks
from .common import mapped

#: Terminal counts a task remembers before it starts anew; bounds memory, not results.
_REMEMBERED = 600_000
_TOGETHER = 500


def unigram_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Log probabilities that fall with the rank as Zipf's law has it; every single byte has one."""
    total = math.log(sum(1.0 / (r + 1) for r in ranks.values()))
    return {piece: -math.log(rank + 1) - total for piece, rank in ranks.items()}


class Trie:
    """Tokens of pre-tokens under a unigram model; of segmentations as likely, the one of fewest tokens."""

    def __init__(self, scores: dict[bytes, float]):
        self._scores = scores
        # an end of no piece cannot begin one further left, which ends the search for pieces early
        self._ends = {piece[i:] for piece in scores for i in range(len(piece))}

    def terminals(self, words: list[bytes]) -> list[int]:
        """Token counts of words in sorted order."""
        scores, ends, out = self._scores, self._ends, []
        best, counts, before = [0.0], [0], b""
        for word in words:
            shared = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:], counts[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                top, fewest = -math.inf, 0
                for start in range(end - 1, -1, -1):
                    piece = word[start:end]
                    if piece not in ends:
                        break
                    if piece in scores:
                        s, n = best[start] + scores[piece], counts[start] + 1
                        if s > top or (s == top and n < fewest):
                            top, fewest = s, n
                best.append(top)
                counts.append(fewest)
            out.append(counts[-1])
            before = word
        return out


class Counter:
    """Counts the tokens of whole texts; remembers the terminals it has met."""

    def __init__(self, scores: dict[bytes, float], pattern: str):
        import regex

        self._split = regex.compile(pattern).findall
        self._trie = Trie(scores)
        self._known: dict[str, int] = {}

    def counts(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        out = []
        for at in range(0, len(texts), _TOGETHER):
            split = [self._split(t or "") for t in texts[at:at + _TOGETHER]]
            if len(self._known) > _REMEMBERED:
                self._known.clear()
            new = sorted((w.encode(), w) for w in set().union(*split).difference(self._known))
            self._known.update(zip((w for _, w in new), self._trie.terminals([b for b, _ in new])))
            get = self._known.__getitem__
            out += [(len(words), sum(map(get, words))) for words in split]
        return out


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
          pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, n_pretokens, n_tokens) of every row.

    Null and empty texts have none; texts of any length count whole; repeated rows are
    counted each; other columns are ignored. The vocabulary (under 2 MB) goes out once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(unigram_scores(read_ranks(path)))
    made: list[Counter] = []

    def run(b: dict) -> dict:
        if not made:
            made.append(Counter(sent.value, pattern))
        got = made[0].counts(b["text"])
        return {"id": b["id"], "n_pretokens": [x[0] for x in got], "n_tokens": [x[1] for x in got]}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return mapped(rows, f"id {kind}, n_pretokens bigint, n_tokens bigint", run).withColumnRenamed("id", id_col)
