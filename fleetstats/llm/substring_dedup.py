"""Repeated substrings: content-defined chunks, deduplicated by digest.

A gear hash rolls over the bytes of a text. Of every few consecutive word starts, the one
with the smallest hash begins a chunk, so borders depend on the text around them only: what
is inserted elsewhere shifts no border, and no chunk is longer than the window of words.
A chunk whose digest a smaller document id has, or the same document further up, is a later
copy; runs of later copies that are long enough are the spans to remove. A repeat of
``2 * window + least_words`` words or more, and a few for the hash to settle in, always
holds such a run; a repeat of fewer than ``least_words`` never does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import packed, settle, unpacked, whole_number
from .quality_rules import let

#: Bytes the gear hash looks back: a power of two.
GEAR_BYTES = 16
WINDOW = 14
LEAST_WORDS = 20


def gears(seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """One 64-bit number for each byte, from the splitmix sequence."""
    out, state = [], seed
    for _ in range(256):
        state = (state + 0x9E3779B97F4A7C15) % (1 << 64)
        z = (state ^ state >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
        z = (z ^ z >> 27) * 0x94D049BB133111EB % (1 << 64)
        out.append(z ^ z >> 31)
    return np.array(out, np.uint64)


_GEARS = gears()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the gears of the last GEAR_BYTES bytes, each shifted by its distance."""
    h = _GEARS[data]
    span = 1
    while span < GEAR_BYTES:
        h[span:] = h[span:] + (h[:-span] << np.uint64(span))
        span *= 2
    return h


def chunk(text: str | None, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(byte borders, character borders, words, digests of 16 bytes) of a text's chunks.

    Chunks begin at words, after white space, and hold the white space that follows them.
    """
    raw = (text or "").encode()
    none = np.zeros(0, np.int64)
    if not raw:
        return none, none, none, np.zeros((0, 2), np.int64)
    data = np.frombuffer(raw, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.nonzero(~space & np.concatenate(([True], space[:-1])))[0]
    if not len(starts):
        return none, none, none, np.zeros((0, 2), np.int64)
    hashes = gear_hash(data.copy())[np.maximum(starts - 1, 0)]
    if len(starts) > window:
        view = np.lib.stride_tricks.sliding_window_view(hashes, window)
        cuts = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    else:
        cuts = np.array([hashes.argmin()])
    cuts = np.unique(np.concatenate(([0], cuts)))
    borders = np.append(starts[cuts], len(raw))
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    words = np.diff(np.append(cuts, len(starts)))
    # the white space at the end does not tell chunks apart
    digest = b"".join(xxhash.xxh3_128_digest(raw[a:b].rstrip()) for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()))
    return borders, chars[borders], words, np.frombuffer(digest, np.int64).reshape(-1, 2)


def chunks(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(doc, t, j, start, end, words, d1, d2, fresh): all chunks; ``fresh`` if its document has it no earlier."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(whole_number(docs[id_col]).alias("doc"),
                       F.xxhash64(text).alias("t"), text.alias("text"))
    names = ["doc", "t", "j", "start", "end", "words", "d1", "d2", "fresh"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = {n: [] for n in names}
                for doc, t, text in zip(*(part.column(k).to_pylist() for k in range(3))):
                    _, chars, words, digest = chunk(text, window)
                    n = len(words)
                    fresh = np.zeros(n, bool)
                    fresh[np.unique(digest.view(np.dtype((np.void, 16))).ravel(), return_index=True)[1]] = True
                    values = (np.full(n, doc, np.int64), np.full(n, t, np.int64), np.arange(n, dtype=np.int32),
                              chars[:-1].astype(np.int32), chars[1:].astype(np.int32), words.astype(np.int32),
                              digest[:, 0], digest[:, 1].astype(np.int32), fresh)
                    for k, v in zip(names, values):
                        out[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[k])) for k in names], names=names)

    return rows.mapInArrow(run, "doc bigint, t bigint, j int, start int, end int, words int, d1 bigint, d2 int, fresh boolean")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
          least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc, t, start, end, n_words, first_doc): characters of each document that are later copies.

    ``first_doc`` is the smallest id that has one of the run's chunks. Null and empty texts
    have no chunks; texts of any length count whole. Rows of equal id and text are one
    document and have the same spans once; of those with equal id, or null ids, but other
    texts the one with the smallest hash comes first. A null id is the largest number. Other
    columns are ignored.
    """
    every = settle(chunks(docs, id_col, text_col, window), "chunks")
    # a document's place in one number, 63 bits of its id and 60 of its text's hash, which a hash aggregate can hold
    place = (F.col("doc").cast("decimal(19,0)") * F.lit(1 << 60).cast("decimal(19,0)")
             + F.shiftrightunsigned("t", 4).cast("decimal(19,0)")).cast("decimal(38,0)")
    fresh = every.where("fresh").withColumn("place", place)
    # written down, so that the join shuffles both sides and can split a frequent chunk
    shared = settle(fresh.groupBy("d1", "d2").agg(F.min("doc").alias("first_doc"), F.min("place").alias("first"),
                                                   F.max("place").alias("last"))
                    .where("first < last").drop("last"), "chunks-shared")
    columns = ["doc", "t", "j", "start", "end", "words"]
    across = fresh.join(shared, ["d1", "d2"]).where("place > first").select(*columns, "first_doc")
    within = every.where("not fresh").select(*columns, F.col("doc").alias("first_doc"))
    later = across.union(within).groupBy(*columns).agg(F.min("first_doc").alias("first_doc"))
    # one document's chunks, no more than its row held
    order = Window.partitionBy("doc", "t").orderBy("j")
    return (later.withColumn("run", F.col("j") - F.row_number().over(order))
            .groupBy("doc", "t", "run").agg(
                F.min("start").alias("start"), F.max("end").alias("end"),
                F.sum("words").alias("n_words"), F.min("first_doc").alias("first_doc"))
            .where(F.col("n_words") >= least_words).drop("run"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
          least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows, with all their columns, and their text without the spans that are later copies.

    A null text stays null. Rows of equal id and text get the same result.
    """
    gone = spans(docs, id_col, text_col, window, least_words).groupBy("doc", "t").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gone"))
    rows = packed(docs, doc=whole_number(docs[id_col]), t=F.xxhash64(F.coalesce(docs[text_col], F.lit(""))))
    old = F.col(f"_row.`{text_col}`")

    def rest(cuts: Column) -> Column:
        size = F.size(cuts)
        return F.array_join(F.transform(F.sequence(F.lit(0), size), lambda n: F.substring(
            old, F.when(n == 0, 1).otherwise(F.get(cuts, n - 1)["end"] + 1),
            F.when(n == size, F.length(old)).otherwise(F.get(cuts, n)["start"])
            - F.when(n == 0, 0).otherwise(F.get(cuts, n - 1)["end"]))), "")

    both = rows.join(gone, ["doc", "t"], "left")
    return unpacked(both, docs, **{
        text_col: F.when(F.col("gone").isNull(), old).otherwise(let(F.col("gone"), rest))})
