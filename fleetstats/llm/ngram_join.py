"""Groups of documents whose sets of word n-grams are alike.

Texts with the same set are one class; classes meet in tiles. A class has a tile for each
n-gram of its prefix, the few n-grams that any partner must share one of, ordered so that
frequent ones come last. Tiles are banded by set size: partners lie in the same or the next
band. Every class carries a bitmap that holds the parity of its hashed n-grams; the bits in
which two bitmaps differ are no more than the n-grams that only one of them has, which bounds
the overlap from above. What passes is decided by intersecting the sorted sets.

Links are wanted only as far as they connect, so no group is expanded into pairs. First every
class is held against one or two classes of each tile. Then, in tiles whose classes are not
yet connected, blocks of bounded size are held against each other, for classes of different
components only: twice each class brings up its nearest, and what is still apart after that
brings up all that could link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ROWS, SPACES, components, packed, release, settle, unpacked

#: n-grams are counted by this many hash buckets to tell frequent ones.
SKETCH = 1 << 16
LEAST_BITS = 64
#: Text keys that may be broadcast to find their texts; 16 bytes each.
FEW_KEYS = 500_000
#: Classes in a block of a tile.
BLOCK = 2048
#: Classes of a tile whose pairs are all made by its smallest and its largest class.
SMALL = 3
#: Cells of bitmap words that are compared at once.
_CELLS = 1 << 19
_REMEMBERED = 150_000
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    """64-bit hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Grams:
    """Hashed word n-grams of texts: A-Z in lower case, words between ASCII white space."""

    def __init__(self, n: int):
        self.n = n
        self._known = _Hashes()

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes; of fewer words than n, one for the whole sequence."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self._known
        if len(known) > _REMEMBERED:
            known.clear()
        w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(w))
        h = w[:len(w) - n + 1] + np.uint64(n)
        for j in range(1, n):
            h = (h ^ (h >> np.uint64(29))) * _C1 + w[j:len(w) - n + 1 + j]
        h = (h ^ (h >> np.uint64(32))) * _C2
        return np.unique(h ^ (h >> np.uint64(29)))


class Likeness:
    """At least ``num / den`` of the union lies in the intersection."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, size: int) -> int:
        """N-grams of which any partner shares one, under whatever order."""
        return size - (self.num * size + self.den - 1) // self.den + 1

    def band(self, size: int) -> int:
        """Partners' bands differ by one at most; a little wider than needed, against rounding."""
        return int(np.log(size) / np.log(1.001 * self.den / self.num))

    def bits(self, size: int) -> int:
        """Bits of a bitmap: eight for each n-gram by which partners may differ, as a power of two."""
        apart = 2 * size * (self.den - self.num) // (self.den + self.num)
        return max(LEAST_BITS, 1 << (8 * apart).bit_length())

    def holds(self, both, a, b):
        """Of the sizes of the intersection and of the two sets; numbers or arrays."""
        return self.den * both >= self.num * (a + b - both)


def parity(grams: np.ndarray, size: int) -> bytes:
    """A bit for each of ``size`` hash buckets: whether an odd number of n-grams fell into it."""
    odd = np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(bits: bytes, size: int) -> np.ndarray:
    words = np.frombuffer(bits, np.uint64)
    return np.bitwise_xor.reduce(words.reshape(-1, size // 64), axis=0)


def _stack(bits: list[bytes]) -> np.ndarray:
    size = 8 * min(map(len, bits))
    return np.stack([_fold(b, size) for b in bits])


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _records(names: dict[str, pa.DataType], columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in names.items()], names=list(names))


def _text_key():
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def frequencies(texts: DataFrame, n: int) -> bytes:
    """How often each hash bucket's n-grams occur, as powers of two over the mean, one byte each.

    Tasks count whole partitions; what reaches the driver is one number for each bucket.
    """
    def count(batches):
        grams, total = Grams(n), np.zeros(SKETCH, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = [grams.of(t) >> np.uint64(48) for t in batch.column(0).slice(at, 200).to_pylist()]
                total += np.bincount(np.concatenate(some).astype(np.int64), minlength=SKETCH)
        some = np.nonzero(total)[0]
        yield _records({"bucket": pa.int32(), "n": pa.int64()}, {"bucket": some, "n": total[some]})

    rows = texts.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n")).collect()
    total = np.zeros(SKETCH)
    for bucket, k in rows:
        total[bucket] = k
    level = np.log2(np.maximum(total, 1) / max(total.mean(), 1))
    return np.clip(np.ceil(level), 0, 60).astype(np.uint8).tobytes()


def signatures(rows: DataFrame, n: int, like: Likeness) -> DataFrame:
    """Of (doc_id, text, t1, t2): the set's digest and size, its prefix, and its bitmap."""
    levels = rows.sparkSession.sparkContext.broadcast(frequencies(rows, n))
    kind = rows.schema["doc_id"].dataType
    names = {"doc_id": to_arrow_type(kind), "t1": pa.int64(), "t2": pa.int64(), "d1": pa.int64(), "d2": pa.int64(),
             "n": pa.int64(), "band": pa.int32(), "prefix": pa.list_(pa.int64()), "bits": pa.binary()}
    def sign(batches):
        grams, level = Grams(n), np.frombuffer(levels.value, np.uint8)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            out = {k: [] for k in names}
            for doc_id, text, t1, t2 in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "t1", "t2"))):
                h = grams.of(text)
                d1 = d2 = band = 0
                prefix, bits = [], b""
                if len(h):
                    d1, d2 = np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), np.int64).tolist()
                    band = like.band(len(h))
                    order = np.argsort(level[(h >> np.uint64(48)).astype(np.int64)], kind="stable")
                    prefix = _signed(h[order[:like.prefix(len(h))]])
                    bits = parity(h, like.bits(len(h)))
                for k, v in zip(names, (doc_id, t1, t2, d1, d2, len(h), band, prefix, bits)):
                    out[k].append(v)
            yield _records(names, out)

    return rows.mapInArrow(sign, f"doc_id {kind.simpleString()}, t1 bigint, t2 bigint, d1 bigint, d2 bigint, "
                                 "n bigint, band int, prefix array<bigint>, bits binary")


def _likely(pairs: DataFrame, classes: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b) of d1 whose bitmaps and sizes leave a link possible."""
    side = classes.select("d1", "n", "bits")
    both = (pairs.join(side.toDF("a", "an", "ab"), "a").join(side.toDF("b", "bn", "bb"), "b")
            .where(f"{like.den} * least(an, bn) >= {like.num} * greatest(an, bn)").select("a", "b", "an", "bn", "ab", "bb"))

    def test(batches):
        for batch in batches:
            a, b, an, bn, ab, bb = (batch.column(i).to_pylist() for i in range(6))
            keep = []
            for i in range(len(a)):
                size = 8 * min(len(ab[i]), len(bb[i]))
                apart = int(np.bitwise_count(_fold(ab[i], size) ^ _fold(bb[i], size)).sum())
                if like.holds((an[i] + bn[i] - apart) // 2, an[i], bn[i]):
                    keep.append(i)
            yield _records({"a": pa.int64(), "b": pa.int64()}, {"a": [a[i] for i in keep], "b": [b[i] for i in keep]})

    return both.mapInArrow(test, "a bigint, b bigint")


def _runs(batches) -> Iterator[dict[str, list]]:
    """Rows of equal h, band, i, j that follow each other, as lists by column."""
    now, key, names = None, None, None
    for batch in batches:
        names = names or batch.schema.names
        columns = [batch.column(k).to_pylist() for k in range(len(names))]
        for row in zip(*columns):
            if row[:4] != key:
                if now:
                    yield dict(zip(names, zip(*now)))
                now, key = [], row[:4]
            now.append(row)
    if now:
        yield dict(zip(names, zip(*now)))


def _compare(run: dict[str, list], like: Likeness, nearest: bool) -> tuple[list[int], list[int]]:
    """Pairs of one piece of work: two blocks of a tile, or one block with itself."""
    bits, sizes = _stack(run["bits"]), np.array(run["n"])
    comp = np.unique(np.array(run["comp"]), return_inverse=True)[1]
    own, base, d1 = np.array(run["own"]), np.array(run["true_band"]), np.array(run["d1"])
    i, j, band = run["i"][0], run["j"][0], run["band"][0]
    active = np.array(run["active"])
    # each pair has an end outside the largest component, and one that is active
    xs = np.nonzero(comp != np.bincount(comp).argmax() if active.all() else active)[0]
    step = max(1, _CELLS // bits.size)
    out = []
    for at in range(0, len(xs), step):
        x = xs[at:at + step, None]
        small, large = np.minimum(sizes, sizes[x]), np.maximum(sizes, sizes[x])
        ok = (comp != comp[x]) & (like.den * small >= like.num * large) & (np.minimum(base, base[x]) == band)
        if i != j:
            ok &= own != own[x]
        if not ok.any():
            continue
        apart = np.bitwise_count(bits ^ bits[x]).sum(axis=2, dtype=np.int64)
        ok &= like.holds((sizes + sizes[x] - apart) // 2, sizes, sizes[x])
        if nearest:
            best = np.where(ok, apart, 1 << 60).argmin(axis=1)
            found = ok.any(axis=1)
            out.append(np.stack([x[found, 0], best[found]]))
        else:
            out.append(np.stack([x[:, 0][np.nonzero(ok)[0]], np.nonzero(ok)[1]]))
    if not out:
        return [], []
    a, b = d1[np.concatenate(out, axis=1)]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pairs[0].tolist(), pairs[1].tolist()


def _blocks(tiles: DataFrame, classes: DataFrame, like: Likeness, nearest: bool) -> DataFrame:
    """Pairs (a, b) likely to link, from tiles (h, band, d1, comp, active) that hold several components.

    A tile is cut into blocks by hash; every two blocks of it are one piece of work. With
    ``nearest`` an active class brings up the likeliest partner of each piece, else all.
    """
    several = settle(tiles.groupBy("h", "band").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("active").alias("any"), F.count("*").alias("m")
    ).where("lo <> hi and any").select("h", "band", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "grams-several")
    mine = tiles.join(several, ["h", "band"]).withColumn("own", F.pmod(F.xxhash64("d1"), "blocks").cast("int"))
    mine = mine.join(classes.select("d1", F.col("n").cast("int").alias("n"), "bits", F.col("band").alias("true_band")), "d1")
    columns = ["own", "d1", "comp", "active", "n", "true_band", "bits"]
    pieces = mine.select(
        "h", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), *columns
    ).select("h", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *columns)

    def compare(batches):
        seen: set[tuple[int, int]] = set()
        for run in _runs(batches):
            a, b = _compare(run, like, nearest)
            # a pair meets in many tiles; a task brings it up once, as far as it remembers
            new = [p for p in zip(a, b) if p not in seen]
            seen.update(new)
            if len(seen) > _REMEMBERED:
                seen.clear()
            if new:
                yield _records({"a": pa.int64(), "b": pa.int64()}, {"a": [p[0] for p in new], "b": [p[1] for p in new]})

    return (pieces.repartition("h", "band", "i", "j").sortWithinPartitions("h", "band", "i", "j")
            .mapInArrow(compare, "a bigint, b bigint").distinct())


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, n: int, like: Likeness) -> DataFrame:
    """Links (a, b) of class names among pairs of d1, by exact intersection of the sets.

    Only texts of classes in ``pairs`` move. Their keys are broadcast where they are few,
    which leaves all other texts where they are; else both sides are shuffled.
    """
    named = classes.select("d1", "name", "t1", "t2").join(
        pairs.select(F.explode(F.array("a", "b")).alias("d1")).distinct(), "d1")
    named = settle(named, "grams-needed")
    keys = named.select("t1", "t2").distinct()
    if named.count() <= FEW_KEYS:
        keys = F.broadcast(keys)
    texts = rows.select("t1", "t2", "text").join(keys, ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    side = settle(named.join(texts, ["t1", "t2"]).select("d1", "name", "text"), "grams-texts")
    both = (pairs.join(side.toDF("a", "an", "at"), "a").join(side.toDF("b", "bn", "bt"), "b")
            .select("an", "bn", "at", "bt"))

    def test(batches):
        grams = Grams(n)
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            an, bn, at, bt = (batch.column(k).to_pylist() for k in range(4))
            keep = []
            for k in range(len(an)):
                a, b = grams.of(at[k]), grams.of(bt[k])
                if like.holds(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)):
                    keep.append(k)
            yield _records({"a": pa.string(), "b": pa.string()}, {"a": [an[k] for k in keep], "b": [bn[k] for k in keep]})

    return both.mapInArrow(test, "a string, b string")


def groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_grams, component_id, t1, t2, first) of every row.

    ``component_id`` is the smallest id among documents reachable by links; ``first`` marks
    the rows that stand for their component: those with its smallest id and, among these,
    the smallest hash of the text (t1, t2). Null and empty texts, and texts without words,
    have no n-grams and link with nothing: each is its own component and its own first row.
    Null ids come after all others; repeated rows get the same result each. Texts of any
    length count whole. Other columns are ignored.
    """
    like = Likeness(num, den)
    t1, t2 = _text_key()
    rows = (docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
            .select("doc_id", "text", t1.alias("t1"), t2.alias("t2")))
    signed = settle(signatures(rows, n, like), "grams-signed")
    some = signed.where("n > 0")
    classes = settle(
        some.drop("doc_id", "prefix").dropDuplicates(["d1", "d2"])
        .withColumn("name", F.concat_ws("-", F.hex("d1"), F.hex("d2"))), "grams-classes")
    # copies have the same rows here and count once
    members = some.select(F.explode("prefix").alias("h"), "d1", "band")
    # written down, so that the join shuffles both sides and can split a frequent n-gram
    shared = settle(members.groupBy("h").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi"))
                    .where("lo <> hi").select("h"), "grams-shared")
    tiles = settle(
        members.join(shared, "h").distinct().select("h", F.explode(F.array("band", F.col("band") - 1)).alias("band"), "d1"),
        "grams-tiles")
    release(shared)
    ends = settle(tiles.groupBy("h", "band").agg(
        F.min("d1").alias("lo"), F.max("d1").alias("hi"), F.count("*").alias("m")).where("lo <> hi"), "grams-ends")
    held = settle(tiles.join(ends, ["h", "band"]), "grams-held")
    release(tiles, ends)
    stars = held.select(F.col("d1").alias("a"), F.explode(F.array("lo", "hi")).alias("b")).where("a <> b").distinct()
    # in tiles of up to three classes that is all pairs: most tiles are so small, and end here
    large = held.where(f"m > {SMALL}").select("h", "band", "d1")
    likely = settle(_likely(stars, classes, like), "grams-likely")
    near = settle(likely.groupBy("a").agg(F.min("b").alias("b")), "grams-near")

    links = settle(_verified(near, classes, rows, n, like), "grams-links")
    both = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    likely, tested = likely.select(*both).distinct(), near.select(*both)
    active = None
    for nearest in (True, True, False):
        reached = components(links, "grams-components")
        of_class = classes.select("d1", "name").join(reached, F.col("name") == F.col("node"), "left").select(
            "d1", F.xxhash64(F.coalesce("component", "name")).alias("comp"))
        # classes whose d1 agrees by chance keep one of their components here; pairs only multiply
        of_class = settle(of_class.groupBy("d1").agg(F.min("comp").alias("comp")), "grams-of-class")
        known = large.join(of_class, "d1")
        if active is None:
            known = known.withColumn("active", F.lit(True))
        else:
            # of a pair that is likely now, an end had a likely partner in the first round
            known = known.join(active, "d1", "left").withColumn("active", F.col("_mark").isNotNull()).drop("_mark")
        known = settle(known, "grams-known")
        found = settle(_blocks(known, classes, like, nearest), "grams-candidates")
        release(known)
        if active is None:
            active = settle(found.select(F.explode(F.array("a", "b")).alias("d1")).distinct()
                            .withColumn("_mark", F.lit(True)), "grams-active")
        # what the first comparison found likely, as far as it is still apart
        apart = (likely.join(of_class.toDF("a", "ca"), "a").join(of_class.toDF("b", "cb"), "b")
                 .where("ca <> cb").select("a", "b"))
        new = settle(found.union(apart).distinct().join(tested, ["a", "b"], "left_anti"), "grams-untested")
        release(found, of_class)
        before, links = links, settle(links.union(_verified(new, classes, rows, n, like)), "grams-links")
        release(before)
        tested = tested.union(new)
    reached = components(links, "grams-components")
    placed = (some.select("doc_id", "n", "t1", "t2", F.concat_ws("-", F.hex("d1"), F.hex("d2")).alias("name"))
              .join(reached, F.col("name") == F.col("node"), "left")
              .select("doc_id", "n", "t1", "t2", F.coalesce("component", "name").alias("comp")))
    placed = settle(placed, "grams-placed")
    head = settle(placed.groupBy("comp").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("t1").alias("h1"),
        F.col("t2").alias("h2"))).alias("head")), "grams-heads")
    out = placed.join(head, "comp").select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_grams"), F.col("head.id").alias("component_id"), "t1", "t2",
        (F.col("doc_id").eqNullSafe(F.col("head.id")) & (F.col("t1") == F.col("head.h1"))
         & (F.col("t2") == F.col("head.h2"))).alias("first"))
    lone = signed.where("n = 0").select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_grams"), F.col("doc_id").alias("component_id"), "t1", "t2",
        F.lit(True).alias("first"))
    return out.union(lone)


def firsts(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that stand for their component; one row of equal ones."""
    found = groups(docs, n, num, den, id_col, text_col)
    heads = (found.where("first and n_grams > 0")
             .select(F.col(id_col).alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"))
             .dropDuplicates())
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = packed(docs, _id=docs[id_col], _t1=F.xxhash64(text), _t2=F.xxhash64(F.lit(1), text),
                  _worded=F.trim(text, F.lit(SPACES)) != "")
    match = ((rows._t1 == heads._t1) & (rows._t2 == heads._t2) & rows._id.eqNullSafe(heads._id))
    kept = rows.where("_worded").join(heads, match, "left_semi").dropDuplicates(["_id", "_t1", "_t2"])
    return unpacked(kept.union(rows.where("not _worded")), docs)
