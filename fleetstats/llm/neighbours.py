"""Nearest vectors by cosine, through cross-polytope hashing.

A table of the index turns every unit vector by a pseudo-rotation, three rounds of random
signs and a fast Hadamard transform, and files it under the signed axis it then lies nearest
to. A query looks into the axes nearest to itself in each table; what lies there is measured
exactly. Rows go to blocks of bounded size by hash, each with its share of all tables, so a
crowded axis is spread over all blocks; queries stream past every block.

Equal vectors are one class, indexed and searched once, of which the smallest ids are kept:
a vector that a third of all rows hold costs no more than any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import settle

#: Tables of the index, and the axes a query looks into in each.
TABLES, PROBES = 16, 6
#: Rows of a block: small tables are cut for the sake of parallel work, large ones for memory.
LEAST_ROWS, MOST_CELLS, WANTED_BLOCKS = 2048, 1 << 24, 64
#: Scores closer than this are told apart by the exact measure only.
_CLOSE = 1e-12
_CELLS = 1 << 22


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of every row; the width is a power of two."""
    width, half = x.shape[1], 1
    while half < width:
        pairs = x.reshape(len(x), width // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), width)
        half *= 2
    return x / np.sqrt(width)


class Rotation:
    """One pseudo-rotation; the same for a table's number and width everywhere."""

    def __init__(self, table: int, dim: int):
        self.dim, self.width = dim, 1 << max(0, dim - 1).bit_length()
        self.signs = np.random.default_rng([table, self.width]).choice([-1.0, 1.0], (3, self.width))

    def turn(self, unit: np.ndarray) -> np.ndarray:
        out = np.zeros((len(unit), self.width))
        out[:, :self.dim] = unit
        for signs in self.signs:
            out = _hadamard(out * signs)
        return out

    def axis(self, unit: np.ndarray) -> np.ndarray:
        """The nearest signed axis: twice its number, plus one where the coordinate is negative."""
        turned = self.turn(unit)
        best = np.abs(turned).argmax(axis=1)
        return 2 * best + (turned[np.arange(len(unit)), best] < 0)

    def axes(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` nearest signed axes of every row."""
        turned = self.turn(unit)
        both = np.stack([turned, -turned], axis=2).reshape(len(unit), 2 * self.width)
        if probes >= both.shape[1]:
            return np.tile(np.arange(both.shape[1]), (len(unit), 1))
        return np.argpartition(-both, probes - 1, axis=1)[:, :probes]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows brought near one by a power of two, which changes no cosine and no rounding."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows in pairs, in double precision; a pair's figure does not depend on its place."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


class Block:
    """The rows of a block, filed under axes in every table."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, tables: int):
        self.keys, self.vectors = keys, scaled(vectors)
        self.unit = self.vectors / np.sqrt((self.vectors * self.vectors).sum(axis=1))[:, None]
        self.tables = []
        for t in range(tables):
            rotation = Rotation(t, vectors.shape[1])
            axis = np.concatenate([rotation.axis(self.unit[i:i + 65536]) for i in range(0, len(self.unit), 65536)])
            order = np.argsort(axis, kind="stable")
            self.tables.append((rotation, order, np.searchsorted(axis[order], np.arange(2 * rotation.width + 1))))

    def search(self, vectors: np.ndarray, k: int, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the k best of each query among its candidates, and of ties with the last."""
        found = [self._some(vectors[at:at + 2048], k, probes) for at in range(0, len(vectors), 2048)]
        query, row, score = zip(*found)
        return np.concatenate([q + 2048 * n for n, q in enumerate(query)]), np.concatenate(row), np.concatenate(score)

    def _some(self, vectors: np.ndarray, k: int, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        queries = scaled(vectors)
        unit = queries / np.sqrt((queries * queries).sum(axis=1))[:, None]
        found = [np.zeros((2, 0), np.int64)]
        for rotation, order, starts in self.tables:
            asked = rotation.axes(unit, probes)
            by_axis = np.argsort(asked, axis=None, kind="stable")
            ends = np.searchsorted(asked.ravel()[by_axis], np.arange(2 * rotation.width + 1))
            for axis in range(2 * rotation.width):
                rows = order[starts[axis]:starts[axis + 1]]
                mine = by_axis[ends[axis]:ends[axis + 1]] // asked.shape[1]
                step = max(1, _CELLS // max(1, len(rows)))
                for at in range(0, len(mine) if len(rows) else 0, step):
                    some = mine[at:at + step]
                    score = unit[some] @ self.unit[rows].T
                    if len(rows) > k:
                        last = np.partition(score, len(rows) - k, axis=1)[:, len(rows) - k]
                        q, r = np.nonzero(score >= last[:, None] - _CLOSE)
                    else:
                        q, r = np.nonzero(np.ones_like(score, bool))
                    found.append(np.stack([some[q], rows[r]]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        query, row = pairs
        score = np.concatenate([np.zeros(0)] + [
            cosines(queries[query[i:i + 65536]], self.vectors[row[i:i + 65536]]) for i in range(0, len(query), 65536)])
        order = np.lexsort((-score, query))
        query, row, score = query[order], row[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = np.full(len(vectors), -np.inf)
        last[query[place == k - 1]] = score[place == k - 1]
        keep = score >= last[query]
        return query[keep], row[keep], score[keep]


def _vectors(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _search(blocks: DataFrame, k: int, tables: int, probes: int) -> DataFrame:
    """(q1, q2, c1, c2, score) from (block, dim, asks, h1, h2, v), rows of a block before the queries."""
    def run(batches):
        now, parts, block = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "dim", "asks")], axis=1)
            cuts = np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)] if len(key) else []):
                some = batch.slice(a, b - a)
                of, dim, asks = key[a].tolist()
                if (of, dim) != now:
                    now, parts, block = (of, dim), [], None
                names = np.stack([some.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2")], axis=1)
                vectors = _vectors(some.column("v"), dim)
                if not asks:
                    parts.append((names, vectors))
                    continue
                if block is None and parts:
                    block = Block(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), tables)
                    parts = []
                if block is not None:
                    query, row, score = block.search(vectors, k, probes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (*names[query].T, *block.keys[row].T, score)],
                        names=["q1", "q2", "c1", "c2", "score"])

    return blocks.mapInArrow(run, "q1 bigint, q2 bigint, c1 bigint, c2 bigint, score double")


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, h1, h2) of the rows that take part; equal vectors have equal hashes."""
    kind = rows.schema[vector_col].dataType.elementType.simpleString()
    kind = "float" if kind == "float" else "double"
    v = rows[vector_col].cast(f"array<{kind}>")
    out = rows.select(rows[id_col].cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = out.where(~bad & F.exists("v", lambda x: x != 0))
    # minus zero is zero
    plain = F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x))
    return out.withColumn("v", plain).select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))


def nearest(rows: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding",
            tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): of every row whose id ``every`` divides, the k nearest other rows found.

    ``score`` is the cosine of the original vectors in double precision; nearest first, ties
    to the smaller id. With k or fewer candidates all are returned: a query that finds too few
    in its axes looks into all axes of a table. Null ids, null, empty and zero vectors, and those with
    null or non-finite components take no part. Vectors of different lengths are not measured
    against each other. Repeated rows count once; of rows that share an id but not the vector,
    the nearest counts, and a query's own id never does. Other columns are ignored. An empty
    table gives no rows.
    """
    spark = rows.sparkSession
    taken = valid(rows, id_col, vector_col)
    # k + 1 ids of a class are enough: one of them may be the query's own
    first = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    members = settle(taken.select("h1", "h2", "id").distinct().withColumn("n", first).where(F.col("n") <= k + 1), "near-members")
    classes = settle(
        taken.join(members.where("n = 1").select("h1", "h2", "id"), ["h1", "h2", "id"], "left_semi")
        .dropDuplicates(["h1", "h2"]).select("h1", "h2", "v", F.size("v").alias("dim")), "near-classes")
    n, dim = classes.agg(F.count("*"), F.max("dim")).first()
    count = max(-(-n * (dim or 1) // MOST_CELLS), min(WANTED_BLOCKS, -(-n // LEAST_ROWS)), 1)
    asking = taken.where(F.pmod("id", F.lit(every)) == 0).select("h1", "h2", F.col("id").alias("query_id")).distinct()
    asking = settle(asking, "near-queries")
    filed = classes.select(F.pmod(F.xxhash64("h1", "h2"), F.lit(count)).cast("int").alias("block"), "dim", F.lit(0).alias("asks"), "h1", "h2", "v")

    def found(queries: DataFrame, most: int, tables: int, probes: int) -> DataFrame:
        """(q1, q2, best): the k + 1 nearest ids of each query class among ``most`` classes, as pairs of score and id."""
        asked = (classes.join(queries, ["h1", "h2"], "left_semi")
                 .select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block"), "dim", F.lit(1).alias("asks"), "h1", "h2", "v"))
        dealt = filed.union(asked).repartition(count, "block").sortWithinPartitions("block", "dim", "asks")
        pairs = _search(dealt, most, tables, probes)
        near = pairs.withColumn("r", F.rank().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score")))).where(F.col("r") <= most)
        ids = (near.join(members.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "id"), ["c1", "c2"])
               .groupBy("q1", "q2", "id").agg(F.max("score").alias("score")))
        best = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "id"))
        return settle(ids.withColumn("r", best).where(F.col("r") <= k + 1)
                      .groupBy("q1", "q2").agg(F.collect_list(F.struct("score", "id")).alias("best")), "near-found")

    lists = found(asking, k + 1, tables, probes)
    # those with fewer than there may be look into every axis
    short = (asking.select("h1", "h2").distinct().join(lists.select(F.col("q1").alias("h1"), F.col("q2").alias("h2"), F.size("best").alias("got")), ["h1", "h2"], "left")
             .where(F.coalesce("got", F.lit(0)) <= k).select("h1", "h2"))
    short = settle(short, "near-short")
    if not short.isEmpty():
        rest = lists.join(short, (lists.q1 == short.h1) & (lists.q2 == short.h2), "left_anti")
        # all axes of one table hold every row; ids that several classes share count once each
        shared = members.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        lists = rest.union(found(short, (k + 1) * shared, 1, 1 << 30))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (asking.join(lists, (asking.h1 == lists.q1) & (asking.h2 == lists.q2)).select("query_id", F.explode("best").alias("b"))
            .select("query_id", F.col("b.id").alias("vec_id"), F.col("b.score").alias("score")).where("vec_id <> query_id")
            .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
