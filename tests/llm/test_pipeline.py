"""The corpus pipeline and what the registered queries promise."""

from __future__ import annotations

import random

import corpus_pipeline
import __spark_entry__ as entry
from fleetstats.llm import byte_bpe, queries


def tables(spark, path, docs):
    rng = random.Random(12)
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        f"{path}/documents.parquet")
    labels = [(d, int("!!" not in (t or ""))) for d, t, *_ in docs if d is not None]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{path}/labels.parquet")
    item = " ".join("".join(rng.choice("klmnop") for _ in range(5)) for _ in range(30))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return item


def line(rng):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(3, 8))) for _ in range(12))


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(13)
    item = " ".join("".join(random.Random(12).choice("klmnop") for _ in range(5)) for _ in range(1))
    docs = [(n, "\n".join(line(rng) for _ in range(4)), "en", "s", 0) for n in range(60)]
    docs += [(n, " ".join(w.upper() + "!!" for w in line(rng).split()), "en", "s", 0) for n in range(100, 140)]
    item = tables(spark, str(tmp_path / "a"), docs)
    near = docs[3][1].replace("\n", " ").split()
    near[5] = "changed"
    docs += [
        (200, docs[7][1], "en", "s", 0),                                    # an exact copy: all its lines go
        (201, docs[1][1] + "\n" + line(rng), "en", "s", 0),                 # keeps its last line only
        (202, docs[3][1].replace("\n", " "), "en", "s", 0), (203, " ".join(near), "en", "s", 0),   # near copies of each other
        (204, line(rng) + " " + item + " " + line(rng), "en", "s", 0),      # a benchmark passage
        (205, None, None, None, None), (None, "\n".join(line(rng) for _ in range(3)), None, "s", 0),
    ]
    tables(spark, str(tmp_path / "b"), docs)
    out = corpus_pipeline.run(spark, str(tmp_path / "b"))
    rows = {r.doc_id: r for r in out.collect()}
    kept = {d for d, *_ in docs if d is None or d < 60} | {201, 202, 205}
    assert set(rows) - {202, 203} == kept - {202} and len({202, 203} & set(rows)) == 1
    ranks = byte_bpe.read_ranks()
    pieces = sorted(ranks, key=ranks.get)
    texts = {d: t for d, t, *_ in docs}
    for d in (0, 5, None):
        assert b"".join(pieces[i] for i in rows[d].ids).decode() == texts[d]
    assert b"".join(pieces[i] for i in rows[201].ids).decode() == texts[201].split("\n")[-1]
    assert rows[205].n_tokens == 0


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = [(n, line(random.Random(n)), "en", "s", 0) for n in range(5)]
    tables(spark, str(tmp_path), docs)
    at = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "1 as _deleted", "2 as doc", "3 as t")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, at, str(tmp_path)).columns == at.columns
        assert stage(spark, at.where("false"), str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    found = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in found if k.startswith("op")}
    assert found["pipeline"] is corpus_pipeline.run
    assert set(queries.ORACLES) <= set(queries.QUERIES)
