"""The corpus pipeline: documents in, token ids of the documents worth keeping out.

Each stage takes what its predecessor kept, as written and read again, and returns the
columns of documents; the last returns token ids. Extra columns pass through to the last
stage. Documents with a null id or text go through every stage like any other: a null text
is scored as one without words. A document that line deduplication has emptied goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetstats.llm import byte_bpe, decontaminate, line_dedup, ngram_join, quality_classifier
from fleetstats.llm.common import SPACES, settle, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good, learnt from the labels that are not held out."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    score = quality_classifier.scorer(spark, model)
    return docs.where(score(docs["text"]) >= 0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are later copies of a repeated run, unless nothing is left."""
    count = "_deleted"
    while count in docs.columns:
        count += "_"
    found = line_dedup.dedup(docs, deleted_col=count, least_run_chars=20)
    emptied = (found[count] > 0) & (F.trim(found["text"], F.lit(SPACES)) == "")
    rest = found.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        length = F.when(rest[count] > 0, F.length("text")).otherwise(rest["n_chars"])
        rest = rest.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return rest.drop(count)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, four fifths in common."""
    return ngram_join.firsts(docs, n=5, num=80, den=100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of what they decode to."""
    return byte_bpe.digests(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("byte-level BPE", encode),
]

#: A learnt classifier has no SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
