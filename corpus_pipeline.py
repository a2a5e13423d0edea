"""Corpus pipeline: quality classifier, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns
a DataFrame; all but the last return the columns of ``documents``, whatever others there are
beside the five that stages read.

Defined results, by stage: texts without words (null, empty, blank) are rejected by the
classifier; rows that repeat a ``doc_id`` and its text share every stage's decision, so they
stay or go together; rows without ``doc_id`` are never dropped as copies, and share the
classifier's and the mixture's decision; a null language or source is a category of its own;
very long texts count whole; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspan.llm import exact_dedup, minhash, mixing, packing, quality
from larkspan.sources import materialize, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_selected(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with identical texts, the one with the largest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-copies, the one with the smallest doc_id stays."""
    return minhash.keep_one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token weights have the target marginals."""
    return mixing.sample_mixture(docs)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in a batch of its length bucket."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing", mixture),
    ("packing", batches),
]

#: Gumbel top-k over hashed n-grams, MinHash and dynamic programming are beyond SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
