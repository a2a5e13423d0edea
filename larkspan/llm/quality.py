"""Quality selection by importance resampling over hashed n-grams.

Two bag-of-n-grams models are counted over ``buckets`` hashed words and word pairs: one of
the target (labelled good documents), one of all raw documents. A document's importance is
the log ratio of its n-grams under both, and documents are resampled without replacement:
Gumbel noise is added to the log importance and the ``k`` largest stay. By default ``k`` is
the expected number of documents that a sampler accepting with probability min(1, weight)
would accept, so documents that the target explains at least as well as the raw corpus
stay and the rest compete by their weights.

Both models are counts over every document. The target is the labelled rows (at most
``max_labels`` of them, chosen by hash; documented bound), so their ids may be broadcast.
Model vectors have ``buckets`` entries whatever the corpus size.

Defined results: null and empty texts have no n-grams, log importance 0 and never stay
(``score`` 0, ``kept`` false); an empty table gives an empty result; without a single
labelled good document every text counts as target-like (score 0) and stays; the noise
depends on seed and ``doc_id`` alone, so repeated rows share it; ties at the k-th key all
stay; whole texts count; extra columns are ignored, labels with null id or null quality
are ignored, and a document labelled twice is good if any of its labels says so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import U64, HashCache, gumbel, kth_largest, mix64
from larkspan.llm.mixing import uniform
from larkspan.sources import materialize, table

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def ngram_buckets(text: str | None, cache: HashCache, buckets: int) -> np.ndarray:
    """Buckets of the text's words and marks and of their neighbouring pairs, with repeats."""
    words = _TOKEN.findall(text) if text else []
    if not words:
        return np.zeros(0, np.int64)
    one = cache.array(words)
    two = mix64(one[:-1] * U64(0x9E3779B97F4A7C15) + one[1:])
    return (np.concatenate([one, two]) % U64(buckets)).astype(np.int64)


def _marked(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, good``; ``targets`` has a bounded number of distinct ids in ``t_id``."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.join(F.broadcast(targets), F.col("doc_id") == F.col("t_id"), "left").select("doc_id", "text", F.col("t_id").isNotNull().alias("good"))


def count(marked: DataFrame, buckets: int) -> np.ndarray:
    """N-gram counts of all texts and of the good ones: an array of 2 x ``buckets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sums = HashCache(), np.zeros((2, buckets), np.int64)
        held, size = ([], []), 0

        def add() -> None:
            for row, parts in zip(sums, held):
                if parts:
                    row += np.bincount(np.concatenate(parts), minlength=buckets)
                parts.clear()

        for batch in batches:
            for text, good in zip(batch.column(0), batch.column(1)):
                found = ngram_buckets(text.as_py(), cache, buckets)
                size += len(found)
                for parts in held if good.as_py() else held[:1]:
                    parts.append(found)
                if size > 1_000_000:
                    add()
                    size = 0
        add()
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_pydict({"bucket": at, "raw": sums[0][at], "good": sums[1][at]})

    counted = marked.select("text", "good").mapInArrow(run, "bucket long, raw long, good long")
    out = np.zeros((2, buckets))
    for b, raw, good in counted.groupBy("bucket").agg(F.sum("raw"), F.sum("good")).collect():  # at most `buckets` rows
        out[:, b] = raw, good
    return out


def score(marked: DataFrame, counts: np.ndarray, prior: float = 100.0) -> DataFrame:
    """``doc_id, score, n_grams``: the log ratio of each whole text under the target and the raw model.

    A document doesn't vouch for itself: its own n-grams are taken out of both models first.
    Each bucket's ratio is shrunk to 1 by ``prior`` pseudo-counts, so rare n-grams that the
    labelled rows happen to miss prove nothing.
    """
    shared = marked.sparkSession.sparkContext.broadcast(counts)  # 2 x `buckets` numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, (raw, good) = HashCache(), shared.value
        share = good.sum() / max(1.0, raw.sum())
        for batch in batches:
            scores, sizes = [], []
            for text, mark in zip(batch.column(1), batch.column(2)):
                found = ngram_buckets(text.as_py(), cache, len(raw))
                b, own = np.unique(found, return_counts=True)
                target = good[b] - own if mark.as_py() else good[b]
                scores.append(float((own * np.log((target + prior) / (share * (raw[b] - own) + prior))).sum()) if share else 0.0)
                sizes.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())], names=["doc_id", "score", "n_grams"])

    return marked.mapInArrow(run, f"doc_id {marked.schema['doc_id'].dataType.simpleString()}, score double, n_grams long")


def good_ids(labels: DataFrame, max_labels: int = 200_000, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``t_id``: distinct ids of at most ``max_labels`` labelled rows that are labelled good."""
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("t_id"), F.col(label_col).alias("good"))
    if rows.limit(max_labels + 1).count() > max_labels:
        rows = rows.orderBy(F.xxhash64("t_id"), "t_id").limit(max_labels)
    return rows.filter("good = 1").select("t_id").distinct()


def select(
    docs: DataFrame,
    labels: DataFrame,
    k: int | None = None,
    buckets: int = 1 << 16,
    seed: int = 29,
    prior: float = 100.0,
    max_labels: int = 200_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, score, n_grams, key, kept``."""
    marked = _marked(docs, good_ids(labels, max_labels), id_col, text_col)
    keyed = score(marked, count(marked, buckets), prior).withColumn(
        "key", F.when(F.col("n_grams") > 0, F.col("score") + gumbel(uniform(seed, F.col("doc_id"))))
    )
    keyed = materialize(keyed, "quality")
    if k is None:
        k = round(keyed.filter("n_grams > 0").agg(F.sum(F.least(F.lit(1.0), F.exp("score")))).first()[0] or 0)
    bar = kth_largest(keyed, "key", k)
    if bar is None:  # k is 0, or there are no more documents than k
        return keyed.withColumn("kept", F.lit(k > 0) & F.col("key").isNotNull())
    return keyed.withColumn("kept", F.coalesce(F.col("key") >= F.lit(bar), F.lit(False)))


def keep_selected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that the selection keeps; columns are those of ``docs``.

    The noise decides among documents with a score below 0 only: all others stay, whatever they drew.
    """
    chosen = select(docs, labels, id_col=id_col, **options)
    kept = chosen.filter("kept OR (n_grams > 0 AND score >= 0)").select(F.col("doc_id").alias("_lk_kept")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_lk_kept"]), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return chosen.select("doc_id", F.round("score", 6).alias("score"), "n_grams", "kept")
