"""Packing by optimal length buckets.

A global histogram of document lengths goes to the driver (at most a few thousand bins:
exact up to 255 tokens, then 128 bins per doubling), dynamic programming over it chooses
the ``n_buckets`` upper bounds that minimise total padding, and batches of at most
``token_budget`` padded tokens are filled inside each bucket.

A document's place in its bucket is the offset of its shard plus its rank in the shard.
Shards are hashes of the id, sized to about ``shard_rows`` rows, so no task sorts a whole
bucket and only one batch of each bucket is not full.

Defined results: documents are never cut - one longer than the budget is a batch of its
own; null and empty texts have length 0 and share the shortest bucket; ties in length or
repeated ids get neighbouring places in an arbitrary but complete numbering; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.llm.mixing import word_count
from larkspan.sources import materialize, table


def length_bin(n: str) -> Column:
    """The histogram bin of the length in column ``n``: itself below 256, else its 8 leading bits and its magnitude."""
    return F.expr(f"greatest(length(bin({n})) - 8, 0) * 256L + shiftright({n}, greatest(length(bin({n})) - 8, 0))")


def optimal_bounds(bins: list[tuple[int, int, int]], n_buckets: int) -> list[int]:
    """Upper bounds of at most ``n_buckets`` buckets with the least padding.

    ``bins``: (largest length, documents, tokens) of each histogram bin in ascending order.
    """
    if not bins:
        return []
    high, docs, tokens = (np.array(x, dtype=np.float64) for x in zip(*bins))
    size = len(high)
    n = np.concatenate([[0.0], np.cumsum(docs)])
    t = np.concatenate([[0.0], np.cumsum(tokens)])
    best = np.full(size + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(n_buckets, size)):
        new, cut = np.full(size + 1, np.inf), np.zeros(size + 1, np.int64)
        new[0] = 0.0
        for j in range(1, size + 1):
            cost = best[:j] + high[j - 1] * (n[j] - n[:j]) - (t[j] - t[:j])
            cut[j] = int(cost.argmin())
            new[j] = cost[cut[j]]
        cuts.append(cut)
        best = new
    bounds, j = [], size
    for cut in reversed(cuts):
        if j > 0:
            bounds.append(int(high[j - 1]))
            j = int(cut[j])
    return bounds[::-1]


def pack(
    docs: DataFrame,
    length: Column | None = None,
    n_buckets: int = 16,
    token_budget: int = 32_768,
    shard_rows: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, bucket_length, batch_id, slot, padding``."""
    slim = docs.select(F.col(id_col).alias("doc_id"), (word_count(F.col(text_col).cast("string")) if length is None else length).cast("long").alias("n_tokens"))
    slim = materialize(slim, "lengths")
    found = slim.groupBy(length_bin("n_tokens").alias("bin")).agg(
        F.max("n_tokens").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens")
    )
    bins = sorted((r["high"], r["n"], r["tokens"]) for r in found.collect())
    bounds = optimal_bounds(bins, n_buckets)
    if not bounds:
        return slim.select("doc_id", "n_tokens", *[F.lit(0).cast("long").alias(x) for x in ("bucket_length", "batch_id", "slot", "padding")])

    def by_bucket(values: list[int]) -> Column:
        out = F.lit(values[-1])
        for bound, value in list(zip(bounds, values))[-2::-1]:
            out = F.when(F.col("n_tokens") <= bound, F.lit(value)).otherwise(out)
        return out.cast("long")

    held = [sum(n for high, n, _ in bins if low < high <= bound) for low, bound in zip([-1, *bounds], bounds)]
    placed = slim.select(
        "doc_id",
        "n_tokens",
        by_bucket(list(range(len(bounds)))).alias("bucket"),
        F.pmod(F.xxhash64("doc_id"), by_bucket([max(1, -(-x // shard_rows)) for x in held])).alias("shard"),
    )
    shards = placed.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens")) - 1
    capacity = by_bucket([max(1, token_budget // max(1, b)) for b in bounds])
    first_batch, batches = [], 0
    for n, bound in zip(held, bounds):
        first_batch.append(batches)
        batches += -(-n // max(1, token_budget // max(1, bound)))
    numbered = placed.withColumn("rank", rank).join(offsets, ["bucket", "shard"]).withColumn("place", F.col("offset") + F.col("rank"))
    return numbered.select(
        "doc_id",
        "n_tokens",
        by_bucket(bounds).alias("bucket_length"),
        (by_bucket(first_batch) + F.floor(F.col("place") / capacity)).cast("long").alias("batch_id"),
        F.pmod(F.col("place"), capacity).cast("long").alias("slot"),
        (by_bucket(bounds) - F.col("n_tokens")).alias("padding"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
