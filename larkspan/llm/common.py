"""Helpers that several corpus operators share."""

from __future__ import annotations

import bisect

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64


class HashCache(dict):
    """word -> 64-bit hash; emptied when it holds ``limit`` words, so memory stays bounded."""

    def __init__(self, limit: int = 400_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (two multiply-and-shift rounds)."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def ascii_words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case: runs of anything but space and \\t \\n \\v \\f \\r."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def gumbel(uniform: Column) -> Column:
    """A standard Gumbel draw from a uniform one in [0, 1)."""
    u = F.greatest(uniform, F.lit(1e-12))
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, col: str, k: int, few: int = 10_000, bins: int = 4096) -> float | None:
    """The k-th largest value of a double column, exactly; each pass brings at most ``bins`` counts to the driver.

    Nulls and NaNs don't count. None if there are fewer than ``k`` values or ``k`` is below 1.
    """
    values = df.select(F.col(col).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    n, low, high = values.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if k < 1 or n < k:
        return None
    while True:
        inside = values.filter((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high)))
        if low == high:
            return low
        if n <= few:
            return sorted((r[0] for r in inside.collect()), reverse=True)[k - 1]
        width = (high - low) / bins
        counted = inside.groupBy(F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
        )
        rows = sorted(counted.collect(), key=lambda r: -r["b"])
        seen = np.cumsum([r["n"] for r in rows])
        at = bisect.bisect_left(seen.tolist(), k)
        k -= int(seen[at - 1]) if at else 0
        n, low, high = rows[at]["n"], rows[at]["low"], rows[at]["high"]
