"""Sums over a threshold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_positive_excess(score: Column, threshold: float) -> Column:
    """Aggregate: the sum of score - threshold where positive; NaN and null add nothing."""
    # Spark orders NaN above every number, so it is kept out by name.
    over = ~F.isnan(score) & (score > F.lit(float(threshold)))
    return F.coalesce(F.sum(F.when(over, score.cast("double") - F.lit(float(threshold))).otherwise(0.0)), F.lit(0.0))
