"""Calibration of forecasts ``prediction`` (double in [0, 1]) against ``outcome`` (boolean)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.operators.checks import assert_none


def check_forecasts(forecasts: DataFrame) -> None:
    """ValueError for an empty log, a null, or a prediction outside [0, 1]."""
    if forecasts.isEmpty():
        raise ValueError("no forecasts")
    assert_none(forecasts, **{"prediction outside [0, 1]": F.col("prediction").between(0, 1), "no outcome": F.col("outcome").isNotNull()})


def brier_score(forecasts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``brier``: the mean squared error, for each group of ``by``."""
    return forecasts.groupBy(*(by or [])).agg(F.avg(F.pow(F.col("prediction") - F.col("outcome").cast("double"), F.lit(2.0))).alias("brier"))


def reliability(forecasts: DataFrame, n_buckets: int = 10, by: list[str] | None = None) -> DataFrame:
    """``bucket, low, high, n, mean_prediction, observed, gap``; empty buckets have no row."""
    if n_buckets < 1:
        raise ValueError("n_buckets must be positive")
    width = 1.0 / n_buckets
    bucket = F.least(F.floor(F.col("prediction") / F.lit(width)), F.lit(n_buckets - 1)).cast("long")
    table = forecasts.groupBy(*(by or []), bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean_prediction"), F.avg(F.col("outcome").cast("double")).alias("observed")
    )
    return table.select(
        *(by or []), "bucket", (F.col("bucket") * F.lit(width)).alias("low"), ((F.col("bucket") + 1) * F.lit(width)).alias("high"),
        "n", "mean_prediction", "observed", (F.col("mean_prediction") - F.col("observed")).alias("gap"),
    )


def reliability_summary(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``max_gap`` and ``weighted_gap`` of a reliability table."""
    return table.groupBy(*(by or [])).agg(
        F.max(F.abs("gap")).alias("max_gap"), (F.sum(F.abs("gap") * F.col("n")) / F.sum("n")).alias("weighted_gap")
    )


def hit_rate(forecasts: DataFrame, reference: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """``hit_rate``: how often the outcome lies on the prediction's side of ``reference``; 0 where none has a side."""
    right = F.when(F.col("prediction") != reference, ((F.col("prediction") > reference) == F.col("outcome")).cast("double"))
    return forecasts.groupBy(*(by or [])).agg(F.coalesce(F.avg(right), F.lit(0.0)).alias("hit_rate"))
