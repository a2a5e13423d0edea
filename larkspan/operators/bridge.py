"""Capped adjustment of a base rate by factors: per factor, per category, in total.

Each cap is a window over the factors of an event, so all events are adjusted in one
shuffle on the event id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(value: Column, low, high) -> Column:
    """``value`` held between two bounds."""
    lift = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.greatest(lift(low), F.least(lift(high), value))


@dataclass(frozen=True)
class Caps:
    """Limits of one factor, of a category's sum, of the total, and of the result."""

    per_factor: float = 0.10
    per_category: float = 0.15
    total: float = 0.25
    floor: float = 0.01
    ceiling: float = 0.99

    def __post_init__(self) -> None:
        if min(self.per_factor, self.per_category, self.total) < 0:
            raise ValueError("caps can't be negative")
        if not 0 <= self.floor < self.ceiling <= 1:
            raise ValueError("floor and ceiling must be ordered within [0, 1]")


def capped_factors(factors: DataFrame, caps: Caps | None = None) -> DataFrame:
    """``factors`` (``event_id, pos, name, delta, category``) with ``applied`` and what was capped.

    Sums are rounded to 12 digits, so whether one exceeds its cap doesn't depend on the order of
    adding. A null category isn't summed; an empty one is summed and reported, but its members are not scaled.
    """
    caps = caps or Caps()
    own = Window.partitionBy("event_id", "category")
    event = Window.partitionBy("event_id")
    # One shuffle by event: it also brings each category of an event together, for all windows below and the sums of ``adjust``.
    f = factors.repartition("event_id").withColumn("_one", clamp(F.col("delta"), -caps.per_factor, caps.per_factor))
    f = f.withColumn("factor_capped", F.col("_one") != F.col("delta"))
    f = f.withColumn("_sum", F.when(F.col("category").isNotNull(), F.round(F.sum("_one").over(own), 12)))
    f = f.withColumn("category_capped", F.coalesce(F.abs("_sum") > caps.per_category, F.lit(False)))
    scale = F.when(F.col("category_capped") & (F.col("category") != ""), F.lit(caps.per_category) / F.abs("_sum")).otherwise(1.0)
    f = f.withColumn("_two", F.col("_one") * scale)
    f = f.withColumn("_raw", F.round(F.sum("_two").over(event), 12)).withColumn("_total", clamp(F.col("_raw"), -caps.total, caps.total))
    f = f.withColumn("total_capped", F.col("_total") != F.col("_raw"))
    applied = F.when(F.col("total_capped"), F.col("_two") * F.col("_total") / F.col("_raw")).otherwise(F.col("_two"))
    return f.withColumn("applied", applied).drop("_one", "_sum", "_two")


def adjust(events: DataFrame, factors: DataFrame, caps: Caps | None = None) -> DataFrame:
    """One row per event of ``events`` (``event_id, base_rate``): ``probability, total_adjustment, applied, capped``.

    ``applied`` lists (name, delta) in input order; ``capped`` lists factors in input order,
    then categories by first appearance, then "total".
    """
    caps = caps or Caps()
    f = capped_factors(factors, caps)
    first = F.when(F.col("category_capped"), F.min("pos").over(Window.partitionBy("event_id", "category")))
    f = f.withColumn("_first", first)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "name", F.col("applied").alias("delta"))))
    names = F.array_sort(F.collect_list(F.when(F.col("factor_capped"), F.struct("pos", "name"))))
    kinds = F.array_sort(F.collect_set(F.when(F.col("category_capped"), F.struct(F.col("_first").alias("pos"), F.col("category").alias("name")))))
    summed = f.groupBy("event_id").agg(
        ordered.alias("_applied"), names.alias("_names"), kinds.alias("_kinds"), F.max("_total").alias("_t"), F.max("total_capped").alias("_tc")
    )
    out = events.join(summed.withColumnRenamed("event_id", "_event"), F.col("event_id") == F.col("_event"), "left")
    total = F.coalesce("_t", F.lit(0.0))
    name = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<pos:bigint,name:string>>")), lambda x: x["name"].cast("string"))
    return out.select(
        "event_id",
        "base_rate",
        clamp(F.col("base_rate") + total, caps.floor, caps.ceiling).alias("probability"),
        total.alias("total_adjustment"),
        F.transform("_applied", lambda x: F.struct(x["name"].alias("name"), x["delta"].alias("delta"))).alias("applied"),
        F.concat(name("_names"), name("_kinds"), F.when(F.coalesce("_tc", F.lit(False)), F.array(F.lit("total"))).otherwise(F.array().cast("array<string>"))).alias("capped"),
    )


def unadjusted(events: DataFrame) -> DataFrame:
    """The base rate as the probability."""
    return events.select("event_id", "base_rate", F.col("base_rate").alias("probability"))


def uncapped(events: DataFrame, factors: DataFrame) -> DataFrame:
    """The base rate and the plain sum of the factors, held in [0, 1]."""
    sums = factors.groupBy(F.col("event_id").alias("_event")).agg(F.sum("delta").alias("_sum"))
    out = events.join(sums, F.col("event_id") == F.col("_event"), "left")
    return out.select("event_id", "base_rate", clamp(F.col("base_rate") + F.coalesce("_sum", F.lit(0.0)), 0.0, 1.0).alias("probability"))
