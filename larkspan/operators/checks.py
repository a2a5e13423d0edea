"""Plan-time and data checks that operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: list[str], name: str) -> None:
    """ValueError unless ``df`` has the columns; no job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} has no column {', '.join(missing)}; there are {', '.join(df.columns)}")


def violations(df: DataFrame, **rules) -> DataFrame:
    """``rule, n``: how many rows break each named boolean column expression (null counts as broken)."""
    counted = df.agg(*[F.sum(F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)).alias(name) for name, ok in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("n")) for n in rules])
    return counted.select(F.inline(pairs))


def assert_none(df: DataFrame, **rules) -> None:
    """ValueError naming the rules that rows break; one aggregation."""
    broken = [f"{r['rule']} ({r['n']} rows)" for r in violations(df, **rules).collect() if r["n"]]
    if broken:
        raise ValueError("; ".join(broken))
