"""Benchmark reports: flattening results, ratios, newest file per machine."""

from __future__ import annotations

import platform

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
_RAW = (
    "machine_info struct<cpu:struct<brand_raw:string>>, benchmarks array<struct<name:string,params:map<string,string>,"
    "extra_info:struct<`case`:string,impl:string>,stats:struct<rounds:bigint,mean:double,median:double,stddev:double,min:double>>>"
)


def hardware_id(cpu: Column, system: Column) -> Column:
    """A folder name for a machine."""
    tidy = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), r"\((r|tm)\)", ""), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.concat_ws("-", tidy(cpu), tidy(system))


def environment(spark: SparkSession) -> dict[str, str]:
    """Versions that a result's numbers depend on."""
    java = spark._jvm.System.getProperty
    return {"spark": spark.version, "java": java("java.version"), "arch": java("os.arch"), "python": platform.python_version(), "numpy": np.__version__, "pyarrow": pa.__version__}


def convert_cases(raw: DataFrame) -> DataFrame:
    """``case, impl, params, n, mean, median, stddev, min`` of benchmark dumps; a case or impl that is missing is an error."""
    each = raw.select(F.explode("benchmarks").alias("b"))
    need = lambda c: F.coalesce(F.col(f"b.extra_info.{c}"), F.raise_error(F.concat(F.lit(f"no {c} in "), F.col("b.name"))))
    return each.select(
        need("case").cast("string").alias("case"), need("impl").cast("string").alias("impl"), F.col("b.params").alias("params"), F.col("b.stats.rounds").alias("n"),
        "b.stats.mean", "b.stats.median", "b.stats.stddev", "b.stats.min",
    )


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark dumps as written by the benchmark runner (one JSON document per file)."""
    return spark.read.schema(_RAW).option("multiLine", True).json(path)


def write_results(results: DataFrame, path: str) -> None:
    """Results as JSON lines, a folder per ``hardware_id``."""
    results.withColumn("schema", F.lit(SCHEMA_VERSION)).write.mode("append").partitionBy("hardware_id").json(path)


def speedups(cases: DataFrame, fastest: str | None = None) -> DataFrame:
    """``cases`` with ``rank, ratio`` to the fastest (or named) implementation of the case, and ``alone`` where there is no other."""
    by = Window.partitionBy("case")
    base = F.min("median").over(by) if fastest is None else F.min(F.when(F.col("impl") == fastest, F.col("median"))).over(by)
    return (
        cases.withColumn("rank", F.row_number().over(by.orderBy("median", "impl")).cast("long"))
        .withColumn("ratio", F.when(base > 0, F.col("median") / base))
        .withColumn("alone", F.count(F.lit(1)).over(by) == 1)
    )


def latest_results(files: DataFrame) -> DataFrame:
    """The newest ``file`` (by name) of each ``hardware_id``."""
    return files.groupBy("hardware_id").agg(F.max("file").alias("file"))


def relative_table(cases: DataFrame) -> DataFrame:
    """``case, impl, median, relative``: medians over the case's best, as text like "1.0x"."""
    best = F.min("median").over(Window.partitionBy("case"))
    return cases.select("case", "impl", "median", F.concat(F.format_number(F.col("median") / best, 1), F.lit("x")).alias("relative"))
