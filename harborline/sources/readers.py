"""Readers for tables of unknown schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harborline.sources.views import small_table

FORMATS = ["csv", "parquet", "json"]


def read_any(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """A CSV, Parquet or JSON input; any other format gives one error row."""
    fmt = fmt.lower().lstrip(".")
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "json":
        return spark.read.option("multiLine", True).json(path)
    return small_table(spark, ["error"], [(f"Unsupported format: .{fmt}",)])
