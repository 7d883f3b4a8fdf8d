"""Table sizes and source health."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from harborline.sources.views import small_table

STATS = ["table_name", "row_count", "size_bytes", "error"]


def _typed(df: DataFrame) -> DataFrame:
    return df.select(
        "table_name",
        F.col("row_count").cast("bigint").alias("row_count"),
        F.col("size_bytes").cast("bigint").alias("size_bytes"),
        F.col("error").cast("string").alias("error"),
    )


def frame_stats(name: str, df: DataFrame) -> DataFrame:
    """Rows and bytes of a file-backed DataFrame, from one scan of the file metadata."""
    files = df.groupBy("_metadata.file_path").agg(
        F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("bytes")
    )
    return _typed(
        files.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum("bytes"), F.lit(0)).alias("size_bytes"),
        ).select(F.lit(name).alias("table_name"), "*", F.lit(None).alias("error"))
    )


def frames_stats(frames: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (frame_stats(n, df) for n, df in frames.items()))


def table_stats(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Rows and bytes of catalog tables; an unreadable one gives 0 and the error."""
    parts = []
    for name in names:
        try:
            parts.append(frame_stats(name, spark.table(name)))
        except PySparkException as failure:
            row = (name, 0, None, failure.getCondition() or type(failure).__name__)
            parts.append(_typed(small_table(spark, STATS, [row])))
    return reduce(DataFrame.unionByName, parts)


def rows_loaded(spark: SparkSession, name: str) -> DataFrame:
    return table_stats(spark, [name]).select("table_name", F.col("row_count").alias("rows_loaded"))


def source_status(registry: DataFrame, stats: DataFrame) -> DataFrame:
    """The source registry with the state of each source's table."""
    rows = F.coalesce("row_count", F.lit(0).cast("bigint"))
    return registry.join(stats, "table_name", "left").select(
        "source",
        "name",
        "frequency",
        "table_name",
        rows.alias("row_count"),
        F.coalesce("size_bytes", F.lit(0).cast("bigint")).alias("table_size"),
        F.when(F.col("table_name").isNull(), "no_table")
        .when(F.col("error").isNotNull() | F.col("row_count").isNull(), "db_unavailable")
        .when(rows > 0, "healthy")
        .otherwise("empty").alias("status"),
    )
