"""Event-time operators on streams: congestion windows, de-duplication, scoring."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from harborline import schema
from harborline.functions.exact import rounded
from harborline.operators.disruption import disruption_features, score_disruption


def congestion_stream(stream: DataFrame, slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Congestion per location over sliding seven-day windows; late rows are dropped."""
    held = F.coalesce(F.col("event_type").isin(schema.CONGESTED_EVENT_TYPES), F.lit(False))
    return (
        stream.withWatermark("event_timestamp", delay)
        .groupBy(F.window("event_timestamp", "7 days", slide), "location_name")
        .agg(F.count(F.lit(1)).alias("events"), F.count_if(held).alias("held"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "location_name",
            "events",
            rounded((F.lit(0.8) * F.col("held") + F.lit(0.2) * (F.col("events") - F.col("held"))) / F.col("events"), 6)
            .alias("congestion"),
        )
    )


def dedup_stream(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """First arrival of each event id within the watermark."""
    return stream.withWatermark("event_timestamp", delay).dropDuplicatesWithinWatermark(["event_id"])


def score_stream(model: PipelineModel, stream: DataFrame) -> DataFrame:
    """Disruption score of each event as it arrives."""
    return score_disruption(model, disruption_features(stream))
