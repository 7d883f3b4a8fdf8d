"""Where the risk is: heatmap and bottlenecks per location."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from harborline.functions.exact import exact_mean, rounded
from harborline.functions.scalars import advice, clamp, level, short_id
from harborline.operators.browse import valid_coords
from harborline.operators.ranking import latest

BASE_RISK = 0.35
UNKNOWN_RISK = 0.3
WORST_DELAY_HOURS = 48.0
PORT_DELAY_HOURS = 12.0


def _newest(events: DataFrame, window: int | None) -> DataFrame:
    return events if window is None else latest(events, "event_timestamp", "event_id", window)


def risk_heatmap(events: DataFrame, window: int | None = None, min_events: int = 5, top: int = 200) -> DataFrame:
    """Mean position and risk of each location, over all or the newest located events."""
    located = _newest(
        events.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()), window
    )
    spots = (
        valid_coords(located)
        .groupBy("location_name")
        .agg(
            exact_mean(F.col("latitude")).alias("lat"),
            exact_mean(F.col("longitude")).alias("lon"),
            exact_mean(F.coalesce(F.col("risk_score_delta"), F.lit(0.0)) + F.lit(BASE_RISK)).alias("raw"),
            F.count(F.lit(1)).alias("event_count"),
            F.count_if("anomaly_flag").alias("anomaly_count"),
        )
        .where(F.col("event_count") >= min_events)
        .orderBy(F.col("raw").desc_nulls_first(), "location_name")
        .limit(top)
    )
    intensity = clamp(F.coalesce(F.nullif("raw", F.lit(0.0)), F.lit(UNKNOWN_RISK)))
    return spots.select(
        rounded(F.col("lat"), 4).alias("lat"),
        rounded(F.col("lon"), 4).alias("lon"),
        rounded(intensity, 3).alias("intensity"),
        F.col("location_name").alias("region"),
        "event_count",
        "anomaly_count",
        level(intensity).alias("type"),
    )


def bottlenecks(events: DataFrame, window: int | None = None, min_events: int = 3, top: int = 15) -> DataFrame:
    """Locations with the longest mean delay, over all or the newest events."""
    spots = (
        _newest(events, window)
        .where(F.col("delay_added_hours") > 0)
        .groupBy("location_name")
        .agg(
            exact_mean(F.col("latitude")).alias("lat"),
            exact_mean(F.col("longitude")).alias("lon"),
            exact_mean(F.col("delay_added_hours")).alias("delay"),
            exact_mean(F.coalesce(F.col("port_wait_hours"), F.lit(0.0))).alias("wait"),
            F.count(F.lit(1)).alias("event_count"),
            F.count_if("anomaly_flag").alias("anomaly_count"),
            F.max("event_timestamp").alias("last_seen"),
        )
        .where(F.col("event_count") >= min_events)
        .orderBy(F.col("delay").desc_nulls_first(), "location_name")
        .limit(top)
    )
    severity = F.least(F.lit(1.0), F.col("delay") / F.lit(WORST_DELAY_HOURS))
    zero = F.lit(0.0)
    return spots.select(
        short_id(F.col("location_name")).alias("id"),
        F.col("location_name").alias("location"),
        rounded(F.coalesce("lat", zero), 4).alias("lat"),
        rounded(F.coalesce("lon", zero), 4).alias("lon"),
        level(severity).alias("severity"),
        rounded(severity, 3).alias("severity_score"),
        rounded(F.col("delay"), 1).alias("avg_delay_hours"),
        rounded(F.col("wait"), 1).alias("avg_port_wait_hours"),
        "event_count",
        "anomaly_count",
        rounded(F.col("delay") * 1.5, 1).alias("estimated_clearance_hours"),
        "last_seen",
        advice(severity).alias("recommendation"),
        F.when(F.col("delay") > PORT_DELAY_HOURS, "port_congestion").otherwise("transit_delay").alias("type"),
    )
