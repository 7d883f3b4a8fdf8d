"""Arrival estimates for a whole shipment table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from harborline import schema
from harborline.functions.exact import rounded
from harborline.functions.scalars import is_late
from harborline.operators.browse import moment
from harborline.session import spool

DEFAULT_KM, DEFAULT_CONGESTION, DEFAULT_WEATHER, DEFAULT_STOPS, DEFAULT_MODE = 5000.0, 0.3, 0.2, 2, "sea"
MEAN_STOP_HOURS = 5.0
OPTIMISTIC, PESSIMISTIC = 0.85, 1.28


def eta(shipments: DataFrame, as_of: datetime, stop_hours: float = MEAN_STOP_HOURS) -> DataFrame:
    """Hours to arrival, three scenarios and their factors per shipment."""
    mode = F.coalesce("transport_mode", F.lit(DEFAULT_MODE))
    speed = F.lit(schema.OTHER_SPEED_KMH)
    for name, kmh in schema.SPEED_KMH.items():
        speed = F.when(mode == name, F.lit(kmh)).otherwise(speed)
    inputs = shipments.select(
        "shipment_id",
        "carrier",
        mode.alias("transport_mode"),
        F.coalesce(F.col("distance_km").cast("double"), F.lit(DEFAULT_KM)).alias("km"),
        F.coalesce(F.col("port_congestion").cast("double"), F.lit(DEFAULT_CONGESTION)).alias("c"),
        F.coalesce(F.col("weather_severity").cast("double"), F.lit(DEFAULT_WEATHER)).alias("w"),
        F.coalesce(F.col("num_stops").cast("bigint"), F.lit(DEFAULT_STOPS)).alias("stops"),
        speed.alias("speed"),
    )
    km, c, w = F.col("km"), F.col("c"), F.col("w")
    slowed = F.col("speed") * (1 - F.lit(0.3) * c) * (1 - F.lit(0.2) * w)
    timed = inputs.withColumns(
        {"travel": km / slowed, "stopped": F.col("stops") * F.lit(float(stop_hours))}
    ).withColumn("total", F.col("travel") + F.col("stopped"))
    total, travel = F.col("total"), F.col("travel")
    return timed.select(
        "shipment_id",
        "carrier",
        "transport_mode",
        F.timestamp_add("SECOND", F.floor(total * 3600 + F.lit(0.5)), moment(as_of)).alias("eta"),
        rounded(total, 1).alias("eta_hours"),
        rounded(total * OPTIMISTIC, 1).alias("optimistic_hours"),
        rounded(total * PESSIMISTIC, 1).alias("pessimistic_hours"),
        rounded(c * F.lit(0.5) + w * F.lit(0.3), 3).alias("delay_risk"),
        rounded(km / F.col("speed"), 1).alias("distance_hours"),
        rounded(travel * F.lit(0.3) * c, 1).alias("congestion_hours"),
        rounded(travel * F.lit(0.2) * w, 1).alias("weather_hours"),
        rounded(F.col("stopped"), 1).alias("stop_hours"),
    )


def on_time_rate(shipments: DataFrame, min_group: int = 30) -> DataFrame:
    """Measured on-time share by carrier and mode; the mode's share for small groups."""
    pairs = shipments.groupBy(
        "carrier", F.coalesce("transport_mode", F.lit(DEFAULT_MODE)).alias("transport_mode")
    ).agg(
        F.count(F.lit(1)).alias("shipments"),
        F.count_if(~is_late(F.col("status"))).alias("on_time"),
    )
    mode = Window.partitionBy("transport_mode")
    own = F.col("on_time") / F.col("shipments")
    usual = F.sum("on_time").over(mode) / F.sum("shipments").over(mode)
    return pairs.select(
        "carrier",
        "transport_mode",
        "shipments",
        rounded(F.when(F.col("shipments") >= min_group, own).otherwise(usual), 2).alias("on_time_probability"),
    )


def with_on_time(estimates: DataFrame, rates: DataFrame) -> DataFrame:
    """Add the on-time probability; the rate table is written first, so its size is known."""
    rates = spool(rates.select("carrier", "transport_mode", "on_time_probability"), "on-time")
    return estimates.join(rates, ["carrier", "transport_mode"], "left")
