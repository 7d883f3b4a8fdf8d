"""Delay, demand and metric series, their projections and their bands."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from harborline import schema
from harborline.functions.exact import exact_mean, fixed, rounded, share
from harborline.functions.scalars import clamp, is_late
from harborline.operators.browse import moment, since
from harborline.session import spool

WEEK = 7
BASE_DEMAND = 1000.0
WEEKDAY_SWING = 0.3
DAILY_GROWTH = 0.002
RIDGE_ALPHA = 1.0
BAND_START, BAND_GROWTH = 0.03, 0.07


def rescale(df: DataFrame, column: str, by: Sequence[str], lo: float, hi: float, name: str) -> DataFrame:
    """Min-max scale of each series into [lo, hi]; a flat series maps to lo.

    The limits are aggregated and joined back: a window per series would put all
    rows of a hot series into one task.
    """
    limits = spool(
        df.groupBy(*by).agg(F.min(column).alias("_low"), F.max(column).alias("_high")), "series-limits"
    )
    spread = F.col("_high") - F.col("_low") + F.lit(1e-9)
    scaled = F.lit(lo) + (F.col(column) - F.col("_low")) / spread * F.lit(hi - lo)
    return df.join(limits, list(by), "left").withColumn(name, scaled).drop("_low", "_high")


def delay_series(shipments: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Per created date of the last days: mean delay, count, delay rate, mean risk."""
    return (
        since(shipments, "created_date", as_of, days)
        .groupBy("created_date")
        .agg(
            exact_mean(F.col("delay_hours")).alias("avg_delay"),
            F.count(F.lit(1)).alias("shipment_count"),
            share(is_late(F.col("status"))).alias("delay_rate"),
            exact_mean(F.col("risk_score")).alias("avg_risk"),
        )
        .orderBy("created_date")
    )


def demand_projection(series: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Daily demand from ``as_of`` on; a day that was observed keeps its count."""
    calendar = series.sparkSession.range(days).select(
        F.col("id").alias("step"), F.date_add(moment(as_of), F.col("id").cast("int")).alias("date")
    )
    swing = F.sin(F.lit(2 * math.pi) * F.weekday("date") / WEEK)
    base = BASE_DEMAND * (1 + WEEKDAY_SWING * swing) * (1 + DAILY_GROWTH * F.col("step"))
    observed = F.nullif(F.col("shipment_count"), F.lit(0)).cast("double")
    return calendar.join(
        series.select(F.col("created_date").alias("date"), "shipment_count"), "date", "left"
    ).select(
        "date",
        rounded(F.coalesce(observed, base), 0).cast("bigint").alias("demand_units"),
        observed.isNotNull().alias("observed"),
    )


def demand_summary(projection: DataFrame) -> DataFrame:
    """First day with the highest demand, and the mean."""
    return projection.agg(
        F.min_by("date", F.struct(-F.col("demand_units"), F.col("date"))).alias("peak_day"),
        rounded(F.sum("demand_units") / F.count(F.lit(1)), 0).cast("bigint").alias("avg_demand"),
    )


def demand_from_history(
    shipments: DataFrame, by: Sequence[str], as_of: date, days: int = 30, history: int = 364
) -> DataFrame:
    """Daily demand per lane: its weekday mean times its linear trend.

    One aggregation yields the weekday counts and the sums for the slope; days
    without a shipment count as zero, through the calendar sums.
    """
    start = as_of - timedelta(days=history)
    step = F.date_diff(F.col("created_date"), moment(start))
    sum_t = history * (history - 1) / 2
    sum_tt = (history - 1) * history * (2 * history - 1) / 6
    spread = history * sum_tt - sum_t * sum_t
    lanes = (
        since(shipments, "created_date", as_of, history)
        .where(F.col("created_date") < moment(as_of))
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(step).cast("bigint").alias("n_step"),
            F.array(*(F.count_if(F.weekday("created_date") == d) for d in range(WEEK))).alias("per_weekday"),
        )
    )
    # How often each weekday falls into the history.
    falls = F.array(
        *(F.lit(float(sum((start + timedelta(days=i)).weekday() == d for i in range(history)))) for d in range(WEEK))
    )
    weekday = F.weekday("date") + 1
    mean = F.col("n") / F.lit(float(history))
    slope = (history * F.col("n_step") - sum_t * F.col("n")) / F.lit(spread)
    trend = F.greatest(F.lit(0.0), (mean + slope * (history + F.col("step") - sum_t / history)) / mean)
    usual = F.element_at("per_weekday", weekday) / F.element_at(falls, weekday)
    return (
        lanes.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
        .withColumn("date", F.date_add(moment(as_of), F.col("step")))
        .select(*by, "date", rounded(usual * trend, 3).alias("demand_units"))
    )


def metric_series(df: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """Hourly values of a metric: from events, or from shipments for the cost index."""
    if metric == "cost_index":
        at, freight, km = F.col("created_date").cast("timestamp"), F.col("freight_cost_usd"), F.col("distance_km")
        hourly = df.groupBy(*by, F.date_trunc("hour", at).alias("hour")).agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(fixed(freight)).alias("freight"),
            F.sum(fixed(F.when(freight.isNotNull(), km))).alias("km"),
        )
        whole = Window.partitionBy(*by)

        def total(c: str) -> Column:
            return F.sum(c).over(whole).cast("double")

        own = F.try_divide(F.col("freight").cast("double"), F.col("km").cast("double"))
        value = F.try_divide(own, F.try_divide(total("freight"), total("km")))
        return hourly.select(*by, "hour", "rows", rounded(value, 6).alias("value"))
    delay, anomaly = F.coalesce("delay_added_hours", F.lit(0.0)), F.coalesce("anomaly_flag", F.lit(False))
    values = {
        "delay_probability": share(delay > 0),
        "throughput": F.count(F.lit(1)).cast("double"),
        "on_time_rate": share((delay <= 0) & ~anomaly),
    }
    return df.groupBy(*by, F.date_trunc("hour", "event_timestamp").alias("hour")).agg(
        F.count(F.lit(1)).alias("rows"), rounded(values[metric], 6).alias("value")
    )


def forecast(series: DataFrame, by: Sequence[str] = (), horizon: int = 24, alpha: float = RIDGE_ALPHA) -> DataFrame:
    """Next hours of each series from a quadratic ridge fit, all series at once.

    Power sums per series feed the closed solution of the centred 2x2 system, so
    the fit is an aggregation and some arithmetic, with no per-group Python. Hours and
    millionths of the value are whole numbers, and the centred moments n * sum(xy) -
    sum(x) * sum(y) are taken off as such, so a series of decades loses no digit.
    """
    whole = Window.partitionBy(*by)
    second = F.unix_timestamp("hour")
    integer = "decimal(38,0)"
    hours = ((second - F.min(second).over(whole)) / 3600).cast("bigint").cast(integer)
    points = series.where(F.col("value").isNotNull()).select(
        *by, "hour", hours.alias("t"), (fixed(F.col("value")) * 1_000_000).cast(integer).alias("y")
    )
    t, y = F.col("t"), F.col("y")
    powers = {"s1": t, "s2": t * t, "s3": t * t * t, "s4": t * t * (t * t), "y": y, "ty": t * y, "tty": t * t * y}
    sums = points.groupBy(*by).agg(
        F.count(F.lit(1)).cast(integer).alias("n"),
        *(F.sum(c.cast(integer)).cast(integer).alias(name) for name, c in powers.items()),
        F.max("hour").alias("last_hour"),
        F.max("t").cast("bigint").alias("last_t"),
    )
    n, s1, s2, s3, s4, y, ty, tty = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4", "y", "ty", "tty"))

    def moment_of(both: Column, one: Column, other: Column) -> Column:
        return (n * both - one * other).cast("double") / n.cast("double")

    system = sums.where(n > 0).select(
        *by, "last_hour", "last_t",
        (moment_of(s2, s1, s1) + F.lit(alpha)).alias("a11"),
        moment_of(s3, s1, s2).alias("a12"),
        (moment_of(s4, s2, s2) + F.lit(alpha)).alias("a22"),
        (moment_of(ty, s1, y) / 1e6).alias("b1"),
        (moment_of(tty, s2, y) / 1e6).alias("b2"),
        *((c.cast("double") / n.cast("double")).alias(name) for name, c in (("m1", s1), ("m2", s2))),
        (y.cast("double") / n.cast("double") / 1e6).alias("my"),
    )
    a11, a12, a22, b1, b2 = (F.col(c) for c in ("a11", "a12", "a22", "b1", "b2"))
    det = a11 * a22 - a12 * a12
    fitted = system.withColumns(
        {"w1": (b1 * a22 - b2 * a12) / det, "w2": (a11 * b2 - a12 * b1) / det}
    ).withColumn("w0", F.col("my") - F.col("w1") * F.col("m1") - F.col("w2") * F.col("m2"))
    ahead = (F.col("last_t") + F.col("step")).cast("double")
    return fitted.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(
        *by,
        "step",
        F.timestamp_add("HOUR", F.col("step"), F.col("last_hour")).alias("hour"),
        F.round(F.col("w0") + F.col("w1") * ahead + F.col("w2") * ahead * ahead, 4).alias("forecast"),
    )


def forecast_bands(
    predicted: DataFrame, metric: str, by: Sequence[str] = (), limits: tuple[float, float] | None = None
) -> DataFrame:
    """Forecast clipped to the metric's range, a widening band, trend (before the clipping) and mean.

    ``limits`` replaces the range where a series has another unit.
    """
    lo, hi = limits or schema.METRIC_RANGES.get(metric, (0.0, 1.0))
    whole = Window.partitionBy(*by)
    last_step = F.max("step").over(whole)
    clipped = predicted.withColumn("value", clamp(F.col("forecast"), lo, hi))
    progress = F.when(last_step > 1, (F.col("step") - 1) / (last_step - 1)).otherwise(F.lit(0.0))
    band = F.lit(hi - lo) * (F.lit(BAND_START) + F.lit(BAND_GROWTH) * progress)
    first, last = F.min_by("forecast", "step").over(whole), F.max_by("forecast", "step").over(whole)
    total = F.sum(fixed(F.col("value"))).over(whole).cast("double")
    return clipped.select(
        *by,
        "step",
        "hour",
        F.round("value", 4).alias("value"),
        F.round(clamp(F.col("value") + band, lo, hi), 4).alias("upper_bound"),
        F.round(clamp(F.col("value") - band, lo, hi), 4).alias("lower_bound"),
        F.when(last > first, "increasing").otherwise("decreasing").alias("trend"),
        F.round(total / F.count("value").over(whole), 4).alias("mean"),
    )


