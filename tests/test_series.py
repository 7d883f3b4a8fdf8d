from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harborline.operators import eta, series


def test_eta_formula_and_defaults(spark):
    df = spark.createDataFrame(
        [("S1", "A", "air", 1600.0, 0.5, 0.25, 1), ("S2", "A", None, None, None, None, None), ("S3", "A", "mule", 600.0, 0.0, 0.0, 0)],
        "shipment_id string, carrier string, transport_mode string, distance_km double, port_congestion double, "
        "weather_severity double, num_stops int",
    )
    got = {r.shipment_id: r for r in eta.eta(df, datetime(2001, 8, 1)).collect()}
    slowed = 800 * (1 - 0.15) * (1 - 0.05)
    assert got["S1"].eta_hours == round(1600 / slowed + 5, 1)
    assert got["S2"].eta_hours == round(5000 / (40 * 0.91 * 0.96) + 10, 1)
    assert got["S3"].eta == datetime(2001, 8, 1, 10) and got["S3"].delay_risk == 0.0


def test_on_time_uses_the_mode_for_small_groups(spark):
    rows = [("big", "sea", "Delayed")] * 15 + [("big", "sea", None)] * 15 + [("small", "sea", "Delayed")] * 10
    df = spark.createDataFrame(rows, "carrier string, transport_mode string, status string")
    got = {r.carrier: r.on_time_probability for r in eta.on_time_rate(df, min_group=30).collect()}
    assert got == {"big": 0.5, "small": 0.38}


def test_projection_keeps_observed_days(spark):
    df = spark.createDataFrame([(date(2024, 1, 2), 7), (date(2024, 1, 3), 0)], "created_date date, shipment_count bigint")
    got = {r.date: r for r in series.demand_projection(df, date(2024, 1, 1), 3).collect()}
    assert got[date(2024, 1, 1)].demand_units == 1000 and not got[date(2024, 1, 1)].observed
    assert got[date(2024, 1, 2)].demand_units == 7
    assert got[date(2024, 1, 3)].demand_units == round(1000 * (1 + 0.3 * np.sin(4 * np.pi / 7)) * 1.004)


def test_peak_is_the_first_maximum(spark):
    df = spark.createDataFrame([(date(2024, 1, d), u) for d, u in ((1, 5), (2, 9), (3, 9))], "date date, demand_units bigint")
    row = series.demand_summary(df).first()
    assert row.peak_day == date(2024, 1, 2) and row.avg_demand == 8


def test_history_projects_weekdays_and_trend(spark):
    start, as_of = date(2024, 1, 1), date(2024, 3, 25)
    days = (as_of - start).days
    rows = [("L", start + timedelta(days=i)) for i in range(days) for _ in range(3 if (start + timedelta(days=i)).weekday() == 0 else 1)]
    df = spark.createDataFrame(rows, "lane string, created_date date")
    got = {r.date: r.demand_units for r in series.demand_from_history(df, ["lane"], as_of, 7, history=days).collect()}
    t = np.arange(days)
    y = np.array([3.0 if (start + timedelta(days=int(i))).weekday() == 0 else 1.0 for i in t])
    slope, level = np.polyfit(t, y, 1)
    for i in range(7):
        day = as_of + timedelta(days=i)
        trend = max(0.0, (slope * (days + i) + level) / y.mean())
        assert got[day] == pytest.approx((3 if day.weekday() == 0 else 1) * trend, abs=2e-3)


def test_forecast_equals_a_ridge_solve(spark):
    base, rng = datetime(2024, 1, 1), np.random.default_rng(5)
    rows = []
    for name, n in (("a", 60), ("b", 1)):
        rows += [(name, base + timedelta(hours=i), float(np.round(rng.random(), 6))) for i in range(n) if i % 7 != 3]
    df = spark.createDataFrame(rows, "place string, hour timestamp, value double")
    got = {(r.place, r.step): r.forecast for r in series.forecast(df, ["place"], 5).collect()}
    for name in ("a", "b"):
        t = np.array([(r[1] - base).total_seconds() / 3600 for r in rows if r[0] == name])
        y = np.array([r[2] for r in rows if r[0] == name])
        x = np.column_stack([t, t * t])
        xc, yc = x - x.mean(0), y - y.mean()
        w = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
        for step in range(1, 6):
            at = t.max() + step
            want = y.mean() + (np.array([at, at * at]) - x.mean(0)) @ w
            assert got[name, step] == pytest.approx(want, abs=1e-3)


def test_bands_widen_inside_the_range(spark):
    df = spark.createDataFrame([(i, datetime(2024, 1, 1, i), v) for i, v in ((1, 0.2), (2, 0.3), (3, 2.0))], "step int, hour timestamp, forecast double")
    rows = series.forecast_bands(df, "delay_probability").orderBy("step").collect()
    assert [r.value for r in rows] == [0.2, 0.3, 0.65] and rows[0].trend == "increasing"
    assert rows[0].upper_bound == pytest.approx(0.218) and rows[2].upper_bound == 0.65
    assert rows[2].lower_bound == pytest.approx(0.59)


def test_metric_series(spark):
    at = datetime(2024, 1, 1, 5, 30)
    df = spark.createDataFrame(
        [(at, 1.0, False), (at, 0.0, True), (at, None, None), (at, 0.0, False)],
        "event_timestamp timestamp, delay_added_hours double, anomaly_flag boolean",
    )
    values = {m: series.metric_series(df, m).first() for m in ("delay_probability", "throughput", "on_time_rate")}
    assert values["delay_probability"].value == 0.25 and values["throughput"].value == 4.0
    assert values["on_time_rate"].value == 0.5 and values["throughput"].hour == datetime(2024, 1, 1, 5)


def test_cost_index_is_relative(spark):
    df = spark.createDataFrame(
        [(date(2024, 1, 1), 10.0, 10.0), (date(2024, 1, 2), 30.0, 10.0), (date(2024, 1, 2), None, 99.0)],
        "created_date date, freight_cost_usd double, distance_km double",
    )
    got = {r.hour.day: r.value for r in series.metric_series(df, "cost_index").collect()}
    assert got == {1: 0.5, 2: 1.5}


def test_calendar_filter_is_pushed_down(spark, folder):
    from harborline.operators.browse import since

    df = spark.read.parquet(f"{folder}/events.parquet")
    kept = since(df.withColumn("at", F.col("ts")), "at", datetime(2024, 1, 31), 7)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan


def test_rescale_flat_series(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, c double")
    rows = series.rescale(df, "c", ["k"], 10.0, 20.0, "s").collect()
    scaled = {(r.k, r.c): r.s for r in rows}
    assert scaled["a", 3.0] == pytest.approx(20.0)
    assert scaled["a", 1.0] == 10.0 and scaled["b", 5.0] == 10.0


def test_forecast_of_ten_years_of_hours(spark):
    """The whole history counts: equal to a solve in exact fractions, to four places."""
    from fractions import Fraction

    hours = 87_600
    rng = np.random.default_rng(11)
    values = np.round(1.2 + 1e-6 * np.arange(hours) + 0.1 * rng.normal(size=hours), 6)
    start = datetime(2014, 1, 1)
    frame = pd.DataFrame({"hour": pd.date_range(start, periods=hours, freq="h"), "value": values, "rows": 1})
    got = {r.step: r.forecast for r in series.forecast(spark.createDataFrame(frame), horizon=24).collect()}
    t = range(hours)
    y = [Fraction(round(v * 1_000_000), 1_000_000) for v in values.tolist()]
    n, s1, s2 = hours, sum(t), sum(x * x for x in t)
    s3, s4, sy = sum(x**3 for x in t), sum(x**4 for x in t), sum(y)
    ty, tty = sum(x * v for x, v in zip(t, y)), sum(x * x * v for x, v in zip(t, y))
    a11, a12, a22 = s2 - Fraction(s1 * s1, n) + 1, s3 - Fraction(s1 * s2, n), s4 - Fraction(s2 * s2, n) + 1
    b1, b2 = ty - s1 * sy / n, tty - s2 * sy / n
    det = a11 * a22 - a12 * a12
    w1, w2 = (b1 * a22 - b2 * a12) / det, (a11 * b2 - a12 * b1) / det
    w0 = sy / n - w1 * s1 / n - w2 * s2 / n
    for step in range(1, 25):
        x = hours - 1 + step
        assert got[step] == pytest.approx(float(w0 + w1 * x + w2 * x * x), abs=5.1e-5)
