from datetime import date, datetime, timedelta

import pytest

from harborline.operators import browse, hotspots, kpis
from pyspark.sql import functions as F

EVENT = (
    "event_id string, event_timestamp timestamp, location_name string, latitude double, longitude double, "
    "risk_score_delta double, delay_added_hours double, port_wait_hours double, anomaly_flag boolean"
)
SHIPMENT = (
    "shipment_id string, carrier string, origin_port string, destination_port string, transport_mode string, "
    "status string, created_date date, delay_hours double, risk_score double, freight_cost_usd double"
)


def events(spark, groups):
    rows, i = [], 0
    for name, n, risk, delay in groups:
        for _ in range(n):
            i += 1
            rows.append((f"E{i}", datetime(2024, 1, 1) + timedelta(minutes=i), name, 1.0, 2.0, risk, delay, 4.0, False))
    return spark.createDataFrame(rows, EVENT)


def shipments(spark, rows):
    return spark.createDataFrame(rows, SHIPMENT)


def ship(i, status="On_Schedule", mode="sea", delay=0.0, risk=0.1, day=date(2001, 7, 1), carrier="A"):
    return (f"S{i}", carrier, "Suez", "Dubai", mode, status, day, delay, risk, 10.0)


def test_heatmap_needs_five_events(spark):
    df = events(spark, [("four", 4, 0.1, 0.0), ("five", 5, 0.1, 0.0), ("hot", 6, 3.0, 0.0), ("cold", 5, -0.35, 0.0)])
    got = {r.region: r for r in hotspots.risk_heatmap(df).collect()}
    assert set(got) == {"five", "hot", "cold"}
    assert got["hot"].intensity == 1.0 and got["hot"].type == "critical"
    # A mean of exactly zero counts as unknown.
    assert got["cold"].intensity == 0.3 and got["cold"].type == "medium"
    assert got["five"].intensity == 0.45


def test_heatmap_window_is_cut_before_grouping(spark):
    df = events(spark, [("old", 10, 0.1, 0.0), ("new", 150, 0.1, 0.0)])
    got = {r.region: r.event_count for r in hotspots.risk_heatmap(df, window=152).collect()}
    assert got == {"new": 150}


def test_bad_coordinates_are_left_out(spark):
    df = events(spark, [("a", 5, 0.1, 0.0)]).unionByName(
        events(spark, [("a", 5, 0.1, 0.0)]).withColumn("latitude", F.lit(90.1))
    )
    assert browse.valid_coords(df).count() == 5


def test_bottlenecks_need_three_delays(spark):
    df = events(spark, [("two", 2, 0.0, 9.0), ("three", 3, 0.0, 12.0), ("worst", 3, 0.0, 72.0), ("none", 5, 0.0, 0.0)])
    got = {r.location: r for r in hotspots.bottlenecks(df).collect()}
    assert set(got) == {"three", "worst"}
    assert got["worst"].severity_score == 1.0 and got["worst"].recommendation.startswith("Emergency")
    assert got["three"].type == "transit_delay" and got["worst"].type == "port_congestion"
    assert got["three"].estimated_clearance_hours == 18.0


def test_kpis_and_null_rules(spark):
    df = shipments(spark, [
        ship(1), ship(2, "Delivered"), ship(3, None, delay=None, risk=None),
        ship(4, "Critical_Delay", delay=60.0, risk=0.9), ship(5, "Delayed", delay=10.0, risk=0.55),
    ])
    row = kpis.fleet_kpis(df).first()
    assert (row.total, row.active, row.at_risk, row.critical, row.on_schedule) == (5, 3, 1, 1, 1)
    assert row.avg_delay == 35.0
    report = kpis.kpi_report(kpis.fleet_kpis(df)).first()
    assert report.on_time_rate == 0.333 and report.routes_optimized_today == 1


def test_no_data_gives_zeros(spark):
    report = kpis.kpi_report(kpis.fleet_kpis(shipments(spark, []))).first()
    assert report.data_source == "db_unavailable"
    assert all(v == 0 for k, v in report.asDict().items() if k != "data_source")
    assert kpis.mode_split(shipments(spark, [])).count() == 0


def test_carriers_and_modes(spark):
    df = shipments(spark, [ship(1, None), ship(2, "Delayed"), ship(3, carrier="B", mode="air")])
    got = {r.carrier: r.performance for r in kpis.carrier_performance(df).collect()}
    assert got == {"A": 0.5, "B": 1.0}
    split = kpis.mode_split(df)
    assert sum(r.share for r in split.collect()) == pytest.approx(1, abs=0.002)
    pct = {r.transport_mode: r.percent for r in kpis.mode_split_pct(split).collect()}
    assert pct["rail"] == 0.0 and pct["sea"] == 66.7


def test_missing_date_comes_first(spark):
    df = shipments(spark, [ship(1), ship(2, day=None), ship(3, day=date(2001, 7, 2))])
    assert [r.shipment_id for r in browse.recent_shipments(df).collect()] == ["S2", "S3", "S1"]


def test_search_is_literal(spark):
    df = shipments(spark, [ship(1), ship(2, None), ship(3, "On%Way")])
    assert [r.shipment_id for r in browse.search_shipments(df, "%").collect()] == ["S3"]
    assert browse.search_shipments(df, "").count() == 3
    assert browse.search_shipments(df, "sUEZ", 2).count() == 2


def test_event_line(spark):
    df = events(spark, [("New_York_Bay", 1, -0.05, 0.0)]).withColumn("anomaly_flag", F.lit(True)).withColumn(
        "shipment_id", F.lit("S1")
    )
    assert browse.event_log(df).first().line == "E1 @ New York Bay Δrisk: -0.050 ⚠"


def test_order_queries_do_not_read_the_lines(spark, folder):
    from harborline.plans.catalog import QUERIES

    for name in ("mode_split", "last_month_shipments", "carrier_performance"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        read = "l_orderkey" in plan
        assert read == (name == "carrier_performance"), name


def test_since_bounds_the_partitions(spark, tmp_path):
    from datetime import date

    from harborline.operators import browse

    rows = spark.createDataFrame([(date(2001, m, 3), f"2001-{m:02d}") for m in range(1, 9)], "created_date date, created_month string")
    rows.write.partitionBy("created_month").parquet(f"{tmp_path}/t")
    recent = browse.since(spark.read.parquet(f"{tmp_path}/t"), "created_date", date(2001, 8, 1), 40)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_month" in plan and recent.count() == 2
