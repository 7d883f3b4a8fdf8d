"""Table contracts and the fixed values of the freight domain."""

from __future__ import annotations

from pyspark.sql import types as T


def _dec(p: int, s: int) -> T.DecimalType:
    return T.DecimalType(p, s)


def _contract(*fields: tuple[str, T.DataType], key: str) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, name != key) for name, dtype in fields])


SHIPMENTS = _contract(
    ("shipment_id", T.StringType()),
    ("carrier", T.StringType()),
    ("origin_port", T.StringType()),
    ("destination_port", T.StringType()),
    ("transport_mode", T.StringType()),
    ("status", T.StringType()),
    ("goods_category", T.StringType()),
    ("currency", T.StringType()),
    ("created_date", T.DateType()),
    ("eta_date", T.DateType()),
    ("transit_hours", _dec(8, 1)),
    ("delay_hours", _dec(8, 1)),
    ("distance_km", _dec(10, 1)),
    ("weight_kg", _dec(12, 1)),
    ("volume_m3", _dec(10, 2)),
    ("value_usd", _dec(16, 2)),
    ("freight_cost_usd", _dec(14, 2)),
    ("num_containers", T.ShortType()),
    ("num_stops", T.ShortType()),
    ("priority_level", T.ShortType()),
    ("risk_score", _dec(6, 4)),
    ("weather_severity", _dec(6, 4)),
    ("port_congestion", _dec(6, 4)),
    ("temperature_c", _dec(5, 1)),
    ("insurance_required", T.BooleanType()),
    ("ingested_at", T.TimestampType()),
    key="shipment_id",
)

ROUTE_EVENTS = _contract(
    ("event_id", T.StringType()),
    ("shipment_id", T.StringType()),
    ("event_type", T.StringType()),
    ("event_timestamp", T.TimestampType()),
    ("location_name", T.StringType()),
    ("latitude", _dec(10, 6)),
    ("longitude", _dec(10, 6)),
    ("speed_knots", _dec(6, 1)),
    ("heading_deg", _dec(6, 1)),
    ("temperature_c", _dec(5, 1)),
    ("humidity_pct", _dec(5, 1)),
    ("shock_g", _dec(5, 2)),
    ("delay_added_hours", _dec(7, 1)),
    ("risk_score_delta", _dec(7, 4)),
    ("port_wait_hours", _dec(7, 1)),
    ("fuel_consumed_lt", _dec(8, 2)),
    ("co2_kg", _dec(8, 2)),
    ("sensor_type", T.StringType()),
    ("signal_quality", T.StringType()),
    ("anomaly_flag", T.BooleanType()),
    ("alert_sent", T.BooleanType()),
    ("ingested_at", T.TimestampType()),
    key="event_id",
)

CONTRACTS = {"shipments_master": SHIPMENTS, "route_events": ROUTE_EVENTS}
KEYS = {"shipments_master": "shipment_id", "route_events": "event_id"}
# Declared text lengths, checked in the load report instead of being enforced.
TEXT_LIMITS = {
    "shipments_master": {
        "shipment_id": 20, "carrier": 50, "origin_port": 60, "destination_port": 60,
        "transport_mode": 10, "status": 30, "goods_category": 40, "currency": 5,
    },
    "route_events": {
        "event_id": 20, "shipment_id": 20, "event_type": 40, "location_name": 60,
        "sensor_type": 20, "signal_quality": 15,
    },
}
# Table -> (partition column, the date or timestamp it is derived from, format).
PARTITIONS = {
    "shipments_master": ("created_month", "created_date", "yyyy-MM"),
    "route_events": ("event_date", "event_timestamp", "yyyy-MM-dd"),
}

# ---------------------------------------------------------------------------
# They must equal the published ones for results to agree.
# ---------------------------------------------------------------------------

LATEST_SHIPMENTS = 10_000
LATEST_EVENTS = 200_000

TRANSPORT_MODES = ["sea", "air", "rail", "road"]
LATE_STATUSES = ["Delayed", "Critical_Delay"]
CONGESTED_EVENT_TYPES = ["congestion_hold", "port_entry", "weather_hold"]
TRUE_WORDS = ["true", "t", "1", "yes"]
INSIGHT_WORDS = ["delay", "disruption", "port", "congestion", "route", "shipment", "delivery", "risk"]

# Upper limit (exclusive) of each band; beyond the last one it is critical.
LEVEL_BANDS = [(0.3, "low"), (0.55, "medium"), (0.75, "high")]
TOP_LEVEL = "critical"
ADVICE_BANDS = [
    (0.3, "Continue monitoring"),
    (0.55, "Monitor closely, prepare alternate"),
    (0.75, "Activate contingency routing"),
]
TOP_ADVICE = "Emergency reroute — immediate action required"

SPEED_KMH = {"sea": 40.0, "air": 800.0, "rail": 120.0, "road": 80.0}
OTHER_SPEED_KMH = 60.0

METRIC_RANGES = {
    "delay_probability": (0.05, 0.65),
    "throughput": (800.0, 1500.0),
    "on_time_rate": (0.70, 0.98),
    "cost_index": (1.0, 1.8),
}

# name, latitude, longitude, type, capacity; the position is the port index.
PORTS = [
    ("Shanghai", 31.2, 121.5, "port", 0.90),
    ("Singapore", 1.3, 103.8, "port", 0.85),
    ("Rotterdam", 51.9, 4.5, "port", 0.88),
    ("Los_Angeles", 34.0, -118.2, "port", 0.75),
    ("Dubai", 25.2, 55.3, "hub", 0.92),
    ("Mumbai", 18.9, 72.8, "port", 0.80),
    ("Hamburg", 53.5, 10.0, "port", 0.82),
    ("New_York", 40.7, -74.0, "port", 0.78),
    ("Tokyo", 35.7, 139.7, "port", 0.87),
    ("Sydney", -33.9, 151.2, "port", 0.70),
    ("Cape_Town", -33.9, 18.4, "port", 0.65),
    ("Busan", 35.1, 129.0, "port", 0.83),
    ("Antwerp", 51.2, 4.4, "port", 0.81),
    ("Suez", 30.0, 32.5, "transit", 0.60),
    ("Panama", 9.0, -79.5, "transit", 0.65),
]

# from, to, distance (km), modes, base cost (USD), base time (h).
LANES = [
    ("Shanghai", "Tokyo", 1800, "sea,air", 800, 72),
    ("Shanghai", "Singapore", 4000, "sea,air", 1200, 120),
    ("Shanghai", "Los_Angeles", 11000, "sea,air", 3500, 360),
    ("Shanghai", "Busan", 900, "sea,air", 400, 36),
    ("Singapore", "Dubai", 5600, "sea,air", 1800, 168),
    ("Singapore", "Rotterdam", 10800, "sea", 3200, 480),
    ("Singapore", "Mumbai", 3000, "sea,air", 900, 96),
    ("Dubai", "Rotterdam", 6200, "sea,air", 1900, 192),
    ("Dubai", "Mumbai", 1900, "sea,air", 600, 48),
    ("Suez", "Rotterdam", 4000, "sea", 1200, 120),
    ("Suez", "Dubai", 2000, "sea", 700, 60),
    ("Rotterdam", "Hamburg", 350, "road,rail", 200, 12),
    ("Rotterdam", "Antwerp", 80, "road,rail", 100, 6),
    ("Los_Angeles", "New_York", 4500, "road,rail,air", 1200, 72),
    ("Panama", "Los_Angeles", 4000, "sea", 1100, 120),
    ("Panama", "New_York", 3400, "sea", 900, 96),
    ("Cape_Town", "Rotterdam", 9500, "sea", 2800, 336),
    ("Tokyo", "Los_Angeles", 9000, "sea,air", 2800, 300),
    ("Busan", "Los_Angeles", 9200, "sea,air", 2900, 312),
    ("Sydney", "Singapore", 6300, "sea,air", 1900, 192),
]
FALLBACK_ORIGIN = "Shanghai"
FALLBACK_DESTINATION = "Rotterdam"

# name, weight of time, of cost, of risk.
ROUTE_PROFILES = [
    ("balanced", 0.4, 0.3, 0.3),
    ("steady", 0.5, 0.2, 0.3),
    ("express", 0.7, 0.1, 0.2),
    ("economy", 0.3, 0.4, 0.3),
]

# source, name, frequency, table.
SOURCE_REGISTRY = [
    ("gps_iot", "GPS/IoT Tracker", "5s", "route_events"),
    ("weather_api", "Weather API", "15min", None),
    ("traffic_api", "Traffic Data API", "10min", None),
    ("port_congestion", "Port Congestion Feed", "30min", None),
    ("warehouse_logs", "Warehouse ERP Logs", "1hr", None),
    ("historical_db", "Historical Delivery DB", "daily", "shipments_master"),
    ("customs_api", "Customs Clearance API", "20min", None),
    ("carrier_feed", "Carrier Status Feed", "5min", None),
    ("kafka_stream", "Apache Kafka Stream", "realtime", "route_events"),
]
