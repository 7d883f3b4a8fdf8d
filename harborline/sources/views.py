"""Domain tables derived from the order, line and telemetry tables of a data folder."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harborline import schema
from harborline.session import slice_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A literal table. Built from Arrow so that Catalyst knows how small it is."""
    data = {name: [row[i] for row in rows] for i, name in enumerate(columns)}
    return spark.createDataFrame(pa.table(data))


def ports(spark: SparkSession) -> DataFrame:
    rows = [(i, *p) for i, p in enumerate(schema.PORTS)]
    return small_table(spark, ["idx", "node", "lat", "lon", "node_type", "capacity"], rows)


def lanes(spark: SparkSession) -> DataFrame:
    rows = [(s, d, float(km), m.split(","), float(cost), float(h)) for s, d, km, m, cost, h in schema.LANES]
    return small_table(spark, ["src", "dst", "distance_km", "modes", "base_cost", "base_time"], rows)


def source_registry(spark: SparkSession) -> DataFrame:
    return small_table(spark, ["source", "name", "frequency", "table_name"], schema.SOURCE_REGISTRY)


def shipments(spark: SparkSession, sf_dir: str, nth: int | None = None, slices: int = 1) -> DataFrame:
    """One shipment per order; orders without lines keep NULL measures.

    With ``nth``, those of one slice of the orders.
    """
    def rows(name: str, order: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        return df if nth is None else df.where(slice_of(order, slices) == nth)

    money, qty = F.col("l_extendedprice") * F.col("l_tax"), F.col("l_quantity")
    lines = (
        rows("lineitem", "l_orderkey")
        .join(
            table(spark, sf_dir, "part").select("p_partkey", "p_type"),
            F.col("l_partkey") == F.col("p_partkey"),
            "left",
        )
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.count_distinct("l_suppkey").alias("suppliers"),
            F.sum(qty.cast("decimal(18,2)")).alias("quantity"),
            F.min("l_quantity").alias("min_quantity"),
            F.max("l_discount").alias("max_discount"),
            F.max("l_tax").alias("max_tax"),
            F.min("l_suppkey").alias("supplier"),
            F.sum(money.cast("decimal(18,4)")).alias("freight"),
            F.min("p_type").alias("category"),
        )
    )
    urgency = F.substring("o_orderpriority", 1, 1)
    weather, congestion = F.col("max_discount") * 10, F.col("max_tax") * F.lit(12.5)
    delay = F.when(
        F.col("min_quantity").isNotNull(), F.greatest(F.col("min_quantity") - 15, F.lit(0.0)) * 3
    )
    return (
        rows("orders", "o_orderkey")
        .join(
            table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"),
            F.col("o_custkey") == F.col("c_custkey"),
        )
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            numbered("SHP-", F.col("o_orderkey")).alias("shipment_id"),
            F.col("c_mktsegment").alias("carrier"),
            port_of(F.col("supplier")).alias("origin_port"),
            port_of(F.col("c_custkey")).alias("destination_port"),
            F.when(urgency == "1", "air").when(urgency == "2", "road").when(urgency == "3", "rail")
            .otherwise("sea").alias("transport_mode"),
            "o_orderstatus",
            F.col("category").alias("goods_category"),
            F.lit("USD").alias("currency"),
            F.col("o_orderdate").cast("date").alias("created_date"),
            (500 + (F.col("o_custkey") * 37 + F.col("o_orderkey") * 101) % 12000).cast("double")
            .alias("distance_km"),
            (F.col("quantity") * 10).cast("double").alias("weight_kg"),
            F.col("o_totalprice").alias("value_usd"),
            F.col("freight").cast("double").alias("freight_cost_usd"),
            F.col("lines").alias("num_containers"),
            F.col("suppliers").alias("num_stops"),
            delay.alias("delay_hours"),
            weather.alias("weather_severity"),
            congestion.alias("port_congestion"),
            ((weather + congestion) / 2).alias("risk_score"),
            urgency.cast("int").alias("priority_level"),
            (F.col("o_totalprice") > 250000).alias("insurance_required"),
        )
        .withColumn(
            "status",
            F.when(F.col("o_orderstatus") == "F", "Delivered")
            .when(F.col("delay_hours") >= 48, "Critical_Delay")
            .when(F.col("delay_hours") > 0, "Delayed")
            .when(F.col("o_orderstatus") == "P", "In_Transit")
            .otherwise("On_Schedule"),
        )
        .drop("o_orderstatus")
    )


def numbered(prefix: str, number: Column) -> Column:
    """A key of at least nine digits; longer numbers keep all of theirs."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(9), F.length(digits)), F.lit("0")))


def port_of(number: Column) -> Column:
    """The port of a number, looked up in a list: no join that a query would have to keep."""
    names = F.array(*(F.lit(p[0]) for p in schema.PORTS))
    return F.when(number.isNotNull(), F.element_at(names, (number % len(schema.PORTS) + 1).cast("int")))


def telemetry(events: DataFrame, shipments: int) -> DataFrame:
    """Route events from raw event rows; works on a batch and on a stream.

    Events are spread over as many shipments as there are.
    """
    reading = F.get_json_object("props", "$.k").cast("int")
    nodes = ports(events.sparkSession).select("idx", "node", "lat", "lon")
    k, value, eid = F.col("k"), F.col("value"), F.col("raw_id")
    located = eid % 97 != 0
    return (
        events.withColumnRenamed("event_id", "raw_id")
        .withColumnRenamed("event_type", "raw_type")
        .withColumn("k", reading)
        .join(nodes, F.col("user_id") % len(schema.PORTS) == F.col("idx"))
        .select(
            numbered("EVT-", eid).alias("event_id"),
            numbered("SHP-", (eid * 7 + F.col("user_id")) % max(1, shipments)).alias("shipment_id"),
            F.when(F.col("raw_type") == "signup", "port_entry")
            .when(F.col("raw_type") == "error", "congestion_hold")
            .when(F.col("raw_type") == "click", "gps_ping")
            .when(F.col("raw_type") == "view", "departure")
            .otherwise("weather_hold").alias("event_type"),
            F.col("ts").cast("timestamp").alias("event_timestamp"),
            F.col("node").alias("location_name"),
            F.when(located, F.col("lat") + (k - 50) / F.lit(1000.0)).alias("latitude"),
            F.when(located, F.col("lon") + (k - 50) / F.lit(1000.0)).alias("longitude"),
            (k / F.lit(5.0)).alias("speed_knots"),
            (k * F.lit(3.6)).alias("heading_deg"),
            (k / F.lit(2.0) - 10).alias("temperature_c"),
            k.cast("double").alias("humidity_pct"),
            (k / F.lit(20.0)).alias("shock_g"),
            F.greatest(value / 5 - 20, F.lit(0.0)).alias("delay_added_hours"),
            F.when(eid % 53 != 0, value / 1000 - F.lit(0.2)).alias("risk_score_delta"),
            (value / 20).alias("port_wait_hours"),
            (value / 2).alias("fuel_consumed_lt"),
            (value * F.lit(1.3)).alias("co2_kg"),
            F.when(k % 3 == 0, "gps").when(k % 3 == 1, "iot").otherwise("ais").alias("sensor_type"),
            F.when(k < 20, "poor").when(k < 60, "fair").otherwise("good").alias("signal_quality"),
            ((F.col("raw_type") == "error") & (k >= 70)).alias("anomaly_flag"),
            ((F.col("raw_type") == "error") & (k >= 85)).alias("alert_sent"),
        )
    )


def route_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(table(spark, sf_dir, "events"), shipment_count(spark, sf_dir))


def shipment_count(spark: SparkSession, sf_dir: str) -> int:
    """From the file footers of the orders."""
    return table(spark, sf_dir, "orders").count()
