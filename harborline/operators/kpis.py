"""Fleet, carrier and mode figures over the shipment table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from harborline import schema
from harborline.functions.exact import exact_mean, exact_sum, rounded, share
from harborline.functions.scalars import is_late
from harborline.operators.ranking import latest
from harborline.sources.views import small_table

AT_RISK = 0.55
SAVING_PER_SHIPMENT = 12.5
SHIPMENTS_PER_ROUTE = 150
RISKS_PER_PREVENTION = 8


def _newest(shipments: DataFrame, window: int | None) -> DataFrame:
    """All shipments, or the newest by id as text."""
    return shipments if window is None else latest(shipments, "shipment_id", "shipment_id", window)


def fleet_kpis(shipments: DataFrame) -> DataFrame:
    """One row of fleet counts and means, in a single pass."""
    status, risk, delay = F.col("status"), F.col("risk_score"), F.col("delay_hours")
    return shipments.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status != "Delivered").alias("active"),
        F.count_if(risk > AT_RISK).alias("at_risk"),
        F.count_if(status == "Critical_Delay").alias("critical"),
        F.count_if(status == "On_Schedule").alias("on_schedule"),
        exact_mean(F.when(delay > 0, delay)).alias("avg_delay"),
        exact_sum(F.col("freight_cost_usd")).alias("total_freight"),
        exact_mean(F.coalesce(risk, F.lit(0.0))).alias("avg_risk"),
    )


def kpi_report(kpis: DataFrame) -> DataFrame:
    """The dashboard row from ``fleet_kpis``; an empty table gives zeros."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0.0)
    some = F.col("total") > 0

    def at_least_one(c):
        return F.when(some, F.greatest(one, c)).otherwise(F.lit(0).cast("bigint"))

    return kpis.select(
        F.col("active").alias("total_active_shipments"),
        F.col("at_risk").alias("at_risk_shipments"),
        F.col("critical").alias("critical_alerts"),
        rounded(F.col("on_schedule") / F.greatest(one, F.col("active")), 3).alias("on_time_rate"),
        rounded(F.coalesce("avg_delay", zero), 1).alias("avg_delay_hours"),
        rounded(F.coalesce("total_freight", zero), 0).alias("total_freight_usd"),
        rounded(F.coalesce("avg_risk", zero), 3).alias("avg_risk_score"),
        rounded(F.col("total") * SAVING_PER_SHIPMENT, 0).alias("cost_savings_today_usd"),
        at_least_one(F.expr(f"total div {SHIPMENTS_PER_ROUTE}")).alias("routes_optimized_today"),
        at_least_one(F.expr(f"at_risk div {RISKS_PER_PREVENTION}")).alias("disruptions_prevented"),
        F.when(some, "spark").otherwise("db_unavailable").alias("data_source"),
    )


def carrier_performance(shipments: DataFrame, window: int | None = None, top: int = 8) -> DataFrame:
    """Share of shipments that are not late, best carriers first."""
    return (
        _newest(shipments.select("shipment_id", "carrier", "status"), window)
        .groupBy("carrier")
        .agg((1 - share(is_late(F.col("status")))).alias("raw"))
        .orderBy(F.col("raw").desc(), "carrier")
        .limit(top)
        .select("carrier", rounded(F.col("raw"), 3).alias("performance"))
    )


def mode_split(shipments: DataFrame, window: int | None = None) -> DataFrame:
    """Share of each transport mode."""
    counts = (
        _newest(shipments.select("shipment_id", "transport_mode"), window)
        .groupBy("transport_mode")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("transport_mode", rounded(F.col("n") / total, 3).alias("share"))


def kpi_answer(report: DataFrame, carriers: DataFrame, modes: DataFrame) -> DataFrame:
    """The report row with the carriers' performance and the mode shares as sorted lists."""
    def listed(df: DataFrame, name: str, value: str, out: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), F.col(value).alias("value")))).alias(out))

    return report.join(F.broadcast(listed(carriers, "carrier", "performance", "carrier_performance"))).join(
        F.broadcast(listed(modes, "transport_mode", "share", "mode_split"))
    )


def mode_split_pct(split: DataFrame) -> DataFrame:
    """The split on the four fixed modes as percent; a missing mode is 0."""
    modes = small_table(split.sparkSession, ["transport_mode"], [(m,) for m in schema.TRANSPORT_MODES])
    part = F.coalesce("share", F.lit(0.0))
    total = F.sum(part.cast("decimal(18,3)")).over(Window.partitionBy()).cast("double")
    return modes.join(split, "transport_mode", "left").select(
        "transport_mode",
        rounded(part / F.coalesce(F.nullif(total, F.lit(0.0)), F.lit(1.0)) * 100, 1).alias("percent"),
    )


def carrier_report(shipments: DataFrame, top: int = 10) -> DataFrame:
    """Shipments, mean delay and mean risk per carrier, slowest first."""
    return (
        shipments.groupBy("carrier")
        .agg(
            F.count(F.lit(1)).alias("shipments"),
            exact_mean(F.col("delay_hours")).alias("delay"),
            exact_mean(F.col("risk_score")).alias("risk"),
        )
        .select(
            "carrier",
            "shipments",
            rounded(F.col("delay"), 1).alias("avg_delay"),
            rounded(F.col("risk"), 3).alias("avg_risk"),
        )
        .orderBy(F.col("avg_delay").desc_nulls_first(), "carrier")
        .limit(top)
    )
