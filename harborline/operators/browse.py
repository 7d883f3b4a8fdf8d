"""Row-level reads: recent rows, search, coordinate and calendar filters."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from harborline import schema
from harborline.functions.exact import rounded

SEARCHED = ["shipment_id", "carrier", "origin_port", "destination_port", "status"]


def _newest_first() -> list[Column]:
    return [F.col("created_date").desc_nulls_first(), F.col("shipment_id").desc_nulls_first()]


def recent_shipments(shipments: DataFrame, n: int = 50) -> DataFrame:
    """Newest shipments; a missing date comes first."""
    return shipments.orderBy(*_newest_first()).limit(n)


def search_shipments(shipments: DataFrame, text: str, n: int = 50) -> DataFrame:
    """Newest shipments with the text, in any case, in one of the searched columns."""
    if text:
        hit = reduce(or_, (F.lower(c).contains(text.lower()) for c in SEARCHED))
        shipments = shipments.where(F.coalesce(hit, F.lit(False)))
    return recent_shipments(shipments, n)


def valid_coords(events: DataFrame) -> DataFrame:
    """Rows whose coordinates are present and on the globe."""
    return events.where(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180))


def moment(at: date) -> Column:
    """A literal date, or a literal timestamp in the session zone."""
    kind = "timestamp" if isinstance(at, datetime) else "date"
    return F.lit(str(at)).cast(kind)


def since(df: DataFrame, column: str, as_of: date, days: int) -> DataFrame:
    """Rows from the last days before ``as_of``; a literal comparison, so it prunes.

    On a stored table the bound holds for the partition column as well.
    """
    start = moment(as_of - timedelta(days=days))
    recent = F.col(column) >= start
    for part, source, pattern in schema.PARTITIONS.values():
        if source == column and part in df.columns:
            recent = recent & (F.col(part) >= F.date_format(start, pattern))
    return df.where(recent)


def event_log(events: DataFrame) -> DataFrame:
    """One readable line per event."""
    delta = F.coalesce(F.col("risk_score_delta"), F.lit(0.0))
    sign = F.when(delta >= 0, "+").otherwise("")
    return events.select(
        "event_id",
        "event_timestamp",
        F.concat(
            F.coalesce("event_id", "shipment_id", F.lit("—")),
            F.lit(" @ "),
            F.replace(F.coalesce("location_name", F.lit("—")), F.lit("_"), F.lit(" ")),
            F.lit(" Δrisk: "),
            sign,
            F.format_string("%.3f", rounded(delta, 3)),
            F.when(F.coalesce("anomaly_flag", F.lit(False)), " ⚠").otherwise(""),
        ).alias("line"),
    )
