"""Replay of a table as ticks, and the live figures of each tick, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from harborline.functions.exact import rounded
from harborline.operators.ranking import number_rows, running_total
from harborline.session import spool

BATCH = 5
KEEP = 250
EVENT_ORDER = ["event_timestamp", "event_id"]
# Ticks per block of work: a block also reads the rows still held from before it.
TICKS_PER_BLOCK = 2000
SAVED_PER_RISK, SAVED_PER_ALERT = 120, 40


def event_marks() -> dict[str, Column]:
    """Severe, on-time and critical marks of an event; a missing number is 0."""
    zero = F.lit(0.0)
    delay, delta, wait = (F.coalesce(c, zero) for c in ("delay_added_hours", "risk_score_delta", "port_wait_hours"))
    anomaly = F.coalesce("anomaly_flag", F.lit(False))
    return {
        "severe": anomaly | (delta >= 0.12) | (delay >= 6) | (wait >= 12),
        "on_time": (delay <= 0) & ~anomaly,
        "critical": anomaly | (delta >= 0.18),
    }


def replay_ticks(events: DataFrame, batch: int = BATCH, laps: int = 1, ticks: int | None = None) -> DataFrame:
    """Rows of each tick in time order; after the last row the replay starts again.

    The last batch of a lap may be short. ``ticks`` ends the replay inside a lap.
    """
    numbered = number_rows(events, EVENT_ORDER)
    total = numbered.total
    lap = max(1, -(-total // batch))
    slot = F.floor(F.col("row_index") / batch)
    last = lap * laps if ticks is None else ticks
    size = F.least(F.lit(batch), F.lit(total) - F.col("offset"))
    return (
        numbered.rows.withColumn("slot", slot)
        .where(F.col("slot") < last)
        .withColumn("offset", F.col("slot") * batch)
        .withColumn("tick", F.explode(F.sequence(F.col("slot") + 1, F.lit(last).cast("bigint"), F.lit(lap).cast("bigint"))))
        .withColumns({"batch_size": size.cast("bigint"), "total_rows": F.lit(total).cast("bigint")})
        .withColumn(
            "processed_records",
            F.floor((F.col("tick") - 1) / lap) * total + F.col("offset") + F.col("batch_size"),
        )
        .drop("slot", "row_index")
    )


def live_kpis(events: DataFrame, batch: int = BATCH, keep: int = KEEP) -> DataFrame:
    """Live figures after each tick, over the newest ``keep`` rows.

    A row is held from its own tick to the tick that pushes it out, and stands for
    its shipment until the shipment's next row arrives. So each row adds a few
    plus and minus marks on the tick axis, and running sums give the figures; no
    row is copied into each of its ticks. Blocks of ticks are independent, and one
    shuffle by block serves every step.
    """
    narrow = events.select("shipment_id", *EVENT_ORDER, *(c.alias(n) for n, c in event_marks().items()))
    numbered = number_rows(narrow, EVENT_ORDER)
    total = numbered.total
    lap = max(1, -(-total // batch))
    index = F.col("row_index")
    held = numbered.rows.select(
        "shipment_id",
        "severe",
        F.col("on_time").cast("int").alias("on_time"),
        F.col("critical").cast("int").alias("critical"),
        "row_index",
        F.floor(index / batch).alias("first"),
        F.when(index >= total - keep, F.lit(lap - 1).cast("bigint"))
        .otherwise(F.floor((index + keep) / batch) - 1).alias("last"),
    ).where(F.col("first") <= F.col("last"))
    per_block = F.lit(TICKS_PER_BLOCK)
    blocks = held.withColumn(
        "block",
        F.explode(F.sequence(F.floor(F.col("first") / per_block), F.floor(F.col("last") / per_block))),
    ).repartition("block")
    start = F.col("block") * per_block
    named = F.col("shipment_id").isNotNull()
    same = Window.partitionBy("block", "shipment_id").orderBy("row_index")
    same_severe = Window.partitionBy("block", "shipment_id", "severe").orderBy("row_index")
    enters = F.greatest("first", start)
    leaves = F.least(F.col("last") + 1, start + per_block)
    spans = blocks.select(
        "block",
        "on_time",
        "critical",
        enters.alias("enters"),
        leaves.alias("leaves"),
        F.when(named, F.lead("first").over(same)).alias("next_seen"),
        F.when(named, F.lead("first").over(same_severe)).alias("next_severe"),
        named.cast("int").alias("named"),
        (named & F.col("severe")).cast("int").alias("risky"),
    )

    def until(next_tick: str) -> Column:
        return F.greatest(F.least("leaves", F.coalesce(next_tick, "leaves")), F.col("enters"))

    nil = F.lit(0)

    def mark(tick: Column, sample=nil, on_time=nil, critical=nil, active=nil, at_risk=nil) -> Column:
        return F.struct(
            tick.alias("slot"), sample.alias("sample"), on_time.alias("on_time"), critical.alias("critical"),
            active.alias("active"), at_risk.alias("at_risk"),
        )

    on_time, critical, seen, risky = (F.col(c) for c in ("on_time", "critical", "named", "risky"))
    marks = F.array(
        mark(F.col("enters"), F.lit(1), on_time, critical, seen, risky),
        mark(F.col("leaves"), F.lit(-1), -on_time, -critical),
        mark(until("next_seen"), active=-seen),
        mark(until("next_severe"), at_risk=-risky),
    )
    measures = ["sample", "on_time", "critical", "active", "at_risk"]
    changes = (
        spans.select("block", F.explode(marks).alias("m"))
        .select("block", "m.*")
        .groupBy("block", "slot")
        .agg(*(F.sum(m).alias(m) for m in measures))
    )
    so_far = Window.partitionBy("block").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    figures = changes.select(
        "block", (F.col("slot") + 1).alias("tick"), *(F.sum(m).over(so_far).alias(m) for m in measures)
    ).where(F.col("tick") <= F.least((F.col("block") + 1) * per_block, F.lit(lap)))
    return figures.select(
        "tick",
        F.col("sample").alias("records"),
        F.col("active").alias("active_shipments"),
        F.col("at_risk").alias("at_risk_shipments"),
        rounded(F.col("on_time") / F.col("sample"), 4).alias("on_time_rate"),
        F.col("critical").alias("critical_alerts"),
        F.greatest("tick", "at_risk").alias("routes_optimized"),
    )


def live_savings(kpis: DataFrame) -> DataFrame:
    """Estimated savings up to each tick; every tick counts once."""
    gain = SAVED_PER_RISK * F.col("at_risk_shipments") + SAVED_PER_ALERT * F.col("critical_alerts")
    gains = spool(kpis.select("tick", gain.alias("saved")), "savings")
    ticks = gains.agg(F.coalesce(F.max("tick"), F.lit(0))).first()[0]
    return running_total(gains, "tick", int(ticks), {"saved": "total_saved"})
