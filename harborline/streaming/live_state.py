"""Live figures per key in a stream, over the newest rows of each key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from harborline.functions.exact import rounded
from harborline.operators.live import EVENT_ORDER, KEEP, SAVED_PER_ALERT, SAVED_PER_RISK, event_marks
from harborline.streaming.events import drop_batches, read_batch


def live_kpis_sink(root: str, key: Column | None = None, keep: int = KEEP) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that keeps the newest rows per key and their figures.

    The buffer of every key is a table per batch, made from the buffer of the
    batch before. The rank filter runs in each task before the shuffle: a key with
    a third of the stream sends at most ``keep`` rows per task. Running a batch
    again overwrites the same folders. Without a key, the whole fleet is one key.
    """
    name = key if key is not None else F.lit("fleet")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(
            F.coalesce(name.cast("string"), F.lit("unknown")).alias("live_key"),
            F.lit(batch_id).cast("bigint").alias("arrived"),
            *EVENT_ORDER,
            "shipment_id",
            *(c.alias(n) for n, c in event_marks().items()),
        )
        held = read_batch(spark, f"{root}/buffer", batch_id)
        every = rows if held is None else held.unionByName(rows)
        newest = Window.partitionBy("live_key").orderBy(
            F.col("arrived").desc(), *(F.col(c).desc_nulls_first() for c in EVENT_ORDER)
        )
        every.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= keep).drop("nth").write.mode(
            "overwrite"
        ).parquet(f"{root}/buffer/batch_id={batch_id}")
        buffer = spark.read.parquet(f"{root}/buffer/batch_id={batch_id}")
        now = buffer.groupBy("live_key").agg(
            F.count(F.lit(1)).alias("records"),
            F.count_distinct("shipment_id").alias("active_shipments"),
            F.count_distinct(F.when(F.col("severe"), F.col("shipment_id"))).alias("at_risk_shipments"),
            rounded(F.count_if("on_time") / F.count(F.lit(1)), 4).alias("on_time_rate"),
            F.count_if("critical").alias("critical_alerts"),
            (F.max("arrived") == batch_id).cast("int").alias("fresh"),
        )
        before = read_batch(spark, f"{root}/kpis", batch_id)
        if before is None:
            before = now.select("live_key", F.lit(0).cast("bigint").alias("batches"), F.lit(0).cast("bigint").alias("saved"))
        gain = SAVED_PER_RISK * F.col("at_risk_shipments") + SAVED_PER_ALERT * F.col("critical_alerts")
        zero = F.lit(0).cast("bigint")
        figures = now.join(before.select("live_key", "batches", "saved"), "live_key", "left").withColumns(
            {
                "batches": F.coalesce("batches", zero) + F.col("fresh"),
                "saved": F.coalesce("saved", zero) + F.col("fresh") * gain,
            }
        )
        figures.withColumn("routes_optimized", F.greatest("batches", "at_risk_shipments")).drop("fresh").write.mode(
            "overwrite"
        ).parquet(f"{root}/kpis/batch_id={batch_id}")
        # A retry reads the batch before; older ones are of no more use.
        for part in ("buffer", "kpis"):
            drop_batches(spark, f"{root}/{part}", batch_id - 1)

    return write
