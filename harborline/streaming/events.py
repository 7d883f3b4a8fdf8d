"""Paced event streams: source, resume, idempotent batches and health."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

INTERVAL = "10 seconds"
TICKS_PER_HEALTH = 5
LEDGER = "tick bigint, offset bigint, batch_size bigint, processed_records bigint, total_rows bigint, written_at timestamp"


def event_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = 1, fmt: str = "parquet"
) -> DataFrame:
    """New files of a folder, oldest first: a fixed number per micro-batch, or all there are."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def start(writer: DataStreamWriter, checkpoint: str, interval: str | None = INTERVAL) -> StreamingQuery:
    """Start at the offset saved in the checkpoint; without an interval, run what is there."""
    paced = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return paced.option("checkpointLocation", checkpoint).start()


def drain(query: StreamingQuery) -> StreamingQuery:
    """Let a paced query do all that has come, then stop it between two batches."""
    query.processAllAvailable()
    query.stop()
    return query


def _folders(spark: SparkSession, root: str):
    """The file system of a folder, and its batch folders by number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return files, {}
    found = [status.getPath() for status in files.listStatus(path)]
    named = [(p.getName(), p) for p in found]
    return files, {int(name.partition("=")[2]): p for name, p in named if name.startswith("batch_id=")}


def batch_folders(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the batches that have a folder under the root."""
    return sorted(_folders(spark, root)[1])


def read_batch(spark: SparkSession, root: str, before: int) -> DataFrame | None:
    """What the newest batch before the given one wrote under the root; None for the first batch.

    Batches without rows leave gaps. A later batch with nothing before it means lost
    state, which stops the stream.
    """
    earlier = [n for n in _folders(spark, root)[1] if n < before]
    if not earlier:
        if before > 0:
            raise RuntimeError(f"batch {before} finds no earlier batch under {root}")
        return None
    return spark.read.parquet(f"{root}/batch_id={max(earlier)}")


def drop_batches(spark: SparkSession, root: str, before: int) -> None:
    """Remove the folders of batches that no retry reads any more."""
    files, folders = _folders(spark, root)
    for number, path in folders.items():
        if number < before:
            files.delete(path, True)


def batch_payload(root: str, total_rows: int | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: records and a ledger row per batch.

    ``total_rows`` is the size of the replayed table, where it is known. Each batch
    overwrites its own folder, so a batch that is run again after a failure leaves
    the same rows; the first batch must be number 0.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{root}/records/batch_id={batch_id}")
        size = spark.read.parquet(f"{root}/records/batch_id={batch_id}").count()
        prior = read_batch(spark, f"{root}/ledger", batch_id)
        last = prior.first() if prior is not None else None
        tick, offset = (last["tick"] + 1, last["processed_records"]) if last else (1, 0)
        row = (tick, offset, size, offset + size, total_rows, datetime.now(timezone.utc))
        spark.createDataFrame([row], LEDGER).write.mode("overwrite").parquet(f"{root}/ledger/batch_id={batch_id}")

    return write


def stream_health(
    ledger: DataFrame, table: str, connected: bool, interval: str | None = INTERVAL, every: int = TICKS_PER_HEALTH
) -> DataFrame:
    """Health rows from a ledger: each n-th tick, and the last one.

    The ledger outlives the query, so ticks and counts go on after a restart.
    """
    last = ledger.agg(F.max("tick").alias("last"))
    return (
        ledger.join(F.broadcast(last), (F.col("tick") % every == 0) | (F.col("tick") == F.col("last")))
        .select(
            "tick",
            "offset",
            "batch_size",
            "processed_records",
            "total_rows",
            F.lit(table).alias("table_name"),
            F.lit(interval).alias("interval"),
            ((F.col("tick") < F.col("last")) | F.lit(connected)).alias("connected"),
            F.col("written_at").alias("last_batch_at"),
        )
    )
