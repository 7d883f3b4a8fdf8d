"""Live figures per key as a state operator: a bounded buffer per key, only touched keys written."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from harborline.operators.live import EVENT_ORDER, KEEP, SAVED_PER_ALERT, SAVED_PER_RISK, event_marks
from harborline.session import release, spool
from harborline.streaming.events import batch_folders, drop_batches

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: How long a key without rows is remembered.
FORGET = 30 * 24 * 3600 * 1000
#: Batches after which touched rows are folded into one folder.
FOLD = 32

HELD = "event_timestamp timestamp, event_id string, shipment_id string, severe boolean, on_time boolean, critical boolean"
TOTALS = "batches bigint, saved bigint"
FIGURES = (
    "live_key string, records bigint, active_shipments bigint, at_risk_shipments bigint, on_time_events bigint, "
    "critical_alerts bigint, batches bigint, saved bigint, routes_optimized bigint"
)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State of streams started inside is held in RocksDB; a running stream keeps the settings it started with.

    Batches without data are off: with a time to live they would follow each other for
    ever, and a run over what there is would not end. Old state goes with the next data.
    """
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _order(row: dict) -> tuple:
    """Order of arrival inside a batch: by time, then id, nulls first."""
    return tuple((row[c] is not None, row[c]) for c in EVENT_ORDER)


class _Newest:
    """A row in a heap of the newest ones."""

    __slots__ = ("at", "row")

    def __init__(self, row: dict) -> None:
        self.at, self.row = _order(row), row

    def __lt__(self, other: _Newest) -> bool:
        return self.at < other.at


def newest_per_task(rows: DataFrame, key: str, keep: int) -> DataFrame:
    """Of each key the newest rows of each task: a key with a third of a batch sends at most ``keep`` rows a task.

    Older rows of a batch can't stay among the newest ``keep`` of their key.
    """
    schema = rows.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[_Newest]] = {}
        form = None
        for batch in batches:
            form = batch.schema
            for row in batch.to_pylist():
                own = held.setdefault(row[key], [])
                if len(own) < keep:
                    heapq.heappush(own, _Newest(row))
                else:
                    heapq.heappushpop(own, _Newest(row))
        if form is not None:
            yield pa.RecordBatch.from_pylist([x.row for own in held.values() for x in own], schema=form)

    return rows.mapInArrow(run, schema)


class LiveFigures(StatefulProcessor):
    """The newest rows of a key and its running totals; one row of figures a batch."""

    def __init__(self, keep: int, forget_ms: int) -> None:
        self.keep, self.forget_ms = keep, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", HELD, self.forget_ms)
        self.totals = handle.getValueState("totals", TOTALS, self.forget_ms)

    def handleInputRows(self, key: tuple, rows: Iterable[Row], timerValues: object) -> Iterator[Row]:
        names = [c.strip().split(" ")[0] for c in HELD.split(",")]
        new = sorted((r.asDict() for r in rows), key=_order)[-self.keep :]
        old = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        sample = (old + [tuple(r[n] for n in names) for r in new])[-self.keep :]
        self.held.put(sample)
        batches, saved = self.totals.get() if self.totals.exists() else (0, 0)
        seen = [dict(zip(names, r, strict=True)) for r in sample]
        risky = len({r["shipment_id"] for r in seen if r["severe"]} - {None})
        critical = sum(bool(r["critical"]) for r in seen)
        batches, saved = batches + 1, saved + SAVED_PER_RISK * risky + SAVED_PER_ALERT * critical
        self.totals.update((batches, saved))
        yield Row(
            live_key=key[0], records=len(seen), active_shipments=len({r["shipment_id"] for r in seen} - {None}),
            at_risk_shipments=risky, on_time_events=sum(bool(r["on_time"]) for r in seen), critical_alerts=critical,
            batches=batches, saved=saved, routes_optimized=max(batches, risky),
        )

    def close(self) -> None:
        pass


def live_figures(stream: DataFrame, key: Column | None = None, keep: int = KEEP, forget_ms: int = FORGET) -> DataFrame:
    """A row for every key that a batch touches: figures over its newest ``keep`` rows, totals over its batches.

    Rows count as they arrive; inside a batch, by time and id. Without a key the whole
    fleet is one key. State is at most ``keep`` narrow rows and two totals a key, and goes
    when the key gets no row for ``forget_ms``. Start it within ``rocksdb`` in update mode.
    """
    name = F.coalesce(key.cast("string"), F.lit("unknown")) if key is not None else F.lit("fleet")
    marks = (F.coalesce(c, F.lit(False)).alias(n) for n, c in event_marks().items())
    rows = stream.select(name.alias("live_key"), *EVENT_ORDER, "shipment_id", *marks)
    return (
        newest_per_task(rows, "live_key", keep)
        .groupBy("live_key")
        .transformWithState(LiveFigures(keep, forget_ms), T.StructType.fromDDL(FIGURES), "update", "processingTime")
    )


def figures_sink(root: str, fold: int = FOLD) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink of touched keys: a folder a batch, folded into one after every ``fold`` batches.

    A batch that is run again overwrites its own folder, and a fold that is run again
    leaves the same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = f"{root}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(at)
        if batch_id and batch_id % fold == 0:
            # All figures before this batch as one folder, one number lower; a retry makes the same.
            held = current_figures(spark, root, batch_id)
            if held is not None:
                whole = spool(held, "live-figures")
                whole.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id - 1}")
                release(whole)
                drop_batches(spark, root, batch_id - 1)

    return write


def current_figures(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The last figures of every key, of batches before the given one; None without any."""
    numbers = [n for n in batch_folders(spark, root) if before is None or n < before]
    if not numbers:
        return None
    rows = spark.read.schema(FIGURES + ", batch_id bigint").option("basePath", root).parquet(*[f"{root}/batch_id={n}" for n in numbers])
    columns = [c for c in rows.columns if c != "batch_id"]
    return rows.groupBy("live_key").agg(F.max_by(F.struct(*columns), "batch_id").alias("last")).select("last.*")
