import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from harborline.streaming import events as streams, live_figures
from tests.test_live import BASE, FIELDS, simulate, telemetry, write_pieces

NAMES = ["records", "active_shipments", "at_risk_shipments", "critical_alerts"]


def run(spark, tmp_path, key=None, keep=120, fold=live_figures.FOLD, files=1):
    schema = spark.createDataFrame([], FIELDS).schema
    stream = streams.event_stream(spark, f"{tmp_path}/in", schema, files_per_batch=files)
    figures = live_figures.live_figures(stream, key, keep)
    writer = figures.writeStream.outputMode("update").foreachBatch(live_figures.figures_sink(f"{tmp_path}/out", fold))
    with live_figures.rocksdb(spark):
        query = streams.start(writer, f"{tmp_path}/cp", interval=None)
    query.awaitTermination()
    return live_figures.current_figures(spark, f"{tmp_path}/out")


def check(row, want, batches):
    last = want[max(want)]
    assert [row[n] for n in NAMES] == [*last[:3], last[4]]
    assert row.on_time_events / row.records == pytest.approx(last[3], abs=1e-4)
    assert row.batches == batches and row.saved == sum(120 * v[2] + 40 * v[4] for v in want.values())
    assert row.routes_optimized == max(batches, last[2])


@pytest.mark.parametrize("pieces", [1, 4, 12])
def test_stream_equals_batch(spark, tmp_path, pieces):
    rows = telemetry(300)
    write_pieces(spark, rows, f"{tmp_path}/in", pieces)
    check(run(spark, tmp_path, fold=3).first(), simulate(rows, 300 // pieces, 120), pieces)


def test_only_touched_keys_are_written_and_others_stay(spark, tmp_path):
    rows = telemetry(240, seed=3)
    parts = [rows[:80], [r for r in rows[80:160] if r[7] == "Tokyo"], rows[160:]]
    for part in parts:
        shuffled = random.Random(1).sample(part, len(part))  # order of arrival inside a batch does not count
        spark.createDataFrame(shuffled, FIELDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = {r.live_key: r for r in run(spark, tmp_path, F.col("location_name"), keep=25).collect()}
    second = spark.read.parquet(f"{tmp_path}/out/batch_id=1").collect()
    assert [r.live_key for r in second] == ["Tokyo"]
    for place, batches in (("Tokyo", 3), ("Suez", 2)):
        mine = [[r for r in p if r[7] == place] for p in parts]
        sample, saved = [], 0
        for part in (p for p in mine if p):
            sample = (sample + part)[-25:]
            risky = {r[1] for r in sample if r[1] and (r[6] or (r[3] or 0) >= 0.12 or (r[4] or 0) >= 6 or (r[5] or 0) >= 12)}
            critical = sum(r[6] or (r[3] or 0) >= 0.18 for r in sample)
            saved += 120 * len(risky) + 40 * critical
        assert (got[place].batches, got[place].records, got[place].saved) == (batches, 25, saved)
        assert (got[place].at_risk_shipments, got[place].critical_alerts) == (len(risky), critical)


def test_restart_repeats_nothing(spark, tmp_path):
    rows = telemetry(200, seed=5)
    write_pieces(spark, rows[:100], f"{tmp_path}/in", 2)
    run(spark, tmp_path, fold=2)
    again = run(spark, tmp_path, fold=2).first()  # nothing new has come
    check(again, simulate(rows[:100], 50, 120), 2)
    write_pieces(spark, rows[100:], f"{tmp_path}/in", 2)
    check(run(spark, tmp_path, fold=2).first(), simulate(rows, 50, 120), 4)


def test_a_task_sends_at_most_the_newest_rows(spark):
    rows = [("hot" if i % 3 else f"k{i}", BASE + timedelta(minutes=i % 977), f"E{i:05d}") for i in range(3_000)]
    rows += [("hot", None, "E"), ("hot", BASE, None), (None, None, None)]
    df = spark.createDataFrame(rows, "live_key string, event_timestamp timestamp, event_id string").repartition(4)
    got = live_figures.newest_per_task(df, "live_key", 20).collect()
    hot = sorted((r for r in got if r.live_key == "hot"), key=lambda r: live_figures._order(r.asDict()))
    assert len(hot) <= 80 and len(got) == len(hot) + 1_000 + 1
    want = sorted((r for r in rows if r[0] == "hot"), key=lambda r: tuple((x is not None, x) for x in r[1:]))[-20:]
    assert [tuple(r) for r in hot[-20:]] == want


def test_state_goes_with_time(spark, tmp_path):
    """A key that gets no row for its time to live starts anew."""
    import time

    schema = spark.createDataFrame([], FIELDS).schema
    rows = telemetry(40)
    for part in (rows[:20], rows[20:]):
        spark.createDataFrame(part, FIELDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streams.event_stream(spark, f"{tmp_path}/in", schema)
        figures = live_figures.live_figures(stream, forget_ms=1_000)
        writer = figures.writeStream.outputMode("update").foreachBatch(live_figures.figures_sink(f"{tmp_path}/out"))
        with live_figures.rocksdb(spark):
            streams.start(writer, f"{tmp_path}/cp", interval=None).awaitTermination()
        time.sleep(2)
    row = live_figures.current_figures(spark, f"{tmp_path}/out").first()
    assert (row.records, row.batches) == (20, 1)
