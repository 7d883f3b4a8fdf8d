import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from harborline.operators import live
from harborline.sources import views
from harborline.streaming import events as streams, live_state, windows

BASE = datetime(2024, 1, 1)
FIELDS = (
    "event_id string, shipment_id string, event_timestamp timestamp, risk_score_delta double, "
    "delay_added_hours double, port_wait_hours double, anomaly_flag boolean, location_name string, event_type string"
)


def telemetry(n, seed=1):
    """A third of the rows belong to one shipment; some have none."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        ship = "HOT" if i % 3 == 0 else None if i % 31 == 0 else f"S{rng.randrange(40)}"
        rows.append((
            f"E{i:05d}", ship, BASE + timedelta(minutes=i), rng.choice([None, -0.1, 0.1, 0.15, 0.2]),
            rng.choice([0.0, 0.0, 3.0, 7.0, None]), rng.choice([0.0, 5.0, 13.0]), rng.random() < 0.05,
            rng.choice(["Tokyo", "Suez"]), rng.choice(["port_entry", "gps_ping"]),
        ))
    return rows


def simulate(rows, batch, keep):
    out = {}
    for tick, start in enumerate(range(0, len(rows), batch), 1):
        sample = rows[: start + batch][-keep:]
        risky, on_time, critical = set(), 0, 0
        for _, ship, _, delta, delay, wait, anomaly, _, _ in sample:
            delta, delay, wait = delta or 0, delay or 0, wait or 0
            if (anomaly or delta >= 0.12 or delay >= 6 or wait >= 12) and ship:
                risky.add(ship)
            on_time += delay <= 0 and not anomaly
            critical += anomaly or delta >= 0.18
        active = len({r[1] for r in sample if r[1]})
        out[tick] = (len(sample), active, len(risky), round(on_time / len(sample), 4), critical, max(tick, len(risky)))
    return out


@pytest.mark.parametrize("n,batch,keep,block", [(333, 5, 50, 7), (333, 4, 250, 2000), (40, 7, 3, 2), (3, 5, 250, 10)])
def test_live_kpis_equal_a_simulation(spark, monkeypatch, n, batch, keep, block):
    monkeypatch.setattr(live, "TICKS_PER_BLOCK", block)
    rows = telemetry(n)
    got = live.live_kpis(spark.createDataFrame(rows, FIELDS), batch, keep).collect()
    figures = {
        r.tick: (r.records, r.active_shipments, r.at_risk_shipments, r.on_time_rate, r.critical_alerts, r.routes_optimized)
        for r in got
    }
    assert len(got) == len(figures)
    want = simulate(rows, batch, keep)
    assert {t: v[:3] + v[4:] for t, v in figures.items()} == {t: v[:3] + v[4:] for t, v in want.items()}
    assert all(figures[t][3] == pytest.approx(want[t][3], abs=1e-4) for t in want)


def test_savings_count_each_tick_once(spark):
    rows = telemetry(60)
    kpis = live.live_kpis(spark.createDataFrame(rows, FIELDS), 5, 20)
    total, want = 0, {}
    for tick, v in simulate(rows, 5, 20).items():
        total += 120 * v[2] + 40 * v[4]
        want[tick] = total
    assert {r.tick: r.total_saved for r in live.live_savings(kpis).collect()} == want


def test_replay_wraps(spark):
    df = spark.createDataFrame(telemetry(13), FIELDS)
    rows = live.replay_ticks(df, batch=5, laps=2).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.tick, []).append(r.event_id)
        assert len(rows) == 26 and r.total_rows == 13
    assert [len(sizes[t]) for t in range(1, 7)] == [5, 5, 3, 5, 5, 3]
    assert sorted(sizes[4]) == sorted(sizes[1])
    last = [r for r in rows if r.tick == 6][0]
    assert (last.offset, last.batch_size, last.processed_records) == (10, 3, 26)
    assert live.replay_ticks(df, batch=5, ticks=4).select("tick").distinct().count() == 4


def write_pieces(spark, rows, path, pieces):
    size = -(-len(rows) // pieces)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], FIELDS).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("pieces", [1, 4])
def test_stream_equals_batch(spark, tmp_path, pieces):
    rows = telemetry(300)
    write_pieces(spark, rows, f"{tmp_path}/in", pieces)
    stream = streams.event_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], FIELDS).schema)
    writer = stream.writeStream.foreachBatch(live_state.live_kpis_sink(f"{tmp_path}/out", keep=120))
    streams.start(writer, f"{tmp_path}/cp", interval=None).awaitTermination()
    row = streams.read_batch(spark, f"{tmp_path}/out/kpis", pieces).first()
    want = simulate(rows, -(-300 // pieces), 120)
    last = want[max(want)]
    assert (row.records, row.active_shipments, row.at_risk_shipments, row.critical_alerts) == (*last[:3], last[4])
    assert row.batches == pieces and row.saved == sum(120 * v[2] + 40 * v[4] for v in want.values())


def test_stop_and_resume_without_repeats(spark, tmp_path):
    rows = telemetry(90)
    root, schema = f"{tmp_path}/out", spark.createDataFrame([], FIELDS).schema
    write_pieces(spark, rows[:60], f"{tmp_path}/in", 2)
    for more in ([], rows[60:]):
        if more:
            write_pieces(spark, more, f"{tmp_path}/in", 1)
        stream = streams.event_stream(spark, f"{tmp_path}/in", schema)
        query = streams.start(stream.writeStream.foreachBatch(streams.batch_payload(root)), f"{tmp_path}/cp", interval=None)
        query.awaitTermination()
    ledger = spark.read.parquet(f"{root}/ledger").orderBy("tick").collect()
    assert [(r.tick, r.offset, r.batch_size, r.processed_records) for r in ledger] == [
        (1, 0, 30, 30), (2, 30, 30, 60), (3, 60, 30, 90)
    ]
    assert spark.read.parquet(f"{root}/records").select("event_id").distinct().count() == 90
    health = streams.stream_health(spark.read.parquet(f"{root}/ledger"), "route_events", query.isActive, every=2).orderBy("tick").collect()
    assert [(r.tick, r.processed_records, r.connected) for r in health] == [(2, 60, True), (3, 90, False)]


def test_a_gap_between_batches_keeps_the_counts(spark, tmp_path):
    rows = spark.createDataFrame(telemetry(40), FIELDS)
    ledger, live = streams.batch_payload(f"{tmp_path}/l", 40), live_state.live_kpis_sink(f"{tmp_path}/k")
    for number in (0, 1, 3):
        part = rows.where(f"event_id >= 'E{10 * min(number, 2):05d}' and event_id < 'E{10 * min(number, 2) + 10:05d}'")
        ledger(part, number)
        live(part, number)
    last = streams.read_batch(spark, f"{tmp_path}/l/ledger", 4).first()
    assert (last.tick, last.offset, last.processed_records, last.total_rows) == (3, 20, 30, 40)
    kpis = streams.read_batch(spark, f"{tmp_path}/k/kpis", 4).first()
    assert kpis.records == 30 and kpis.batches == 3
    with pytest.raises(RuntimeError):
        streams.read_batch(spark, f"{tmp_path}/nothing", 5)


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame(telemetry(50), FIELDS)
    sink = live_state.live_kpis_sink(str(tmp_path), F.col("location_name"), keep=10)
    sink(rows.where("event_id < 'E00025'"), 0)
    sink(rows.where("event_id >= 'E00025'"), 1)
    first = sorted(streams.read_batch(spark, f"{tmp_path}/kpis", 2).collect())
    sink(rows.where("event_id >= 'E00025'"), 1)
    assert sorted(streams.read_batch(spark, f"{tmp_path}/kpis", 2).collect()) == first


def test_late_rows_and_repeats_are_dropped(spark, tmp_path):
    def row(i, day):
        return (f"E{i}", "S", datetime(2024, 1, day), 0.0, 0.0, 0.0, False, "Tokyo", "port_entry")

    for part in ([row(1, 1), row(2, 20)], [row(2, 20), row(4, 21)], [row(3, 2), row(5, 28), row(6, 29)], [row(7, 30)]):
        spark.createDataFrame(part, FIELDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = streams.event_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], FIELDS).schema)

    def run(stream, name):
        writer = stream.writeStream.format("parquet").option("path", f"{tmp_path}/{name}")
        streams.start(writer, f"{tmp_path}/{name}-cp", interval=None).awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{tmp_path}/{name}")

    ids = sorted(r.event_id for r in run(windows.dedup_stream(source), "dedup").collect())
    assert ids == ["E1", "E2", "E4", "E5", "E6", "E7"]
    closed = {r.window_start.day: r.events for r in run(windows.congestion_stream(source), "cong").collect() if r.window_start.month == 1}
    # The event of the 2nd came after the watermark had passed its windows.
    assert closed[1] == 1 and closed[20] == 3


def test_streaming_telemetry_view(spark, folder):
    raw = spark.read.parquet(f"{folder}/events.parquet")
    assert views.telemetry(raw, 1500).count() == raw.count()
