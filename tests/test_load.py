import gzip
import json
import time
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import DataFrameReader, functions as F

from harborline import schema
from harborline.operators import monitoring
from harborline.plans import catalog
from harborline.session import scratch_root
from harborline.sources import conform, csv_load, pipeline, readers, sinks, tables, views

HEADER = "shipment_id,carrier,origin_port,destination_port,transport_mode,status,created_date,delay_hours,insurance_required"


@pytest.fixture
def store(spark, tmp_path):
    """Tables in a database of their own, in the current session."""
    name = f"db_{abs(hash(str(tmp_path)))}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/db'")
    spark.catalog.setCurrentDatabase(name)
    yield f"{tmp_path}/tables"
    spark.catalog.setCurrentDatabase("default")


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_bad_rows_are_kept_apart(spark, tmp_path):
    path = write(
        tmp_path / "s.csv", HEADER,
        "S1,A,Suez,Dubai,sea,Delayed,2001-01-01,5.0,YES",
        "S2,A,Suez,Dubai,sea,Delayed,2001-01-01,abc,no",
        "S3,A,Suez,Dubai,sea,Delayed,2001-01-01,1.0,no,extra",
        ",A,Suez,Dubai,sea,Delayed,2001-01-01,,no",
        "S5,,,,,,,,",
    )
    good, bad = csv_load.split_good_bad(csv_load.load_csv(spark, path, schema.SHIPMENTS), "shipment_id")
    assert sorted(r.shipment_id for r in good.collect()) == ["S1", "S5"]
    assert sorted(r.reason for r in bad.collect()) == ["malformed", "malformed", "no_key"]
    rows = {r.shipment_id: r for r in conform.conform(good, schema.SHIPMENTS).collect()}
    assert rows["S1"].insurance_required is True and rows["S5"].insurance_required is None
    assert rows["S5"].carrier is None and rows["S1"].ingested_at is not None


def test_pipeline_counts_and_first_row_wins(spark, tmp_path, store):
    write(
        tmp_path / "shipments_master.csv", HEADER,
        "S1,first,Suez,Dubai,sea,Delayed,2001-01-01,5.0,t",
        "S1,second,Suez,Dubai,sea,Delayed,2001-01-01,4.0,f",
        "S2,A,Suez,Dubai,sea,Delayed,2001-02-01,x,f",
        f"S3,{'long' * 20},Suez,Dubai,sea,Delayed,,1.0,f",
    )
    report = {r.table_name: r for r in pipeline.run_pipeline(spark, str(tmp_path), store).collect()}
    row = report["shipments_master"]
    assert (row.status, row.rows_read, row.rows_inserted, row.rows_duplicate, row.rows_errored) == ("partial", 4, 2, 1, 1)
    assert row.rows_read == row.rows_inserted + row.rows_duplicate + row.rows_errored
    assert row.long_texts == 1 and row.file_bytes > 0
    assert report["route_events"].status == "skipped"
    assert spark.table("shipments_master").where("shipment_id = 'S1'").first().carrier == "first"
    again = {r.table_name: r for r in pipeline.run_pipeline(spark, str(tmp_path), store).collect()}
    assert again["shipments_master"].rows_inserted == 0 and again["shipments_master"].rows_duplicate == 3
    assert tables.tables_exist(spark) == {"shipments_master": True, "route_events": True}
    month = spark.table("shipments_master").where("created_month = '2001-01'")
    assert "PartitionFilters: [isnotnull(created_month" in month._jdf.queryExecution().executedPlan().toString()


def test_single_source_loads_its_table(spark, tmp_path, store):
    write(tmp_path / "route_events.csv", "event_id,shipment_id,event_timestamp,latitude", "E1,S1,2024-01-01 10:00:00,1.5")
    rows = pipeline.run_pipeline(spark, str(tmp_path), store, source="gps_iot").collect()
    assert [(r.table_name, r.rows_inserted) for r in rows] == [("route_events", 1)]
    assert pipeline.run_pipeline(spark, str(tmp_path), store, source="weather_api").first().status == "no_table"
    stored = spark.table("route_events").first()
    assert stored.event_date == "2024-01-01" and stored.event_timestamp == datetime(2024, 1, 1, 10)


def test_upload_in_another_spelling(spark, tmp_path, store):
    path = write(
        tmp_path / "u.csv", "id,origin,destination,mode,status,weight_tons,eta",
        "U1,Shanghai,Los Angeles,sea,On Schedule,2.5,2024-08-15T14:00:00",
    )
    assert pipeline.load_upload(spark, path, store).first().rows_inserted == 1
    row = spark.table("shipments_master").first()
    assert (row.shipment_id, row.destination_port, row.status) == ("U1", "Los_Angeles", "On_Schedule")
    assert float(row.weight_kg) == 2500 and row.eta_date == date(2024, 8, 15)


def test_append_new_sends_few_rows_of_a_hot_key(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id) as k", "id as seq")
    fresh = tables.append_new(spark.createDataFrame([(1,)], "k bigint"), df, "k", ["seq"])
    rows = {r.k: r.seq for r in fresh.collect()}
    assert len(rows) == 2000 and rows[0] == 0 and 1 not in rows
    assert "WindowGroupLimit" in fresh._jdf.queryExecution().executedPlan().toString()


def test_readers_and_unknown_formats(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": None}]))
    assert readers.read_any(spark, f"{tmp_path}/a.json", "JSON").count() == 2
    assert readers.read_any(spark, "x", "docx").first().error == "Unsupported format: .docx"


def test_json_rows_keep_null(spark):
    df = spark.createDataFrame(
        [(1, None, date(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5)), (2, "x", None, datetime(2024, 1, 2, 3, 4, 5, 60))],
        "a int, b string, d date, t timestamp",
    )
    first, second = (json.loads(r.json) for r in sinks.to_json_rows(df).collect())
    assert first == {"a": 1, "b": None, "d": "2024-01-02", "t": "2024-01-02T03:04:05"}
    assert second["t"] == "2024-01-02T03:04:05.000060"


def test_status_of_sources(spark):
    stats = monitoring._typed(
        views.small_table(spark, monitoring.STATS, [("shipments_master", 0, 0, None), ("route_events", 0, 0, "gone")])
    )
    got = {r.source: r.status for r in monitoring.source_status(views.source_registry(spark), stats).collect()}
    assert got["historical_db"] == "empty" and got["kafka_stream"] == "db_unavailable" and got["customs_api"] == "no_table"
    missing = monitoring.table_stats(spark, ["no_such_table"]).first()
    assert missing.row_count == 0 and missing.error == "TABLE_OR_VIEW_NOT_FOUND"


def test_stats_of_stored_tables(spark, tmp_path, store):
    write(tmp_path / "shipments_master.csv", HEADER, "S1,A,Suez,Dubai,sea,Delayed,2001-01-01,5.0,t")
    pipeline.run_pipeline(spark, str(tmp_path), store)
    stats = {r.table_name: r for r in monitoring.table_stats(spark, list(schema.CONTRACTS)).collect()}
    assert stats["shipments_master"].row_count == 1 and stats["shipments_master"].size_bytes > 0
    assert stats["route_events"].row_count == 0 and stats["route_events"].error is None
    assert monitoring.rows_loaded(spark, "shipments_master").first().rows_loaded == 1


def test_quoted_values_and_headers_per_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.csv", "shipment_id,carrier,status", 'S1,"Say ""Hi"", Ltd",Delayed', 'S2,"two\nlines",Delayed')
    write(tmp_path / "in" / "b.csv", "shipment_id,status,carrier", "S3,Delivered,C")
    read = csv_load.load_csv(spark, f"{tmp_path}/in", schema.SHIPMENTS, multi_line=True)
    good, bad = csv_load.split_good_bad(read, "shipment_id")
    rows = {r.shipment_id: (r.carrier, r.status) for r in good.collect()}
    assert rows == {"S1": ('Say "Hi", Ltd', "Delayed"), "S2": ("two\nlines", "Delayed"), "S3": ("C", "Delivered")}
    assert bad.count() == 0


def test_upload_without_keys_inserts_nothing_twice(spark, tmp_path, store):
    path = write(tmp_path / "u.csv", "id,carrier,stops", ",A,1", ",B,2", "U1,C,zz", "U2,D,3")
    for want in (1, 0):
        row = pipeline.load_upload(spark, path, store).first()
        assert (row.rows_inserted, row.rows_errored, row.rows_read) == (want, 3, 4)
    kept = spark.table(tables.REJECTED).groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in kept} == {"no_key": 4, "unreadable": 2}


def _stored(spark, tmp_path, buckets=4):
    session = spark.newSession()
    name = f"keys_{tmp_path.name}".replace("-", "_")
    session.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/db'")
    session.catalog.setCurrentDatabase(name)
    tables.ensure_tables(session, f"{tmp_path}/tables", buckets)
    return session


def _telemetry_rows(session, ids):
    empty = session.table("route_events").drop("event_date")
    rows = session.createDataFrame([(i, datetime(2024, 1, 1 + k % 20), "f", 0, k) for k, i in enumerate(ids)],
                                   "event_id string, event_timestamp timestamp, _file string, _block bigint, _line bigint")
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema if f.name not in rows.columns]
    return rows.select("*", *others)


def _load(session, ids):
    rows = tables.append_unstored(_telemetry_rows(session, ids), "route_events", tables.ARRIVAL)
    return tables.insert(rows.drop(*tables.ARRIVAL), "route_events")


def test_a_load_moves_its_own_rows_and_not_the_stored_keys(spark, tmp_path):
    session = _stored(spark, tmp_path)
    assert _load(session, [f"E{i}" for i in range(300)]) == 300
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    session.conf.set("spark.sql.adaptive.enabled", "false")
    rows = tables.append_unstored(_telemetry_rows(session, ["E5", "E900", "E900", "E901"]), "route_events", tables.ARRIVAL)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "route_events_keys" in line and "Scan" in line)
    above, depth = [], len(lines[scan])
    for line in reversed(lines[: scan + 1]):  # the operators from the scan up to the join
        at = len(line) - len(line.lstrip(" :+-*"))
        if at < depth:
            depth = at
            above.append(line)
            if "SortMergeJoin" in line:
                break
    assert "Bucketed: true" in above[0] and not any("Exchange" in line for line in above), plan
    assert "route_events/" not in plan.replace("route_events_keys", "")  # the wide table is not read
    assert sorted(r.event_id for r in rows.collect()) == ["E900", "E901"]


def test_loads_again_and_after_lost_or_foreign_keys(spark, tmp_path):
    session = _stored(spark, tmp_path)
    assert _load(session, ["A", "B", "A", None]) == 2
    assert _load(session, ["B", "C"]) == 1
    assert {r[0] for r in session.table("route_events_keys").collect()} == {"A", "B", "C"}
    # Rows that came another way, or a run that ended before its keys were written.
    part = _telemetry_rows(session, ["D"]).drop(*tables.ARRIVAL).withColumn("event_date", F.lit("2024-01-01"))
    part.select(*session.table("route_events").columns).write.insertInto("route_events")
    assert _load(session, ["A", "D", "E"]) == 1
    assert sorted(r[0] for r in session.table("route_events_keys").collect()) == ["A", "B", "C", "D", "E"]
    assert session.table("route_events").count() == 5


def _files(spark, *labels):
    """Files of the scratch area below the labels, and shuffle files of this process."""
    root = Path(scratch_root(spark).removeprefix("file:")) / "harborline"
    spooled = {str(f) for label in labels for f in root.glob(f"{label}-*/**/*.parquet")}
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return spooled, {f for f in blocks.split("\n") if "/shuffle_" in f}


def _left_by(spark, run, *labels):
    spooled, shuffled = _files(spark, *labels)
    run()
    for _ in range(50):  # shuffle files go in the background
        now = _files(spark, *labels)
        if not now[1] - shuffled:
            break
        time.sleep(0.1)
    return now[0] - spooled, now[1] - shuffled


def test_a_load_leaves_its_tables_only(spark, tmp_path, store):
    write(tmp_path / "shipments_master.csv", HEADER, *(f"S{i % 70},A,Suez,Dubai,sea,Delayed,2001-0{1 + i % 9}-01,5.0,t" for i in range(100)),
          "S100,A,Suez,Dubai,sea,Delayed,2001-01-01,x,t")
    runs = []

    def twice():
        runs.extend(pipeline.run_pipeline(spark, str(tmp_path), store).collect()[0] for _ in range(2))

    assert _left_by(spark, twice, "staged", "insert", "keys", "rejected") == (set(), set())
    assert [(r.rows_read, r.rows_inserted, r.rows_duplicate, r.rows_errored) for r in runs] == [(101, 70, 30, 1), (101, 0, 100, 1)]
    stored, held = spark.table("shipments_master"), spark.table("shipments_master_keys")
    assert {r[0] for r in stored.select("shipment_id").collect()} == {f"S{i}" for i in range(70)} == {r[0] for r in held.collect()}
    assert stored.count() == held.count() == 70


def test_slices_of_a_load_are_its_rows(spark, tmp_path):
    session = _stored(spark, tmp_path)
    assert _load(session, ["A", "B"]) == 2
    rows = _telemetry_rows(session, ["B", "C", "C", *(f"E{i}" for i in range(50)), None])
    parts = [tables.append_unstored(rows, "route_events", tables.ARRIVAL, nth).collect() for nth in range(tables.LOAD_SLICES)]
    assert all(parts) and sorted(r.event_id for part in parts for r in part) == sorted(["C", *(f"E{i}" for i in range(50))])
    assert [r._line for part in parts for r in part if r.event_id == "C"] == [1]


def test_csv_input_is_packed_and_made_in_slices(spark, folder):
    made = []
    assert _left_by(spark, lambda: made.extend(catalog._csv_folder(spark, folder)))[1] == set()
    for name, rows in (("shipments_master", views.shipments(spark, folder)), ("route_events", views.route_events(spark, folder))):
        files = [f for f in Path(made[1].removeprefix("file:")).glob(f"{name}.csv/part-*")]
        assert files and all(f.name.endswith(".csv.gz") for f in files)
        back = spark.read.option("header", True).csv(f"{made[1]}/{name}.csv")
        key = schema.KEYS[name]
        assert sorted(r[0] for r in back.select(key).collect()) == sorted(r[0] for r in rows.select(key).collect())


def test_slices_of_the_shipments_are_the_shipments(spark, folder):
    parts = [views.shipments(spark, folder, nth, 3) for nth in range(3)]
    assert all(part.count() for part in parts)
    assert sorted(map(str, (r for part in parts for r in part.collect()))) == sorted(map(str, views.shipments(spark, folder).collect()))


def test_headers_of_packed_files_are_read_once(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for n in range(5):
        (tmp_path / "in" / f"{n}.csv.gz").write_bytes(gzip.compress(f"\nshipment_id,carrier\nS{n},A\n".encode()))
    write(tmp_path / "in" / "x.csv", "carrier,shipment_id", "B,S9")
    found, reads = csv_load._headers(spark, f"{tmp_path}/in"), []
    assert {h: len(f) for h, f in found.items()} == {("shipment_id", "carrier"): 5, ("carrier", "shipment_id"): 1}
    csv = DataFrameReader.csv
    monkeypatch.setattr(DataFrameReader, "csv", lambda self, *a, **b: reads.append(a) or csv(self, *a, **b))
    csv_load._headers(spark, f"{tmp_path}/in")
    assert len(reads) == 2
    rows = csv_load.load_csv(spark, f"{tmp_path}/in", schema.SHIPMENTS).collect()
    assert {r.shipment_id: r.carrier for r in rows} == {**{f"S{n}": "A" for n in range(5)}, "S9": "B"}


def test_ensure_tables_leaves_its_input_and_tables_only(spark, folder):
    made = []
    left = _left_by(spark, lambda: made.append(catalog.ensure_tables(spark, folder)), "staged", "insert", "keys", "rejected")
    assert left == (set(), set())
    counts = {"shipments_master": views.shipment_count(spark, folder), "route_events": views.table(spark, folder, "events").count()}
    want = {name: (n, len(schema.CONTRACTS[name]) + 1) for name, n in counts.items()}
    assert {r.table_name: (r.rows, r["columns"]) for r in made[0].collect()} == want
