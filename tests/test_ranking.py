import random
from datetime import datetime, timedelta

import pytest

from harborline.operators import ranking

BASE = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    """A third of all rows share one timestamp; some have none."""
    rng = random.Random(3)
    out = []
    for i in range(900):
        at = BASE if i % 3 == 0 else None if i % 50 == 0 else BASE + timedelta(minutes=rng.randrange(9000))
        out.append((f"E{i:05d}", at))
    return out


def newest(rows, n):
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or BASE, r[0]), reverse=True)
    return {r[0] for r in order[:n]}


@pytest.mark.parametrize("n", [1, 20, 150, 640, 899, 5000])
def test_latest_equals_a_full_sort(spark, rows, n):
    df = spark.createDataFrame(rows, "event_id string, at timestamp")
    got = {r.event_id for r in ranking.latest(df, "at", "event_id", n).collect()}
    assert got == newest(rows, n)


def test_latest_by_text(spark, rows):
    df = spark.createDataFrame(rows, "event_id string, at timestamp")
    got = {r.event_id for r in ranking.latest(df, "event_id", "event_id", 333).collect()}
    assert got == {f"E{i:05d}" for i in range(900 - 333, 900)}


def test_numbers_are_dense_and_ordered(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[1]], "event_id string, at timestamp").repartition(7)
    numbered = ranking.number_rows(df, ["at", "event_id"])
    got = [(r.at, r.event_id) for r in numbered.rows.orderBy("row_index").collect()]
    assert got == sorted(got)
    index = sorted(r.row_index for r in numbered.rows.collect())
    assert index == list(range(numbered.total))


def test_empty_table(spark):
    df = spark.createDataFrame([], "event_id string, at timestamp")
    assert ranking.number_rows(df, ["at", "event_id"]).total == 0
    assert ranking.latest(df, "at", "event_id", 500).count() == 0


def test_pages_cover_the_table(spark, rows):
    df = spark.createDataFrame(rows, "event_id string, at timestamp")
    pages = [[r.event_id for r in ranking.page(df, ["event_id"], 400, o).collect()] for o in (0, 400, 800)]
    assert [len(p) for p in pages] == [400, 400, 100]
    assert sorted(sum(pages, [])) == [r[0] for r in rows]


def test_running_total_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MAX_BLOCKS", 3)
    n = 5000
    df = spark.range(1, n + 1).selectExpr("id as tick", "id % 7 as v")
    got = {r.tick: r.total for r in ranking.running_total(df, "tick", n, {"v": "total"}).collect()}
    want, total = {}, 0
    for i in range(1, n + 1):
        total += i % 7
        want[i] = total
    assert got == want


def test_weights_before(spark):
    df = spark.createDataFrame([(k, k % 3 + 1) for k in range(50)], "k int, w int")
    got = {r.k: r.before for r in ranking.weight_before(df, ["k"], "w", "before").collect()}
    total = 0
    for k in range(50):
        assert got[k] == total
        total += k % 3 + 1


def test_latest_across_a_repeated_hour(spark):
    from datetime import datetime, timedelta, timezone

    start = datetime(2024, 11, 3, 0, tzinfo=timezone.utc)
    rows = [(i, start + timedelta(minutes=i)) for i in range(720)]
    df = spark.createDataFrame(rows, "k bigint, at timestamp")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted(r.k for r in ranking.latest(df, "at", "k", 480).select("k").collect()) == list(range(240, 720))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("size,offset", [(10, 0), (7, 295), (130, 250), (400, 5), (50, 860), (40, 900), (5, 899)])
def test_a_page_by_time_with_a_hot_and_a_missing_time(spark, rows, size, offset):
    df = spark.createDataFrame(rows, "event_id string, at timestamp")
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or BASE, r[0]))
    got = [r.event_id for r in ranking.page(df, ["at", "event_id"], size, offset).collect()]
    assert sorted(got) == sorted(r[0] for r in order[offset : offset + size])
    ntz = ranking.page(df.select("event_id", df["at"].cast("timestamp_ntz").alias("at")), ["at", "event_id"], size, offset)
    assert sorted(r.event_id for r in ntz.collect()) == sorted(got)


@pytest.mark.parametrize("kind", ["bigint", "double", "date"])
def test_a_page_by_other_kinds(spark, kind):
    df = spark.range(300).selectExpr("id", f"cast({'date_add(date\'2024-01-01\', cast(id % 40 as int))' if kind == 'date' else 'id % 40 - 7'} as {kind}) as k")
    want = [r.id for r in df.orderBy("k", "id").collect()]
    for offset in (0, 33, 290):
        assert sorted(r.id for r in ranking.page(df, ["k", "id"], 20, offset).collect()) == sorted(want[offset : offset + 20])


def test_a_kept_directory_is_added_to_and_only_its_buckets_are_read(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "event_id string, at timestamp")
    old, new = df.where("event_id < 'E00500'"), df.where("event_id >= 'E00500'")
    kept = ranking.merged_directory(ranking.rank_directory(old, "at"), ranking.rank_directory(new, "at"))
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in ranking.rank_directory(df, "at").collect()}
    df.write.parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    one = ranking.page(stored, ["at", "event_id"], 5, 500, kept)
    plan = one._jdf.queryExecution().executedPlan().toString()
    # The scan gets the bounds of the page; the order is a top-k, not an exchange of the table.
    assert "GreaterThanOrEqual(at" in plan and "LessThan(at" in plan and "Exchange" not in plan
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or BASE, r[0]))
    assert [r.event_id for r in one.collect()] == [r[0] for r in order[500:505]]
