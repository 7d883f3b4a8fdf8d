import numpy as np
import pandas as pd
import pytest

from harborline.operators import profiling


def test_profile_matches_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [
        (int(v), None if i % 10 == 0 else float(w), float("nan") if i % 7 == 0 else 5.0, None)
        for i, (v, w) in enumerate(zip(rng.integers(0, 9, 500), rng.lognormal(0, 4, 500)))
    ]
    df = spark.createDataFrame(rows, "a int, b double, c double, d double")
    got = {r.column_name: r for r in profiling.profile_numeric(df).collect()}
    for i, name in enumerate("abc"):
        values = np.array([r[i] for r in rows if r[i] is not None and r[i] == r[i]], dtype=float)
        row = got[name]
        assert row["count"] == len(values)
        for key, want in (
            ("mean", values.mean()), ("std", values.std(ddof=1)), ("min", values.min()), ("max", values.max()),
            ("p25", np.percentile(values, 25)), ("p50", np.percentile(values, 50)), ("p75", np.percentile(values, 75)),
        ):
            assert row[key] == pytest.approx(want, abs=2e-3, rel=1e-6), (name, key)
    assert got["d"]["count"] == 0 and got["d"].p50 is None and got["d"]["mean"] is None
    approx = {r.column_name: r for r in profiling.profile_numeric(df, exact=False).collect()}
    assert approx["a"].p50 == got["a"].p50


def test_missing_and_readiness(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), None), (None, "y"), (2.0, "z")], "a double, b string")
    assert {r.column_name: r.missing for r in profiling.profile_missing(df).collect()} == {"a": 2, "b": 1}
    ready = profiling.profile_ready(df).first()
    assert ready.completeness == 0.625 and not ready.suitable_for_prediction
    assert (ready.numeric_features, ready.categorical_features) == (1, 1)
    first = profiling.profile_sample(df, ["b"], 2).collect()
    assert [r.b for r in first] == ["", "x"]


def test_text_insights_read_the_whole_text(spark):
    text = "x" * 700 + " REPORT on Delivery delay, disruption, congestion, route, shipment, risk"
    row = profiling.text_insights(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert row.characters == len(text) and len(row.preview) == 600
    assert row.insights.split("; ") == [
        f"Keyword found: '{w}'" for w in ("delay", "disruption", "port", "congestion", "route", "shipment")
    ]


def test_json_keys(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": 2}}',), ('{"a": 3}',), ("[1]",), (None,)], "j string")
    assert {r.key: r.occurrences for r in profiling.json_keys(df, "j").collect()} == {"a": 2, "b": 1}


def test_infinite_and_large_values(spark):
    df = spark.createDataFrame([(1.0, 1_700_000_000_000), (2.0, 1_700_000_000_500), (3.0, None), (float("inf"), 7)], "a double, t bigint")
    rows = {r.column_name: r for r in profiling.profile_numeric(df).collect()}
    assert rows["a"]["count"] == 4 and rows["a"]["mean"] == float("inf") and rows["a"]["max"] == float("inf")
    assert rows["a"]["min"] == 1.0 and rows["a"]["p50"] == 2.5
    assert rows["t"]["max"] == 1_700_000_000_500 and abs(rows["t"]["mean"] - 3_400_000_000_507 / 3) < 1


@pytest.mark.parametrize("missed", [False, True])
def test_quartiles_from_brackets_are_exact(spark, monkeypatch, missed):
    """Ties, a hot value, infinities, few and no rows; and a sketch that misses its bound."""
    rng = np.random.default_rng(3)
    n = 20_000
    frame = pd.DataFrame({
        "normal": rng.normal(size=n), "hot": np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 50, n)), "whole": rng.integers(-5, 5, n),
        "rare": np.where(rng.random(n) < 0.0002, 1.0, np.nan), "none": np.full(n, np.nan), "endless": np.where(rng.random(n) < 0.3, np.inf, rng.normal(size=n)),
        "same": np.full(n, 2.5),
    })
    if missed:
        real = profiling.bracketed_quantiles
        wrong = lambda df, counts, brackets, points: real(df, counts, {c: [(hi + 1, hi + 2) for _, hi in b] for c, b in brackets.items()}, points)
        monkeypatch.setattr(profiling, "bracketed_quantiles", wrong)
    got = {r.column_name: r for r in profiling.profile_numeric(spark.createDataFrame(frame).repartition(6)).collect()}
    assert set(got) == set(frame.columns) and got["none"].p50 is None and got["none"]["count"] == 0
    for name in set(frame.columns) - {"none"}:
        values = frame[name].dropna()
        for column, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
            # Between two infinite values pandas finds nothing.
            want = values.quantile(q) if np.isfinite(values.quantile(q, interpolation="higher")) else float("inf")
            assert got[name][column] == want or got[name][column] == pytest.approx(want, abs=5.1e-4), (name, column)
