import pytest

from __spark_entry__ import entry, oracle_sql, queries
from harborline.plans.catalog import QUERIES
from harborline.plans.oracle import oracle
from tools.compare import database, difference

# Covered with the small models of test_disruption.py; the full ones take a minute.
TRAINED = {"disruption_scores", "flagged_count", "feature_importances", "stream_scores"}
CHECKED = [
    "risk_heatmap", "risk_heatmap_latest", "bottlenecks", "kpi_report", "carrier_performance_latest", "delay_series",
    "eta_with_on_time", "demand_from_history", "metric_forecast", "port_congestion", "route_shipments", "rule_risk",
    "live_kpis", "profile_numeric", "append_new", "parsed_text", "scaled_delay", "source_status", "stream_congestion",
]


def test_every_query_but_the_trained_has_a_twin():
    assert set(QUERIES) - set(oracle()) == TRAINED
    assert set(oracle()) <= set(QUERIES) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


@pytest.fixture(scope="module")
def con(folder):
    return database(folder)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_twin(spark, con, folder, name):
    text, rows = difference(spark, con, folder, name, oracle_sql()[name])
    assert text == "" and rows > 0
