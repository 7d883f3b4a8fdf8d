import itertools
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from harborline import schema
from harborline.operators import network
from harborline.sources import views

AS_OF = datetime(2024, 1, 31)


@pytest.fixture(scope="module")
def graph(spark, folder):
    congested = network.congestion(views.route_events(spark, folder), views.ports(spark), AS_OF)
    edges = network.edge_weights(views.lanes(spark), congested).cache()
    paths = network.cheapest_paths(edges).cache()
    return congested, edges, paths


def test_congestion_counts_matches_and_defaults(spark):
    rows = [("port_entry", "LOS Pier"), ("gps_ping", "Los_Angeles"), (None, "Tokyo")]
    events = spark.createDataFrame(rows, "event_type string, location_name string").withColumn(
        "event_timestamp", F.lit("2024-01-30").cast("timestamp")
    )
    got = {r.node: r.congestion for r in network.congestion(events, views.ports(spark), AS_OF).collect()}
    assert got["Los_Angeles"] == pytest.approx(0.5) and got["Tokyo"] == pytest.approx(0.2)
    assert got["Suez"] == 0.3 and len(got) == 15


def test_paths_are_shortest(graph):
    _, edges, paths = graph
    nodes = [p[0] for p in schema.PORTS]
    step = {}
    for e in edges.collect():
        step.setdefault((e.profile, e.transport_mode), {})[e.src, e.dst] = e.weight
    best = {c: {(a, b): 0 if a == b else w.get((a, b)) for a in nodes for b in nodes} for c, w in step.items()}
    for d in best.values():
        for k, a, b in itertools.product(nodes, nodes, nodes):
            if d[a, k] is not None and d[k, b] is not None:
                via = d[a, k] + d[k, b]
                if d[a, b] is None or via < d[a, b]:
                    d[a, b] = via
    rows = paths.collect()
    assert len(rows) == 16 * 225
    for r in rows:
        config = (r.profile, r.transport_mode)
        assert r.weight == best[config][r.origin, r.destination]
        assert r.weight == sum(step[config][hop] for hop in zip(r.path, r.path[1:]))


def test_paths_of_a_split_graph(spark):
    edges = spark.createDataFrame(
        [("a", "b", 2), ("b", "a", 2), ("x", "y", 1), ("b", "c", 1), ("a", "c", 3), ("c", "d", 1), ("d", "e", 1)],
        "src string, dst string, weight bigint",
    ).withColumns({"profile": F.lit("p"), "transport_mode": F.lit("sea")})
    got = {(r.origin, r.destination): (r.weight, r.path) for r in network.cheapest_paths(edges).collect()}
    assert ("a", "x") not in got and got["x", "y"] == (1, ["x", "y"]) and ("y", "x") not in got
    # Equal cost: the lesser path wins.
    assert got["a", "e"] == (5, ["a", "b", "c", "d", "e"])


def test_routes_of_all_kinds_of_pairs(spark, graph):
    _, edges, paths = graph
    details = network.route_details(paths, edges)
    rows = [
        ("S1", "Tokyo", "Tokyo", "sea"), ("S2", "Atlantis", None, "sea"), ("S3", "Hamburg", "Sydney", "rail"),
        ("S4", "Suez", "Busan", None),
    ]
    df = spark.createDataFrame(rows, "shipment_id string, origin_port string, destination_port string, transport_mode string")
    got = {r.shipment_id: r for r in network.route_shipments(df, views.ports(spark), details).collect()}
    assert got["S1"].path == "Tokyo" and got["S1"].total_time_hours == 0 and got["S1"].action == "maintain_route"
    assert (got["S2"].origin, got["S2"].destination) == ("Shanghai", "Rotterdam")
    assert got["S3"].path.startswith("Hamburg>") and got["S4"].transport_mode == "sea"
    options = {r.shipment_id: r for r in network.route_alternatives(df, views.ports(spark), details).collect()}
    assert len(options) == 4 and options["S3"].fastest_path and options["S3"].safest_profile
    plan = network.route_shipments(df, views.ports(spark), details)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_actions_at_their_limits(spark):
    df = spark.createDataFrame([(0.2999,), (0.30,), (0.55,), (0.75,), (None,)], "r double")
    rows = df.select("r", *(c.alias(n) for n, c in network.risk_action(F.col("r")).items())).collect()
    assert [r.action for r in rows[:4]] == ["maintain_route", "minor_adjustment", "major_reroute", "emergency_reroute"]
    assert rows[3].explanation == "Risk 0.75 critical: immediate reroute required."


def test_stops_and_edges_follow_the_path(spark, graph):
    _, edges, paths = graph
    one = paths.where("profile = 'balanced' AND transport_mode = 'sea' AND origin = 'Tokyo' AND destination = 'Hamburg'")
    path = one.first().path
    stops = network.route_stops(one, views.ports(spark)).orderBy("stop").collect()
    legs = network.route_edges(one, edges).orderBy("leg").collect()
    assert [s.node for s in stops] == path
    assert [(e.src, e.dst) for e in legs] == list(zip(path, path[1:]))
