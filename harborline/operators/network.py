"""Port congestion, lane weights, cheapest paths and routes of whole shipment tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from harborline import schema
from harborline.functions.exact import exact_mean, exact_sum, rounded, share
from harborline.functions.scalars import is_late, location_match
from harborline.operators.browse import since
from harborline.session import spool

CONGESTED, CLEAR, UNKNOWN_CONGESTION = 0.8, 0.2, 0.3
USUAL_WEATHER = 0.2
UNSERVED_PENALTY = 1.6
HOURS_SCALE, COST_SCALE = 500, 3000
# Path weights are whole billionths: their sums are exact in any order.
WEIGHT_UNIT = 1_000_000_000
CONFIG = ["profile", "transport_mode"]
PAIR = ["origin", "destination", *CONFIG]


def congestion(events: DataFrame, ports: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Share of holding events at each port in the last days, on the scale 0.2 to 0.8.

    Events are counted per location before the text match with the few ports.
    """
    held = F.coalesce(F.col("event_type").isin(schema.CONGESTED_EVENT_TYPES), F.lit(False))
    seen = (
        since(events, "event_timestamp", as_of, days)
        .groupBy("location_name")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(held).alias("held"))
    )
    matched = (
        seen.join(ports.select("node"), location_match(F.col("location_name"), F.col("node")))
        .groupBy("node")
        .agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    )
    value = (F.lit(CONGESTED) * F.col("held") + F.lit(CLEAR) * (F.col("n") - F.col("held"))) / F.col("n")
    return ports.join(matched, "node", "left").select(
        "node", "capacity", F.coalesce(value, F.lit(UNKNOWN_CONGESTION)).alias("congestion")
    )


def edge_weights(
    lanes: DataFrame,
    congested: DataFrame,
    profiles: Sequence[tuple[str, float, float, float]] = tuple(schema.ROUTE_PROFILES),
    modes: Sequence[str] = tuple(schema.TRANSPORT_MODES),
    weather: float = USUAL_WEATHER,
) -> DataFrame:
    """Directed lanes with time, cost, risk and weight, per profile and mode."""
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    choices = F.array(
        *(
            F.struct(*(F.lit(v).alias(n) for n, v in zip(("profile", "w_time", "w_cost", "w_risk"), p)))
            for p in profiles
        )
    )
    c, w = F.col("congestion"), F.lit(float(weather))
    directed = (
        lanes.withColumn("way", F.explode(both))
        .select("way.*", "modes", "base_cost", "base_time")
        .join(congested.withColumnRenamed("node", "dst"), "dst")
        .withColumn("choice", F.explode(choices))
        .withColumn("transport_mode", F.explode(F.array(*(F.lit(m) for m in modes))))
        .select(
            "src",
            "dst",
            "transport_mode",
            "choice.*",
            (F.col("base_time") * (1 + F.lit(0.5) * c + F.lit(0.25) * w)).alias("time_h"),
            (F.col("base_cost") * (1 + F.lit(0.4) * c)).alias("cost"),
            (F.lit(0.45) * c + F.lit(0.30) * w + F.lit(0.25) * (1 - F.col("capacity"))).alias("risk"),
            F.when(F.array_contains("modes", F.col("transport_mode")), F.lit(1.0))
            .otherwise(F.lit(UNSERVED_PENALTY)).alias("penalty"),
        )
    )
    weight = (
        F.col("w_time") * F.col("time_h") / HOURS_SCALE
        + F.col("w_cost") * F.col("cost") / COST_SCALE
        + F.col("w_risk") * F.col("risk")
    ) * F.col("penalty")
    best = F.struct(F.round(weight * WEIGHT_UNIT, 0).cast("bigint").alias("weight"), "time_h", "cost", "risk")
    return directed.groupBy("src", "dst", *CONFIG).agg(F.min(best).alias("best")).select(
        "src", "dst", *CONFIG, "best.*"
    )


def network_view(lanes: DataFrame, congested: DataFrame) -> DataFrame:
    """Lanes as drawn: distance, modes, congestion of the far end, risk and band."""
    risk = rounded(F.col("congestion") * F.lit(0.7), 2)
    return lanes.join(congested.withColumnRenamed("node", "dst"), "dst").select(
        F.col("src").alias("source"),
        F.col("dst").alias("target"),
        F.col("distance_km").alias("distance"),
        F.array_join("modes", ",").alias("modes"),
        rounded(F.col("congestion"), 2).alias("congestion"),
        risk.alias("risk"),
        F.when(risk < 0.3, "low").when(risk < 0.6, "medium").otherwise("high").alias("band"),
    )


def network_nodes(ports: DataFrame, lanes: DataFrame) -> DataFrame:
    """Ports as drawn next to the lanes, with how many lanes leave and enter each."""
    out = lanes.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("lanes_out"))
    into = lanes.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("lanes_in"))
    zero = F.lit(0).cast("bigint")
    return ports.join(out, "node", "left").join(into, "node", "left").select(
        "node", "lat", "lon", "node_type", "capacity",
        F.coalesce("lanes_out", zero).alias("lanes_out"),
        F.coalesce("lanes_in", zero).alias("lanes_in"),
    )


def cheapest_paths(edges: DataFrame) -> DataFrame:
    """Exact cheapest path of every pair, profile and mode; ties go to the lesser path.

    Each pass extends only the paths that improved in the pass before, by one or
    two lanes. The table of best paths is written after every pass, so the lineage
    stays short, and the join sees its true size.
    """
    steps = _steps(spool(edges, "edges"))
    ends = steps.select(F.explode(F.array("src", "dst")).alias("origin"), *CONFIG).distinct()
    best = ends.select(
        *CONFIG,
        "origin",
        F.col("origin").alias("destination"),
        F.lit(0).cast("bigint").alias("weight"),
        F.array("origin").alias("path"),
        F.lit(0).alias("improved"),
    )
    done, changed = 0, True
    while changed:
        done += 1
        longer = (
            best.where(F.col("improved") == done - 1)
            .withColumnRenamed("destination", "src")
            .join(steps, ["src", *CONFIG])
            .where(~F.arrays_overlap("path", "hops"))
            .select(
                *CONFIG,
                "origin",
                F.col("dst").alias("destination"),
                (F.col("weight") + F.col("step")).alias("weight"),
                F.concat("path", "hops").alias("path"),
                F.lit(done).alias("improved"),
            )
        )
        least = F.min(F.struct("weight", "path", "improved")).alias("least")
        merged = best.unionByName(longer).groupBy(*PAIR).agg(least).select(*PAIR, "least.*")
        best = spool(merged, "paths")
        changed = not best.where(F.col("improved") == done).isEmpty()
    return best.drop("improved")


def _steps(edges: DataFrame) -> DataFrame:
    """The cheapest ways of one or two lanes: two lanes at a time halve the passes."""
    one = edges.select("src", "dst", *CONFIG, F.col("weight").alias("step"), F.array("dst").alias("hops"))
    second = one.select(
        F.col("src").alias("via"), F.col("dst").alias("end"), *CONFIG, F.col("step").alias("more"),
        F.col("hops").alias("rest"),
    )
    two = (
        one.withColumnRenamed("dst", "via")
        .join(second, ["via", *CONFIG])
        .where(F.col("end") != F.col("src"))
        .select(
            "src",
            F.col("end").alias("dst"),
            *CONFIG,
            (F.col("step") + F.col("more")).alias("step"),
            F.concat("hops", "rest").alias("hops"),
        )
    )
    least = F.min(F.struct("step", "hops")).alias("least")
    return spool(
        one.unionByName(two).groupBy("src", "dst", *CONFIG).agg(least).select("src", "dst", *CONFIG, "least.*"),
        "steps",
    )


def route_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """The lanes along each path, in order."""
    hops = F.size("path") - 1
    pairs = F.arrays_zip(
        F.slice("path", F.lit(1), hops).alias("src"), F.slice("path", F.lit(2), hops).alias("dst")
    )
    return (
        paths.where(hops > 0)
        .select(*PAIR, F.size("path").alias("nodes"), F.posexplode(pairs).alias("leg", "lane"))
        .select(*PAIR, "nodes", "leg", "lane.src", "lane.dst")
        .join(edges.drop("weight"), ["src", "dst", *CONFIG])
    )


def route_stops(paths: DataFrame, ports: DataFrame) -> DataFrame:
    """The ports along each path, in order, with their coordinates."""
    return (
        paths.select(*PAIR, F.posexplode("path").alias("stop", "node"))
        .join(ports.select("node", "lat", "lon", "node_type", "capacity"), "node")
    )


def route_details(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Total time, cost and risk of each path; risk is spread over its nodes."""
    totals = route_edges(paths, edges).groupBy(*PAIR).agg(
        exact_sum(F.col("time_h")).alias("time_h"),
        exact_sum(F.col("cost")).alias("cost"),
        (exact_sum(F.col("risk")) / F.max("nodes")).alias("risk"),
    )

    def total(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    return paths.join(totals, PAIR, "left").select(
        *PAIR,
        F.array_join("path", ">").alias("path"),
        rounded(total("time_h"), 1).alias("total_time_hours"),
        rounded(total("cost"), 0).alias("total_cost_usd"),
        rounded(total("risk"), 3).alias("total_risk_score"),
        total("risk").alias("route_risk"),
    )


def risk_action(risk: Column) -> dict[str, Column]:
    """Action, its confidence and a message for a route risk."""
    shown = F.format_string("%.2f", rounded(risk, 2))

    def pick(maintain, minor, major, emergency) -> Column:
        return F.when(risk < 0.30, maintain).when(risk < 0.55, minor).when(risk < 0.75, major).otherwise(emergency)

    # Texts and confidences.
    return {
        "action": pick("maintain_route", "minor_adjustment", "major_reroute", "emergency_reroute"),
        "confidence": pick(0.95, 0.85, 0.78, 0.70),
        "explanation": pick(
            F.concat(F.lit("Risk "), shown, F.lit(" acceptable.")),
            F.concat(F.lit("Risk "), shown, F.lit(": minor timing adjustment recommended.")),
            F.concat(F.lit("Risk "), shown, F.lit(": reroute via alternative corridor.")),
            F.concat(F.lit("Risk "), shown, F.lit(" critical: immediate reroute required.")),
        ),
    }


def _on_network(shipments: DataFrame, ports: DataFrame) -> DataFrame:
    """Shipments with the pair to route: unknown ports take the fallbacks."""
    origins = ports.select(F.col("node").alias("origin_port"), F.col("node").alias("known_origin"))
    destinations = ports.select(F.col("node").alias("destination_port"), F.col("node").alias("known_destination"))
    return (
        shipments.join(origins, "origin_port", "left")
        .join(destinations, "destination_port", "left")
        .withColumns(
            {
                "origin": F.coalesce("known_origin", F.lit(schema.FALLBACK_ORIGIN)),
                "destination": F.coalesce("known_destination", F.lit(schema.FALLBACK_DESTINATION)),
                "transport_mode": F.coalesce("transport_mode", F.lit("sea")),
            }
        )
        .drop("known_origin", "known_destination")
    )


def route_shipments(shipments: DataFrame, ports: DataFrame, details: DataFrame, profile: str = "balanced") -> DataFrame:
    """The cheapest route of every shipment, with the action for its risk.

    The route table is written first: while it is small it is broadcast, beyond
    that the sort-merge join splits hot lanes.
    """
    routes = spool(details.where(F.col("profile") == profile).drop("profile"), "routes")
    return (
        _on_network(shipments, ports)
        .select("shipment_id", "origin", "destination", "transport_mode")
        .join(routes, ["origin", "destination", "transport_mode"], "left")
        .withColumns(risk_action(F.col("route_risk")))
        .drop("route_risk")
    )


def route_alternatives(shipments: DataFrame, ports: DataFrame, details: DataFrame) -> DataFrame:
    """Fastest, cheapest and safest profile for every shipment's own pair.

    The choice is made once per pair and mode, then joined to the shipments.
    """
    pair = ["origin", "destination", "transport_mode"]

    def choice(measure: str, label: str) -> list[Column]:
        best = F.struct(F.col(measure), F.col("profile"))
        return [
            F.min_by("path", best).alias(f"{label}_path"),
            F.min_by("profile", best).alias(f"{label}_profile"),
        ]

    chosen = spool(
        details.groupBy(*pair).agg(
            *choice("total_time_hours", "fastest"),
            *choice("total_cost_usd", "cheapest"),
            *choice("total_risk_score", "safest"),
        ),
        "alternatives",
    )
    return (
        _on_network(shipments, ports).select("shipment_id", *pair).join(chosen, pair, "left")
    )


def lane_report(shipments: DataFrame, details: DataFrame, profile: str = "balanced") -> DataFrame:
    """Load of each lane beside the planned totals of its route."""
    pair = ["origin", "destination", "transport_mode"]
    load = shipments.groupBy(
        F.col("origin_port").alias("origin"), F.col("destination_port").alias("destination"), "transport_mode"
    ).agg(
        F.count(F.lit(1)).alias("shipments"),
        rounded(share(is_late(F.col("status"))), 4).alias("delay_rate"),
        rounded(exact_mean(F.col("risk_score")), 4).alias("avg_risk"),
        rounded(exact_mean(F.col("freight_cost_usd")), 2).alias("avg_freight_usd"),
    )
    planned = details.where(F.col("profile") == profile).select(
        *pair, "total_time_hours", "total_cost_usd", "total_risk_score"
    )
    return load.join(planned, pair, "left")
