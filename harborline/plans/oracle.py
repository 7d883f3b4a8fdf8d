"""The same queries as SQL text, written from their definitions, for a second engine."""

from __future__ import annotations

from harborline import schema


def _values(rows: list[tuple]) -> str:
    def text(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, str):
            return "'" + v + "'"
        return f"{v}e0" if isinstance(v, float) else str(v)

    return ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)


def fx(x: str) -> str:
    return f"cast({x} as decimal(18,6))"


def total(x: str) -> str:
    return f"cast(sum({fx(x)}) as double)"


def mean(x: str) -> str:
    return f"({total(x)} / nullif(count({x}), 0))"


def decimal_rounds(sql: str) -> str:
    """Let every two-argument round go through decimals, free of binary noise at ties."""
    at = sql.find("round(")
    if at < 0:
        return sql
    depth, comma, end = 0, None, at + 5
    for end in range(at + 5, len(sql)):
        depth += {"(": 1, ")": -1}.get(sql[end], 0)
        if depth == 0:
            break
        if depth == 1 and sql[end] == ",":
            comma = end
    head, tail = sql[:at], decimal_rounds(sql[end + 1 :])
    if comma is None:
        return f"{head}round({decimal_rounds(sql[at + 6 : end])}){tail}"
    value, digits = decimal_rounds(sql[at + 6 : comma]), sql[comma + 1 : end].strip()
    return f"{head}cast(round(cast({value} as decimal(28,10)), {digits}) as double){tail}"


LATE = "coalesce(status in ('Delayed','Critical_Delay'), false)"


def share(cond: str) -> str:
    return f"(cast(count(*) filter (where {cond}) as double) / count(*))"


def level(x: str) -> str:
    return f"case when {x} < 0.3e0 then 'low' when {x} < 0.55e0 then 'medium' when {x} < 0.75e0 then 'high' when {x} is not null then 'critical' end"


def advice(x: str) -> str:
    first, second, third = (a for _, a in schema.ADVICE_BANDS)
    return (
        f"case when {x} < 0.3e0 then '{first}' when {x} < 0.55e0 then '{second}' when {x} < 0.75e0 then '{third}' "
        f"when {x} is not null then '{schema.TOP_ADVICE}' end"
    )


def _numbered(prefix: str, number: str) -> str:
    digits = f"cast({number} as varchar)"
    return f"concat('{prefix}', lpad({digits}, cast(greatest(9, length({digits})) as int), '0'))"


VIEWS: dict[str, tuple[list[str], str]] = {
    "ports": (
        [],
        "select * from (values "
        + _values([(i, *p) for i, p in enumerate(schema.PORTS)])
        + ") as t(idx,node,lat,lon,node_type,capacity)",
    ),
    "lanes": (
        [],
        f"select * from (values {_values(schema.LANES)}) as t(src,dst,distance_km,modes,base_cost,base_time)",
    ),
    "shipments": (
        ["ports"],
        f"""select * exclude (o_orderstatus), case when o_orderstatus = 'F' then 'Delivered'
  when delay_hours >= 48 then 'Critical_Delay' when delay_hours > 0 then 'Delayed'
  when o_orderstatus = 'P' then 'In_Transit' else 'On_Schedule' end status
from (
  select {_numbered('SHP-', 'o_orderkey')} shipment_id,
    c_mktsegment carrier, po.node origin_port, pd.node destination_port,
    case substr(o_orderpriority,1,1) when '1' then 'air' when '2' then 'road'
         when '3' then 'rail' else 'sea' end transport_mode,
    o_orderstatus, cat goods_category, 'USD' currency,
    cast(o_orderdate as date) created_date,
    cast(500 + (o_custkey*37 + o_orderkey*101) % 12000 as double) distance_km,
    cast(q*10 as double) weight_kg, o_totalprice value_usd, cast(fr as double) freight_cost_usd,
    n num_containers, ns num_stops,
    case when mq is null then null else greatest(mq-15, 0)*3 end delay_hours,
    md*10 weather_severity, mt*12.5e0 port_congestion, (md*10 + mt*12.5e0)/2 risk_score,
    cast(substr(o_orderpriority,1,1) as int) priority_level,
    o_totalprice > 250000 insurance_required
  from orders join customer on o_custkey = c_custkey
  join ports pd on pd.idx = c_custkey % 15
  left join (
    select l_orderkey, count(*) n, count(distinct l_suppkey) ns,
           sum(cast(l_quantity as decimal(18,2))) q, min(l_quantity) mq,
           max(l_discount) md, max(l_tax) mt, min(l_suppkey) sk,
           sum(cast(l_extendedprice*l_tax as decimal(18,4))) fr, min(p_type) cat
    from lineitem left join part on l_partkey = p_partkey group by l_orderkey) li on o_orderkey = l_orderkey
  left join ports po on po.idx = sk % 15)""",
    ),
    "route_events": (
        ["ports"],
        f"""select {_numbered('EVT-', 'event_id')} event_id,
  {_numbered('SHP-', '(event_id*7 + user_id) % (select count(*) from orders)')} shipment_id,
  case e.event_type when 'signup' then 'port_entry' when 'error' then 'congestion_hold'
       when 'click' then 'gps_ping' when 'view' then 'departure' else 'weather_hold' end event_type,
  ts event_timestamp, node location_name,
  case when event_id % 97 = 0 then null else lat + (k-50)/1000e0 end latitude,
  case when event_id % 97 = 0 then null else lon + (k-50)/1000e0 end longitude,
  k/5e0 speed_knots, k*3.6e0 heading_deg, k/2e0 - 10 temperature_c, cast(k as double) humidity_pct,
  k/20e0 shock_g, greatest(value/5 - 20, 0) delay_added_hours,
  case when event_id % 53 = 0 then null else value/1000 - 0.2e0 end risk_score_delta,
  value/20 port_wait_hours, value/2 fuel_consumed_lt, value*1.3e0 co2_kg,
  case k % 3 when 0 then 'gps' when 1 then 'iot' else 'ais' end sensor_type,
  case when k < 20 then 'poor' when k < 60 then 'fair' else 'good' end signal_quality,
  e.event_type = 'error' and k >= 70 anomaly_flag,
  e.event_type = 'error' and k >= 85 alert_sent
from (select *, cast(json_extract_string(props,'$.k') as int) k from events) e join ports on idx = user_id % 15""",
    ),
    "congestion": (
        ["route_events", "ports"],
        """select node, capacity, coalesce((0.8e0*held + 0.2e0*(n-held))/n, 0.3e0) congestion
from ports left join (
  select p.node, count(*) n,
    count(*) filter (where event_type in ('congestion_hold','port_entry','weather_hold')) held
  from route_events r join ports p on lower(r.location_name) like '%' || lower(split_part(p.node,'_',1)) || '%'
  where event_timestamp >= timestamp '2024-01-24 00:00:00' group by p.node) using (node)""",
    ),
    "profiles": (
        [],
        f"select * from (values {_values(schema.ROUTE_PROFILES)}) as t(profile,w_time,w_cost,w_risk)",
    ),
    "edges": (
        ["lanes", "congestion", "profiles"],
        """select src, dst, profile, transport_mode, time_h, cost, risk,
  cast(round((w_time*time_h/500 + w_cost*cost/3000 + w_risk*risk)
       * case when list_contains(string_split(modes, ','), transport_mode) then 1e0 else 1.6e0 end * 1000000000) as bigint) weight
from (
  select d.src, d.dst, d.modes,
    base_time*(1 + 0.5e0*congestion + 0.25e0*0.2e0) time_h, base_cost*(1 + 0.4e0*congestion) as cost,
    0.45e0*congestion + 0.30e0*0.2e0 + 0.25e0*(1-capacity) risk
  from (select src, dst, modes, base_cost, base_time from lanes
        union all select dst, src, modes, base_cost, base_time from lanes) d
  join congestion c on c.node = d.dst), profiles,
  (values ('sea'),('air'),('rail'),('road')) m(transport_mode)""",
    ),
    "walks": (
        ["edges"],
        """select distinct src origin, src destination, profile, transport_mode, cast(0 as bigint) weight, [src] path from edges
union all
select w.origin, e.dst, w.profile, w.transport_mode, w.weight + e.weight, list_append(w.path, e.dst)
from walks w join edges e on e.src = w.destination and e.profile = w.profile and e.transport_mode = w.transport_mode
where not list_contains(w.path, e.dst)""",
    ),
    "paths": (
        ["walks"],
        """select origin, destination, profile, transport_mode, weight, path from (
  select *, row_number() over (partition by origin, destination, profile, transport_mode order by weight, path) pick
  from walks) where pick = 1""",
    ),
    "legs": (
        ["paths", "edges"],
        """select p.origin, p.destination, p.profile, p.transport_mode, len(p.path) nodes, leg - 1 leg,
  e.src, e.dst, time_h, cost, risk
from (select *, unnest(generate_series(1, len(path)-1)) leg from paths where len(path) > 1) p
join edges e on e.src = path[leg] and e.dst = path[leg+1] and e.profile = p.profile and e.transport_mode = p.transport_mode""",
    ),
    "details": (
        ["paths", "legs"],
        f"""select p.origin, p.destination, p.profile, p.transport_mode, array_to_string(path, '>') path,
  round(coalesce(t, 0), 1) total_time_hours, round(coalesce(c, 0), 0) total_cost_usd,
  round(coalesce(r, 0), 3) total_risk_score, coalesce(r, 0) route_risk
from paths p left join (
  select origin, destination, profile, transport_mode, {total('time_h')} t, {total('cost')} c,
    {total('risk')} / max(nodes) r
  from legs group by all) using (origin, destination, profile, transport_mode)""",
    ),
    "routed": (
        ["shipments", "ports"],
        """select s.* exclude (transport_mode), coalesce(o.node, 'Shanghai') origin,
  coalesce(d.node, 'Rotterdam') destination, coalesce(transport_mode, 'sea') transport_mode
from shipments s left join ports o on o.node = origin_port left join ports d on d.node = destination_port""",
    ),
    "seen": (
        ["route_events"],
        f"""select shipment_id, {mean('risk_score_delta')} delta, {mean('shock_g')} shock, {mean('port_wait_hours')} wait
from route_events group by shipment_id""",
    ),
    "features": (
        ["shipments", "seen"],
        """select shipment_id, coalesce(weather_severity, 0) f_weather,
  coalesce(port_congestion, 0) + abs(coalesce(delta, 0)) f_congestion, least(1, coalesce(shock, 0)/5) f_shock,
  coalesce(nullif(risk_score, 0), 0.3e0) f_risk, greatest(0, 1 - coalesce(delay_hours, 0)/72) f_reliability,
  least(1, coalesce(wait, 0)/24) f_wait, least(1, coalesce(delay_hours, 0)/48) f_delay,
  coalesce(nullif(distance_km, 0), 5000) f_distance, coalesce(nullif(cast(num_stops as double), 0), 2) f_stops,
  coalesce(nullif(cast(priority_level as double), 0), 2) f_priority
from shipments left join seen using (shipment_id)""",
    ),
    "marked": (
        ["route_events"],
        """select shipment_id, event_id, event_timestamp, location_name,
  coalesce(anomaly_flag, false) or coalesce(risk_score_delta, 0) >= 0.12e0 or coalesce(delay_added_hours, 0) >= 6
    or coalesce(port_wait_hours, 0) >= 12 severe,
  coalesce(delay_added_hours, 0) <= 0 and not coalesce(anomaly_flag, false) on_time,
  coalesce(anomaly_flag, false) or coalesce(risk_score_delta, 0) >= 0.18e0 critical,
  row_number() over (order by event_timestamp, event_id) - 1 i, count(*) over () n
from route_events""",
    ),
    "live": (
        ["marked"],
        """select tick, count(*) records, count(distinct shipment_id) active_shipments,
  count(distinct case when severe then shipment_id end) at_risk_shipments,
  round(count(*) filter (where on_time) / count(*), 4) on_time_rate,
  count(*) filter (where critical) critical_alerts,
  greatest(tick, count(distinct case when severe then shipment_id end)) routes_optimized
from marked join (select unnest(generate_series(1, (count(*) + 4) // 5)) tick from marked)
  on i < least(tick*5, n) and i >= least(tick*5, n) - 250
group by tick""",
    ),
    "series": (
        ["shipments"],
        f"""select created_date, {mean('delay_hours')} avg_delay, count(*) shipment_count, {share(LATE)} delay_rate,
  {mean('risk_score')} avg_risk
from shipments where created_date >= date '2001-08-01' - 30 group by created_date""",
    ),
    "projection": (
        ["series"],
        """select d date, cast(round(coalesce(nullif(shipment_count, 0), base)) as bigint) demand_units,
  nullif(shipment_count, 0) is not null observed
from (select date '2001-07-15' + cast(i as int) d,
        1000e0 * (1 + 0.3e0*sin(2*pi()*(isodow(date '2001-07-15' + cast(i as int)) - 1)/7)) * (1 + 0.002e0*i) base
      from range(30) t(i)) left join series on created_date = d""",
    ),
    "hourly_delay": (
        ["route_events"],
        """select location_name, date_trunc('hour', event_timestamp) as hour,
  round(count(*) filter (where coalesce(delay_added_hours, 0) > 0) / count(*), 6) as value
from route_events group by all""",
    ),
    "hourly_on_time": (
        ["marked"],
        """select location_name, date_trunc('hour', event_timestamp) as hour, count(*) as rows,
  round(count(*) filter (where on_time) / count(*), 6) as value
from marked group by all""",
    ),
    "hourly_throughput": (
        ["route_events"],
        """select location_name, date_trunc('hour', event_timestamp) as hour, count(*) as rows, cast(count(*) as double) as value
from route_events group by all""",
    ),
    "daily_cost": (
        ["shipments"],
        f"""select transport_mode, cast(created_date as timestamp) as hour, rows,
  round((cast(f as double) / cast(k as double)) / (cast(sum(f) over m as double) / cast(sum(k) over m as double)), 6) as value
from (select transport_mode, created_date, count(*) as rows, sum({fx('freight_cost_usd')}) f,
        sum(case when freight_cost_usd is not null then {fx('distance_km')} end) k from shipments group by all)
window m as (partition by transport_mode)""",
    ),
    "piece": (
        ["marked"],
        """select *, case when event_timestamp < timestamp '2024-01-07' then 1 when event_timestamp < timestamp '2024-01-13' then 2
  when event_timestamp < timestamp '2024-01-19' then 3 when event_timestamp < timestamp '2024-01-25' then 4 else 5 end part
from marked""",
    ),
}


KPI_FIGURES = """active total_active_shipments, at_risk at_risk_shipments, critical critical_alerts,
  round(on_schedule / greatest(1, active), 3) on_time_rate, round(coalesce(avg_delay, 0), 1) avg_delay_hours,
  round(coalesce(total_freight, 0), 0) total_freight_usd, round(coalesce(avg_risk, 0), 3) avg_risk_score,
  cast(round(total*12.5e0, 0) as double) cost_savings_today_usd, greatest(1, total // 150) routes_optimized_today,
  greatest(1, at_risk // 8) disruptions_prevented, 'spark' data_source"""


def _ridge(source: str, horizon: int = 24, by: str = "location_name") -> str:
    """Quadratic ridge per group over an hourly view, alpha 1, as one SELECT; moments as whole numbers."""

    def d(whole: str) -> str:
        return f"cast({whole} as double)"

    return f"""select {by}, step, last_hour + to_hours(cast(step as int)) as hour,
  round(w0 + w1*a + w2*a*a, 4) forecast
from (select *, cast(last_t + step as double) a from (
  select *, my - w1*m1 - w2*m2 w0, unnest(generate_series(1, {horizon})) step from (
   select *, (b1*a22 - b2*a12)/(a11*a22 - a12*a12) w1, (a11*b2 - a12*b1)/(a11*a22 - a12*a12) w2 from (
    select {by}, last_hour, last_t, {d('n*s2 - s1*s1')}/{d('n')} + 1e0 a11, {d('n*s3 - s1*s2')}/{d('n')} a12,
      {d('n*s4 - s2*s2')}/{d('n')} + 1e0 a22, {d('n*ty - s1*y')}/{d('n')}/1e6 b1, {d('n*tty - s2*y')}/{d('n')}/1e6 b2,
      {d('s1')}/{d('n')} m1, {d('s2')}/{d('n')} m2, {d('y')}/{d('n')}/1e6 my from (
     select {by}, cast(count(*) as hugeint) n, sum(t) s1, sum(t*t) s2, sum(t*t*t) s3, sum(t*t*t*t) s4, sum(y) y,
       sum(t*y) ty, sum(t*t*y) tty, max(hour) last_hour, max(t) last_t
     from (select {by}, hour, cast({fx('value')} * 1000000 as hugeint) y,
             cast((epoch(hour) - epoch(min(hour) over (partition by {by})))/3600 as hugeint) t
           from {source}) where y is not null
     group by {by})))))"""


def _bands(source: str, by: str, lo: str, hi: str) -> str:
    return f"""select {by}, cast(step as int) step, hour, round(v, 4) as value, round(least(v + band, {hi}), 4) upper_bound,
  round(greatest(v - band, {lo}), 4) lower_bound,
  case when max_by(forecast, step) over g > min_by(forecast, step) over g then 'increasing' else 'decreasing' end trend,
  round(cast(sum({fx('v')}) over g as double) / count(*) over g, 4) mean
from (select *, least(greatest(forecast, {lo}), {hi}) v,
        ({hi} - {lo})*(0.03e0 + 0.07e0*((step - 1)/23)) band from ({_ridge(source, by=by)}))
window g as (partition by {by})"""


def _sql(body: str, *names: str) -> str:
    """The body behind the views it needs, in order of dependence."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    if not order:
        return body
    recursive = "recursive " if "walks" in order else ""
    return f"with {recursive}" + ",\n".join(f"{n} as ({VIEWS[n][1]})" for n in order) + "\n" + body


def _heatmap(limit: str) -> str:
    return f"""select round(lat, 4) lat, round(lon, 4) lon, round(v, 3) intensity, location_name region, event_count,
  anomaly_count, {level('v')} as type
from (select *, least(greatest(coalesce(nullif(raw, 0), 0.3e0), 0), 1) v from (
  select location_name, {mean('latitude')} lat, {mean('longitude')} lon,
    {mean('(coalesce(risk_score_delta, 0) + 0.35e0)')} raw, count(*) event_count,
    count(*) filter (where anomaly_flag) anomaly_count
  from (select * from route_events where latitude is not null and longitude is not null {limit})
  where latitude between -90 and 90 and longitude between -180 and 180
  group by location_name having count(*) >= 5 order by raw desc nulls first, location_name limit 200))"""


def _bottlenecks(limit: str) -> str:
    return f"""select concat('BN-', lpad(cast(cast(concat('0x', substr(md5(location_name), 1, 8)) as bigint) % 9999 as varchar), 4, '0')) id,
  location_name as location, round(coalesce(lat, 0), 4) lat, round(coalesce(lon, 0), 4) lon, {level('sev')} severity,
  round(sev, 3) severity_score, round(delay, 1) avg_delay_hours, round(wait, 1) avg_port_wait_hours, event_count,
  anomaly_count, round(delay*1.5e0, 1) estimated_clearance_hours, last_seen, {advice('sev')} recommendation,
  case when delay > 12 then 'port_congestion' else 'transit_delay' end as type
from (select *, least(1, delay/48) sev from (
  select location_name, {mean('latitude')} lat, {mean('longitude')} lon, {mean('delay_added_hours')} delay,
    {mean('coalesce(port_wait_hours, 0)')} wait, count(*) event_count,
    count(*) filter (where anomaly_flag) anomaly_count, max(event_timestamp) last_seen
  from (select * from route_events {limit}) where delay_added_hours > 0
  group by location_name having count(*) >= 3 order by delay desc nulls first, location_name limit 15))"""


NEWEST_EVENTS = "order by event_timestamp desc nulls first, event_id desc nulls first limit 3000"
NEWEST_SHIPMENTS = "(select * from shipments order by shipment_id desc nulls first limit 10000)"
KPI_ROW = f"""select count(*) total, count(*) filter (where status <> 'Delivered') active,
  count(*) filter (where risk_score > 0.55e0) at_risk, count(*) filter (where status = 'Critical_Delay') critical,
  count(*) filter (where status = 'On_Schedule') on_schedule,
  {mean('case when delay_hours > 0 then delay_hours end')} avg_delay, {total('freight_cost_usd')} total_freight,
  {mean('coalesce(risk_score, 0)')} avg_risk
from shipments"""


def _carriers(source: str) -> str:
    return f"""select carrier, round(raw, 3) performance from (
  select carrier, 1 - {share(LATE)} raw from {source} group by carrier order by raw desc, carrier limit 8)"""


def _modes(source: str) -> str:
    return f"""select transport_mode, round(count(*) / sum(count(*)) over (), 3) share from {source} group by transport_mode"""


FEATURE_LIST = (
    "f_weather, f_congestion, f_shock, f_risk, f_reliability, f_wait, f_delay, f_distance, f_stops, f_priority"
)
RULE = "round(0.25e0*f_weather + 0.20e0*f_congestion + 0.10e0*f_shock + 0.15e0*f_risk + 0.15e0*(1 - f_reliability) + 0.10e0*f_wait + 0.05e0*f_delay, 6)"
DOUBLES = ", ".join(f"cast({c} as double) {c}" for c in FEATURE_LIST.split(", "))
ETA = """select *, km/slow travel, stops*5e0 stopped, km/slow + stops*5e0 total from (
  select *, speed*(1 - 0.3e0*c)*(1 - 0.2e0*w) slow from (
    select shipment_id, carrier, coalesce(transport_mode, 'sea') transport_mode, coalesce(distance_km, 5000) km,
      coalesce(port_congestion, 0.3e0) c, coalesce(weather_severity, 0.2e0) w, coalesce(num_stops, 2) stops,
      case coalesce(transport_mode, 'sea') when 'sea' then 40e0 when 'air' then 800e0 when 'rail' then 120e0
        when 'road' then 80e0 else 60e0 end speed
    from shipments))"""
ON_TIME = f"""select carrier, transport_mode, shipments,
  round(case when shipments >= 30 then ok/shipments else sum(ok) over m / sum(shipments) over m end, 2) on_time_probability
from (select carrier, coalesce(transport_mode, 'sea') transport_mode, count(*) shipments,
        count(*) filter (where not {LATE}) ok from shipments group by all)
window m as (partition by transport_mode)"""
SHIPMENT_DOUBLES = """shipment_id, carrier, origin_port, destination_port, transport_mode, goods_category, currency,
  created_date, distance_km, weight_kg, value_usd, freight_cost_usd,
  cast(num_containers as double) num_containers, cast(num_stops as double) num_stops, delay_hours, weather_severity, port_congestion, risk_score, cast(priority_level as bigint) priority_level, insurance_required, status"""
SHIPMENT_NUMBERS = [
    "distance_km", "weight_kg", "value_usd", "freight_cost_usd", "num_containers", "num_stops", "delay_hours",
    "weather_severity", "port_congestion", "risk_score", "priority_level",
]
SHIPMENT_TEXTS = ["shipment_id", "carrier", "origin_port", "destination_port", "transport_mode", "goods_category",
                  "currency", "created_date", "insurance_required", "status"]
TABLE_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
               "embeddings", "pages", "benchmark", "labels", "conversations"]


LINEITEM_SHAPE = [
    (0, "l_orderkey", "bigint"), (1, "l_partkey", "bigint"), (2, "l_suppkey", "bigint"), (3, "l_linenumber", "int"),
    (4, "l_quantity", "double"), (5, "l_extendedprice", "double"), (6, "l_discount", "double"), (7, "l_tax", "double"),
    (8, "l_returnflag", "string"), (9, "l_linestatus", "string"), (10, "l_shipdate", "timestamp_ntz"),
]


def _missing_counts() -> str:
    parts = [
        f"select '{c}' column_name, count(*) as rows, count(*) - count({c}) missing from shipments"
        for c in SHIPMENT_TEXTS + SHIPMENT_NUMBERS
    ]
    return " union all ".join(parts)


def _numeric_summary() -> str:
    return " union all ".join(
        f"""select '{c}' column_name, count({c}) count, round({mean(c)}, 3) mean, round(stddev_samp({c}), 3) std,
 round(min(cast({c} as double)), 3) min, round(quantile_cont(cast({c} as double), 0.25), 3) p25,
 round(quantile_cont(cast({c} as double), 0.5), 3) p50, round(quantile_cont(cast({c} as double), 0.75), 3) p75,
 round(max(cast({c} as double)), 3) max from shipments"""
        for c in SHIPMENT_NUMBERS
    )


def _action(x: str) -> str:
    risk = f"printf('%.2f', round({x}, 2))"
    return f"""case when {x} < 0.30e0 then 'maintain_route' when {x} < 0.55e0 then 'minor_adjustment'
    when {x} < 0.75e0 then 'major_reroute' when {x} is not null then 'emergency_reroute' end as action,
  case when {x} < 0.30e0 then 0.95e0 when {x} < 0.55e0 then 0.85e0 when {x} < 0.75e0 then 0.78e0 when {x} is not null then 0.70e0 end confidence,
  case when {x} < 0.30e0 then concat('Risk ', {risk}, ' acceptable.')
    when {x} < 0.55e0 then concat('Risk ', {risk}, ': minor timing adjustment recommended.')
    when {x} < 0.75e0 then concat('Risk ', {risk}, ': reroute via alternative corridor.')
    when {x} is not null then concat('Risk ', {risk}, ' critical: immediate reroute required.') end explanation"""


def oracle() -> dict[str, str]:
    words = ", ".join(f"'{w}'" for w in schema.INSIGHT_WORDS)
    true_words = ", ".join(f"'{w}'" for w in schema.TRUE_WORDS)
    pair = "origin, destination, profile, transport_mode"
    q = {
        "shipments_view": _sql(f"select {SHIPMENT_DOUBLES} from shipments", "shipments"),
        "route_events_view": _sql("select * from route_events", "route_events"),
        "recent_shipments": _sql(
            f"select {SHIPMENT_DOUBLES} from shipments order by created_date desc nulls first, shipments.shipment_id desc limit 50",
            "shipments",
        ),
        "search_shipments": _sql(
            f"""select {SHIPMENT_DOUBLES} from shipments
where contains(lower(concat_ws(chr(10), shipment_id, carrier, origin_port, destination_port, status)), 'rot')
order by created_date desc nulls first, shipments.shipment_id desc limit 50""",
            "shipments",
        ),
        "latest_shipments": _sql(
            f"select shipment_id, carrier, status, transport_mode from {NEWEST_SHIPMENTS}", "shipments"
        ),
        "latest_events": _sql(
            f"select event_id, event_timestamp, location_name, delay_added_hours from route_events {NEWEST_EVENTS}",
            "route_events",
        ),
        "event_page": _sql(
            """select event_id, event_timestamp, location_name from route_events
order by event_timestamp, event_id limit 500 offset 250""",
            "route_events",
        ),
        "located_events": _sql(
            """select event_id, latitude, longitude from route_events
where latitude >= -90 and latitude <= 90 and longitude >= -180 and longitude <= 180""",
            "route_events",
        ),
        "last_week_events": _sql(
            "select event_id, event_timestamp from route_events where event_timestamp >= timestamp '2024-01-31 00:00:00' - interval 7 days",
            "route_events",
        ),
        "last_month_shipments": _sql(
            "select shipment_id, created_date from shipments where created_date >= date '2001-08-01' - 30", "shipments"
        ),
        "event_log": _sql(
            """select event_id, event_timestamp, concat(event_id, ' @ ', replace(location_name, '_', ' '), ' Δrisk: ',
  case when coalesce(risk_score_delta, 0) >= 0 then '+' else '' end, printf('%.3f', round(coalesce(risk_score_delta, 0e0), 3)),
  case when anomaly_flag then ' ⚠' else '' end) line from route_events""",
            "route_events",
        ),
        "adhoc_select": _sql(
            "select carrier, count(*) shipments, count(distinct origin_port) origins from shipments group by carrier",
            "shipments",
        ),
        "risk_heatmap": _sql(_heatmap(""), "route_events"),
        "risk_heatmap_latest": _sql(_heatmap(NEWEST_EVENTS), "route_events"),
        "bottlenecks": _sql(_bottlenecks(""), "route_events"),
        "bottlenecks_latest": _sql(_bottlenecks(NEWEST_EVENTS), "route_events"),
        "fleet_kpis": _sql(KPI_ROW, "shipments"),
        "kpi_report": _sql(f"select {KPI_FIGURES} from ({KPI_ROW})", "shipments"),
        "kpi_answer": _sql(
            f"""select {KPI_FIGURES},
  (select '[' || string_agg('{{"name":"' || carrier || '","value":' || cast(performance as varchar) || '}}', ',' order by carrier) || ']'
   from ({_carriers("shipments")})) carrier_performance,
  (select '[' || string_agg('{{"name":"' || transport_mode || '","value":' || cast(share as varchar) || '}}', ',' order by transport_mode) || ']'
   from ({_modes("shipments")})) mode_split
from ({KPI_ROW})""",
            "shipments",
        ),
        "carrier_performance": _sql(_carriers("shipments"), "shipments"),
        "carrier_performance_latest": _sql(_carriers(NEWEST_SHIPMENTS), "shipments"),
        "mode_split": _sql(_modes("shipments"), "shipments"),
        "mode_split_latest": _sql(_modes(NEWEST_SHIPMENTS), "shipments"),
        "mode_split_pct": _sql(
            f"""select m.transport_mode, round(coalesce(share, 0) / cast(sum(cast(coalesce(share, 0) as decimal(18,3))) over () as double) * 100, 1) percent
from (values ('sea'),('air'),('rail'),('road')) m(transport_mode) left join ({_modes('shipments')}) using (transport_mode)""",
            "shipments",
        ),
        "delay_series": _sql("select * from series", "series"),
        "carrier_report": _sql(
            f"""select carrier, count(*) shipments, round({mean('delay_hours')}, 1) avg_delay, round({mean('risk_score')}, 3) avg_risk
from shipments group by carrier order by avg_delay desc nulls first, carrier limit 10""",
            "shipments",
        ),
        "risk_levels": _sql(
            f"select shipment_id, {level('risk_score')} as level, {advice('risk_score')} advice from shipments", "shipments"
        ),
        "location_ids": _sql(
            """select distinct location_name, concat('BN-', lpad(cast(cast(concat('0x', substr(md5(location_name), 1, 8)) as bigint) % 9999 as varchar), 4, '0')) id
from route_events""",
            "route_events",
        ),
        "scaled_delay": _sql(
            """select event_id, round(least(greatest(delay_added_hours/48, 0), 1), 6) clamped,
  round(0.05e0 + (delay_added_hours - min(delay_added_hours) over s)
    / (max(delay_added_hours) over s - min(delay_added_hours) over s + 1e-9) * (0.65e0 - 0.05e0), 6) scaled
from route_events window s as (partition by location_name)""",
            "route_events",
        ),
        "port_distances": _sql(
            """select event_id, round(2*6371e0*asin(sqrt(power(sin(radians(lat - latitude)/2), 2)
  + cos(radians(latitude))*cos(radians(lat))*power(sin(radians(lon - longitude)/2), 2))), 6) km
from route_events join ports on node = location_name where latitude is not null and longitude is not null""",
            "route_events",
        ),
        "port_matches": _sql(
            """select location_name, node, count(*) events from route_events
join ports on location_name ilike '%' || split_part(node, '_', 1) || '%' group by all""",
            "route_events",
        ),
        "defaulted_inputs": _sql(
            """select shipment_id, coalesce(nullif(risk_score, 0), 0.3e0) risk_score,
  coalesce(nullif(distance_km, 0), 5000e0) distance_km, coalesce(nullif(cast(num_stops as double), 0), 2e0) num_stops,
  coalesce(nullif(cast(priority_level as double), 0), 2e0) priority_level from shipments""",
            "shipments",
        ),
        "parsed_text": f"""select doc_id, count(try_cast(w as double)) numbers,
  cast(sum(coalesce(try_cast(w as decimal(18,2)), 0)) as double) total,
  count(*) filter (where lower(w) in ({true_words})) flags
from (select doc_id, unnest(regexp_split_to_array(text, '\\s+')) w from documents) group by doc_id""",
        "disruption_features": _sql(
            f"""select shipment_id, {DOUBLES} from (select shipment_id, f_weather, coalesce(port_congestion, 0) f_congestion, 0 f_shock, f_risk,
  f_reliability, 0 f_wait, f_delay, f_distance, f_stops, f_priority from features join shipments using (shipment_id))""",
            "features",
        ),
        "event_disruption_features": _sql(
            """select event_id, 0e0 f_weather, abs(coalesce(risk_score_delta, 0e0)) f_congestion, least(1, shock_g/5) f_shock,
  0.3e0 f_risk, 1e0 f_reliability, least(1, port_wait_hours/24) f_wait, 0e0 f_delay, 5000e0 f_distance, 2e0 f_stops,
  2e0 f_priority from route_events""",
            "route_events",
        ),
        "shipment_event_features": _sql(f"select shipment_id, {DOUBLES} from features", "features"),
        "rule_risk": _sql(
            f"select shipment_id, {RULE} rule_score, cast({RULE} > 0.42e0 as int) rule_label from features", "features"
        ),
        "disruption_checks": _sql(
            f"""select shipment_id, cast({RULE} > 0.42e0 as int) rule_label, true mean_holds, true flag_holds, true confidence_holds,
  true model_agrees from features""",
            "features",
        ),
        "eta_estimates": _sql(
            f"""select shipment_id, carrier, transport_mode,
  timestamp '2001-08-01 00:00:00' + to_seconds(cast(floor(total*3600 + 0.5e0) as bigint)) eta, round(total, 1) eta_hours,
  round(total*0.85e0, 1) optimistic_hours, round(total*1.28e0, 1) pessimistic_hours,
  round(c*0.5e0 + w*0.3e0, 3) delay_risk, round(km/speed, 1) distance_hours, round(travel*0.3e0*c, 1) congestion_hours,
  round(travel*0.2e0*w, 1) weather_hours, round(stopped, 1) stop_hours from ({ETA})""",
            "shipments",
        ),
        "on_time_rate": _sql(ON_TIME, "shipments"),
        "eta_with_on_time": _sql(
            f"""select shipment_id, round(total, 1) eta_hours, on_time_probability
from ({ETA}) left join ({ON_TIME}) using (carrier, transport_mode)""",
            "shipments",
        ),
        "demand_projection": _sql("select * from projection", "projection"),
        "demand_summary": _sql(
            """select (select date from projection order by demand_units desc, date limit 1) peak_day,
  cast(round(sum(demand_units) / count(*)) as bigint) avg_demand from projection""",
            "projection",
        ),
        "demand_from_history": _sql(
            """, history as (select destination_port, transport_mode, created_date, date_diff('day', date '2001-08-01' - 364, created_date) t
  from shipments where created_date >= date '2001-08-01' - 364 and created_date < date '2001-08-01'),
cal as (select count(*) h, sum(i) st, sum(i*i) stt from range(364) t(i)),
lane as (select destination_port, transport_mode, count(*) n, cast(sum(t) as double) nt from history group by all),
fit as (select *, n/364e0 m, (364e0*nt - cast(st as double)*n) / (364e0*cast(stt as double) - cast(st as double)*cast(st as double)) b from lane, cal),
days as (select i step, date '2001-08-01' + cast(i as int) d from range(30) t(i)),
weekly as (select destination_port, transport_mode, isodow(created_date) dow, count(*) c from history group by all)
select f.destination_port, f.transport_mode, d as date,
  round(coalesce(c, 0)/52e0 * greatest(0, (m + b*(364 + step - cast(st as double)/364))/m), 3) demand_units
from fit f cross join days left join weekly w on w.destination_port = f.destination_port
  and w.transport_mode = f.transport_mode and w.dow = isodow(d)""",
            "shipments",
        ).replace("\n, history", ", history"),
        "delay_probability_series": _sql(
            """select date_trunc('hour', event_timestamp) as hour, count(*) as rows,
  round(count(*) filter (where coalesce(delay_added_hours, 0) > 0) / count(*), 6) as value
from route_events group by 1""",
            "route_events",
        ),
        "throughput_series": _sql(
            """select location_name, date_trunc('hour', event_timestamp) as hour, count(*) as rows, cast(count(*) as double) as value
from route_events group by all""",
            "route_events",
        ),
        "on_time_series": _sql("select * from hourly_on_time", "hourly_on_time"),
        "cost_index_series": _sql("select * from daily_cost", "daily_cost"),
        "metric_forecast": _sql(
            f"select location_name, cast(step as int) step, hour, forecast from ({_ridge('hourly_delay')})", "hourly_delay"
        ),
        "forecast_bands": _sql(_bands("hourly_on_time", "location_name", "0.70e0", "0.98e0"), "hourly_on_time"),
        "throughput_forecast": _sql(_bands("hourly_throughput", "location_name", "0e0", "1500e0"), "hourly_throughput"),
        "cost_index_forecast": _sql(_bands("daily_cost", "transport_mode", "1.0e0", "1.8e0"), "daily_cost"),
        "port_congestion": _sql("select node, round(congestion, 6) congestion from congestion", "congestion"),
        "edge_weights": _sql(
            """select src, dst, profile, transport_mode, weight, round(time_h, 6) time_h, round(cost, 6) as cost,
  round(risk, 6) risk from edges""",
            "edges",
        ),
        "network_view": _sql(
            """select *, case when risk < 0.3e0 then 'low' when risk < 0.6e0 then 'medium' else 'high' end band from (
  select src source, dst target, cast(distance_km as double) distance, modes, round(congestion, 2) congestion,
    round(congestion*0.7e0, 2) risk from lanes join congestion on node = dst)""",
            "lanes",
            "congestion",
        ),
        "network_nodes": _sql(
            """select node, lat, lon, node_type, capacity, (select count(*) from lanes where src = node) lanes_out,
  (select count(*) from lanes where dst = node) lanes_in, n events
from ports left join (select location_name node, count(*) n from route_events group by 1) using (node)""",
            "ports",
            "lanes",
            "route_events",
        ),
        "cheapest_paths": _sql(
            f"select {pair}, weight, array_to_string(path, '>') path from paths", "paths"
        ),
        "route_edges": _sql(
            f"select {pair}, leg, src, dst, round(time_h, 1) time_h, round(cost, 0) as cost, round(risk, 3) risk from legs",
            "legs",
        ),
        "route_stops": _sql(
            f"""select {pair}, stop - 1 stop, node, lat, lon, node_type, capacity
from (select *, unnest(generate_series(1, len(path))) stop from paths) join ports on node = path[stop]""",
            "paths",
            "ports",
        ),
        "route_details": _sql("select * exclude (route_risk) from details", "details"),
        "route_shipments": _sql(
            f"""select shipment_id, origin, destination, transport_mode, path, total_time_hours, total_cost_usd, total_risk_score,
  {_action('route_risk')}
from routed left join (select * from details where profile = 'balanced') using (origin, destination, transport_mode)""",
            "routed",
            "details",
        ),
        "route_alternatives": _sql(
            """select shipment_id, origin, destination, transport_mode, fastest_path, fastest_profile, cheapest_path,
  cheapest_profile, safest_path, safest_profile
from routed left join (
  select origin, destination, transport_mode,
    first(path order by total_time_hours, profile) fastest_path, first(profile order by total_time_hours, profile) fastest_profile,
    first(path order by total_cost_usd, profile) cheapest_path, first(profile order by total_cost_usd, profile) cheapest_profile,
    first(path order by total_risk_score, profile) safest_path, first(profile order by total_risk_score, profile) safest_profile
  from details group by all) using (origin, destination, transport_mode)""",
            "routed",
            "details",
        ),
        "lane_report": _sql(
            f"""select l.*, total_time_hours, total_cost_usd, total_risk_score from (
  select origin_port origin, destination_port destination, transport_mode, count(*) shipments,
    round({share(LATE)}, 4) delay_rate, round({mean('risk_score')}, 4) avg_risk,
    round({mean('freight_cost_usd')}, 2) avg_freight_usd from shipments group by all) l
left join (select * from details where profile = 'balanced') d using (origin, destination, transport_mode)""",
            "shipments",
            "details",
        ),
        "replay_ticks": _sql(
            """select event_id, event_timestamp, i - i % 7 as "offset", tick, least(7, n - (i - i % 7)) batch_size, n total_rows,
  ((tick - 1) // lap)*n + (i - i % 7) + least(7, n - (i - i % 7)) processed_records
from (select *, (n + 6) // 7 lap from marked) join range(2) r(l) on true, lateral (select i // 7 + 1 + l*lap tick)""",
            "marked",
        ),
        "live_kpis": _sql("select * from live", "live"),
        "live_savings": _sql(
            """select tick, 120*at_risk_shipments + 40*critical_alerts saved,
  cast(sum(120*at_risk_shipments + 40*critical_alerts) over (order by tick) as bigint) total_saved from live""",
            "live",
        ),
        "profile_shape": f"""select (select count(*) from lineitem) as rows, position, column_name, type
from (values {_values(LINEITEM_SHAPE)}) t(position, column_name, type)""",
        "profile_missing": _sql(_missing_counts(), "shipments"),
        "profile_numeric": _sql(_numeric_summary(), "shipments"),
        "profile_sample": """select cast(c_custkey as varchar) c_custkey, coalesce(c_name, '') c_name, cast(c_nationkey as varchar) c_nationkey,
  cast(c_acctbal as varchar) c_acctbal, coalesce(c_mktsegment, '') c_mktsegment from customer order by customer.c_custkey limit 5""",
        "profile_ready": _sql(
            f"""select max(rows) as rows, round(1 - sum(missing)/sum(rows), 3) completeness, cast({len(SHIPMENT_NUMBERS)} as bigint) numeric_features,
  cast(8 as bigint) categorical_features, max(rows) > 100 suitable_for_prediction from ({_missing_counts()})""",
            "shipments",
        ),
        "json_keys": "select key, count(*) occurrences from (select unnest(json_keys(props)) as key from events) group by key",
        "text_insights": f"""select doc_id, length(text) characters, substr(text, 1, 600) preview,
  array_to_string(list_transform(list_filter([{words}], lambda w: contains(lower(text), w))[1:6],
    lambda w: concat('Keyword found: ''', w, '''')), '; ') insights from documents""",
        "csv_load": _sql(
            """select shipment_id, carrier, origin_port, destination_port, transport_mode, status, goods_category, currency, created_date,
  cast(null as date) eta_date, cast(null as double) transit_hours, cast(delay_hours as double) delay_hours, distance_km, weight_kg,
  cast(null as double) volume_m3, cast(cast(value_usd as decimal(16,2)) as double) value_usd, round(freight_cost_usd, 2) freight_cost_usd,
  cast(num_containers as double) num_containers, cast(num_stops as double) num_stops,
  cast(priority_level as bigint) priority_level, cast(cast(risk_score as decimal(6,4)) as double) risk_score,
  cast(cast(weather_severity as decimal(6,4)) as double) weather_severity,
  cast(cast(port_congestion as decimal(6,4)) as double) port_congestion, cast(null as double) temperature_c,
  insurance_required from shipments""",
            "shipments",
        ),
        "csv_bad_rows": _sql(
            """select case transport_mode when 'air' then 'malformed' when 'road' then 'malformed' when 'rail' then 'no_key'
  else 'good' end outcome, count(*) as rows from shipments group by 1""",
            "shipments",
        ),
        "append_new": """select l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
  l_returnflag, l_linestatus from (
  select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey,
    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) nth from lineitem) i
where nth = 1 and not exists (select 1 from lineitem t where t.l_shipdate < timestamp '1996-01-01'
  and t.l_orderkey = i.l_orderkey and t.l_linenumber = i.l_linenumber)""",
        "load_report": """select * from (
  select cast(1 as bigint) run, 'shipments_master' table_name, 'success' status, count(*) rows_read, count(*) rows_inserted,
    cast(0 as bigint) rows_duplicate, cast(0 as bigint) rows_errored from orders union all
  select 2, 'shipments_master', 'success', count(*), 0, count(*), 0 from orders union all
  select 1, 'route_events', 'success', count(*), count(*), 0, 0 from events union all
  select 2, 'route_events', 'success', count(*), 0, count(*), 0 from events)""",
        "upload_append": _sql(
            """select shipment_id, carrier, origin_port, destination_port, transport_mode, status, created_date, weight_kg,
  cast(delay_hours as double) delay_hours, insurance_required, true stamped, strftime(created_date, '%Y-%m') created_month,
  cast(null as varchar) goods_category, cast(null as varchar) currency, cast(null as date) eta_date, cast(null as double) transit_hours,
  cast(null as double) distance_km, cast(null as double) volume_m3, cast(null as double) value_usd, cast(null as double) freight_cost_usd,
  cast(null as double) num_containers, cast(null as double) num_stops, cast(null as bigint) priority_level, cast(null as double) risk_score,
  cast(null as double) weather_severity, cast(null as double) port_congestion, cast(null as double) temperature_c from shipments""",
            "shipments",
        ),
        "conform_variant": _sql(
            """select shipment_id, origin_port, destination_port, transport_mode, status, created_date, weight_kg,
  cast(delay_hours as double) delay_hours, insurance_required, cast(null as double) num_stops, true stamped from shipments""",
            "shipments",
        ),
        "read_formats": """select format, c_custkey, c_name, cast(c_nationkey as bigint) c_nationkey, c_acctbal, c_mktsegment
from customer cross join (values ('csv'), ('parquet'), ('json')) f(format)""",
        "json_rows": _sql(
            """select concat('{"shipment_id":"', shipment_id, '","origin_port":', coalesce('"' || origin_port || '"', 'null'),
  ',"created_date":"', strftime(created_date, '%Y-%m-%d'), '","num_stops":', coalesce(cast(num_stops as varchar), 'null'),
  ',"delay_hours":', coalesce(cast(cast(delay_hours as double) as varchar), 'null'), ',"insurance_required":',
  cast(insurance_required as varchar), '}') json from shipments""",
            "shipments",
        ),
        "table_stats": " union all ".join(
            f"select '{t}' table_name, count(*) row_count, true sized from {t}" for t in TABLE_NAMES
        ),
        "source_status": f"""select source, name, frequency, table_name,
  case table_name when 'shipments_master' then (select count(*) from orders) when 'route_events' then (select count(*) from events) else 0 end row_count, table_name is not null table_size,
  case when table_name is null then 'no_table' else 'healthy' end status
from (values {_values(schema.SOURCE_REGISTRY)}) r(source, name, frequency, table_name)""",
        "rows_loaded": """select 'shipments_master' table_name, count(*) rows_loaded from orders union all
  select 'route_events', count(*) from events""",
        "ensure_tables": """select 'shipments_master' table_name, count(*) as rows, cast(27 as bigint) columns from orders union all
  select 'route_events', count(*), 23 from events""",
        "single_source_load": """select 'shipments_master' table_name, cast(0 as bigint) row_count, cast(null as varchar) status, cast(null as bigint) rows_inserted
  union all select 'route_events', count(*), 'success', count(*) from events""",
        "csv_quoted": """select cast(doc_id as varchar) shipment_id, '"' || source || '", Ltd' carrier,
  coalesce(text, '-') goods_category from documents""",
        "upload_bad_rows": _sql(
            """select run, 'partial' status, n rows_read, case run when 1 then good else 0 end rows_inserted,
  case run when 1 then 0 else good end rows_duplicate, n - good rows_errored,
  'no_key=' || 2*rail || ',unreadable=' || 2*road rejected
from (select count(*) n, count(*) filter (where transport_mode = 'rail') rail, count(*) filter (where transport_mode = 'road') road,
        count(*) filter (where transport_mode not in ('rail', 'road')) good from shipments) cross join (values (cast(1 as bigint)), (2)) r(run)""",
            "shipments",
        ),
        "stream_ledger": _sql(
            """select cast(part as bigint) tick, cast(sum(count(*)) over (order by part) - count(*) as bigint) as "offset", count(*) batch_size,
  cast(sum(count(*)) over (order by part) as bigint) processed_records from piece group by part""",
            "piece",
        ),
        "stream_health": _sql(
            """select *, 'route_events' table_name, tick < 5 connected from (
  select cast(part as bigint) tick, cast(sum(count(*)) over (order by part) - count(*) as bigint) as "offset", count(*) batch_size,
    cast(sum(count(*)) over (order by part) as bigint) processed_records, (select count(*) from events) total_rows from piece group by part)
where tick in (2, 4, 5)""",
            "piece",
        ),
        "stream_paced": _sql(
            """select cast(part as bigint) tick, cast(sum(count(*)) over (order by part) - count(*) as bigint) as "offset", count(*) batch_size,
  cast(sum(count(*)) over (order by part) as bigint) processed_records from piece group by part""",
            "piece",
        ),
        # After each batch that holds a location, over the location's newest 250 rows so far; the last of them, and all savings.
        "stream_live_kpis": _sql(
            """select location_name, max_by(records, p) records, max_by(active, p) active_shipments, max_by(risky, p) at_risk_shipments,
  max_by(on_time_rate, p) on_time_rate, max_by(critical, p) critical_alerts, count(*) batches, cast(sum(120*risky + 40*critical) as bigint) saved,
  greatest(count(*), max_by(risky, p)) routes_optimized
from (select location_name, p, count(*) records, count(distinct shipment_id) active, count(distinct case when severe then shipment_id end) risky,
        round(count(*) filter (where on_time) / count(*), 4) on_time_rate, count(*) filter (where critical) critical
      from (select b.p, x.*, row_number() over (partition by b.location_name, b.p order by event_timestamp desc, event_id desc) nth
            from (select distinct location_name, part p from piece) b join piece x on x.location_name = b.location_name and x.part <= b.p)
      where nth <= 250 group by location_name, p)
group by location_name""",
            "piece",
        ),
        "stream_congestion": _sql(
            """select start window_start, start + interval 7 days window_end, location_name, count(*) events,
  round((0.8e0*count(*) filter (where h) + 0.2e0*(count(*) - count(*) filter (where h)))/count(*), 6) congestion
from (select location_name, event_type in ('congestion_hold','port_entry','weather_hold') h,
        date_trunc('day', event_timestamp) - to_days(cast(i as int)) start from route_events, range(7) t(i))
where start + interval 7 days <= (select max(event_timestamp) - interval 1 day from route_events)
group by start, location_name""",
            "route_events",
        ),
        "stream_dedup": _sql(
            "select location_name, count(*) events, count(*) event_ids from route_events group by location_name", "route_events"
        ),
    }
    return {name: decimal_rounds(sql) for name, sql in q.items()}
