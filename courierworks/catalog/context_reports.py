"""Reports over city and zone context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierworks.catalog.registry import haversine, r, report
from courierworks.functions import context as fx
from courierworks.functions import zones as fz
from courierworks.functions.geo import bearing_deg, grid_zone_id, project_point
from courierworks.functions.num import finite, round_half_up
from courierworks.functions.status import metadata_map, metadata_tag
from courierworks.operators import context, fleet
from courierworks.operators.keyed import asof_left, nearest_rank
from courierworks.sources.adapters import REF_US, Views, ref_ts

# Weather of the test hour and ages of the sources (one is stale).
PRECIP, WIND = 3.0, 18.0
AGES = {"gbfs": 100, "weather": 400, "nyc311": 900, "events": 300, "dot_closure": 1200, "dot_speeds": 500}

CENTRES = "(VALUES ('manhattan', 40.7831::double, -73.9712::double), ('brooklyn', 40.6782, -73.9442), ('queens', 40.7282, -73.7949), ('bronx', 40.8448, -73.8648)) b(borough, lat, lon)"
ALIAS = """CASE lower(trim(event_borough)) WHEN 'manhattan' THEN 'manhattan' WHEN 'bk' THEN 'brooklyn' WHEN 'queens' THEN 'queens' WHEN 'x' THEN 'bronx' END"""
INTENSITY = """CASE WHEN regexp_matches(lower(event_type || ' ' || event_name), 'parade|festival|fair|concert|marathon|carnival') THEN 1.25::double
  WHEN regexp_matches(lower(event_type || ' ' || event_name), 'street|block party|community|cultural') THEN 1.1::double
  WHEN regexp_matches(lower(event_type || ' ' || event_name), 'sport|baseball|soccer|basketball|tournament') THEN 0.95::double ELSE 1.0::double END"""
EVENTS_SQL = f"""ce AS (SELECT e.*, b.borough, b.lat, b.lon, {INTENSITY} AS intensity FROM (SELECT *, {ALIAS} AS bor FROM city_events) e
  JOIN {CENTRES} ON b.borough = e.bor WHERE end_ts > start_ts)"""


def weight(now_us: int, ahead_s: float, after_s: float) -> str:
    lead, tail = f"((epoch_us(start_ts) - {now_us}) / 1000000.0::double)", f"(({now_us} - epoch_us(end_ts)) / 1000000.0::double)"
    return f"""(CASE WHEN {tail} > {after_s} THEN 0 WHEN {lead} <= 0 AND {tail} <= 0 THEN 1 WHEN {lead} > {ahead_s} THEN 0
  WHEN {lead} > 0 THEN 0.25::double + 0.75::double * (1 - {lead} / {ahead_s}::double) ELSE 0.35::double * (1 - {tail} / {after_s}::double) END)"""


def city_events(v: Views) -> DataFrame:
    """The test events as the text rows a source gives: New York local time without a zone."""
    text = lambda c: F.date_format(F.from_utc_timestamp(c, fx.NEW_YORK), "yyyy-MM-dd'T'HH:mm:ss")
    rows = v.city_events.select(
        F.col("event_id").cast("string").alias("event_id"), "event_name", "event_type", "event_borough",
        text("start_ts").alias("start_date_time"), text("end_ts").alias("end_date_time"))
    return context.normalize_city_events(rows)


def speeds(v: Views) -> DataFrame:
    kmh = fx.normalize_speed("speed_mph", "speed_mph")
    return v.link_speeds.select("link_id", "lat", "lon", kmh.alias("speed_kmh")).where("speed_kmh > 0.1").withColumn(
        "severity", fx.speed_severity("speed_kmh"))


def closures(v: Views) -> DataFrame:
    """Closures of the tests: every city event of a kind that blocks a street."""
    return city_events(v).where(F.col("event_type").isin("Parade", "Block Party")).select(
        "lat", "lon", "start_ts", "end_ts", (F.col("intensity") - 0.5).alias("severity"))


def stations(v: Views) -> DataFrame:
    info = v.stations.select("station_id", "lat", "lon")
    return context.stations_joined(v.stations.select("station_id", "num_bikes_available", "num_docks_available"), info)


def sources(v: Views) -> DataFrame:
    """Last update per source: the age before the newest position that the table above gives."""
    newest = v.positions.agg(F.max("ts").alias("ts"))
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("age")) for n, a in AGES.items()])
    return newest.select(F.explode(pairs).alias("s"), "ts").select(
        "s.name", F.timestamp_micros((F.lit(REF_US) - F.col("s.age") * 1_000_000).cast("long")).alias("last_updated"))


SPEEDS_SQL = """ls AS (SELECT *, CASE WHEN kmh >= 38 THEN 0 ELSE greatest(0.0::double, least(1.25::double, (38 - kmh) / 38 + CASE WHEN kmh < 12 THEN 0.2::double ELSE 0 END)) END AS severity
  FROM (SELECT *, speed_mph * 1.60934::double AS kmh FROM link_speeds) WHERE kmh > 0.1)"""
EVENT_P = f"""ep AS (SELECT z.zone_id, {r("least(0.75::double, 0.55::double * coalesce(sum(intensity * w * power(greatest(1 - km / 4.5::double, 0), 2)), 0))", 4)} AS event_pressure,
  count(km) AS event_count_nearby FROM zones z LEFT JOIN (SELECT z.zone_id, e.intensity, e.w, {haversine('z.lat', 'z.lon', 'e.lat', 'e.lon')} AS km FROM zones z,
    (SELECT *, {weight(REF_US, 21600.0, 3600.0)} AS w FROM ce) e WHERE e.w > 0 AND {haversine('z.lat', 'z.lon', 'e.lat', 'e.lon')} <= 4.5) h USING (zone_id) GROUP BY 1)"""
CLOSURE_P = f"""cp AS (SELECT z.zone_id, {r("least(0.55::double, 0.32::double * coalesce(sum(greatest(severity, 0.05) * w * power(greatest(1 - km / 4.5::double, 0), 2)), 0))", 4)} AS closure_pressure
  FROM zones z LEFT JOIN (SELECT z.zone_id, e.severity, e.w, {haversine('z.lat', 'z.lon', 'e.lat', 'e.lon')} AS km FROM zones z,
    (SELECT *, intensity - 0.5::double AS severity, {weight(REF_US, 259200.0, 14400.0)} AS w FROM ce WHERE event_type IN ('Parade', 'Block Party')) e
    WHERE e.w > 0 AND {haversine('z.lat', 'z.lon', 'e.lat', 'e.lon')} <= 4.5) h USING (zone_id) GROUP BY 1)"""
SPEED_P = f"""sp AS (SELECT z.zone_id, {r("coalesce(least(0.45::double, 0.55::double * sum(severity * (1 - km / 3.5::double)) / nullif(sum(1 - km / 3.5::double), 0)), 0)", 4)} AS speed_pressure
  FROM zones z LEFT JOIN (SELECT z.zone_id, s.severity, {haversine('z.lat', 'z.lon', 's.lat', 's.lon')} AS km FROM zones z, ls s
    WHERE severity > 0 AND {haversine('z.lat', 'z.lon', 's.lat', 's.lon')} <= 3.5) h USING (zone_id) GROUP BY 1)"""


@report("city_events_normalized", f"""WITH {EVENTS_SQL} SELECT cast(event_id as varchar) AS event_id, borough, epoch_us(start_ts) AS start_us, epoch_us(end_ts) AS end_us,
  lat, lon, intensity FROM ce""")
def city_events_normalized(v: Views):
    return city_events(v).select("event_id", "borough", F.unix_micros("start_ts").alias("start_us"),
                                 F.unix_micros("end_ts").alias("end_us"), "lat", "lon", "intensity")


@report("city_event_window", f"""SELECT cast(event_id as varchar) AS event_id FROM city_events WHERE epoch_us(end_ts) >= {REF_US} - 3600000000
  AND epoch_us(start_ts) <= {REF_US} + 3600000000""")
def city_event_window(v: Views):
    return fx.city_event_window(v.city_events, ref_ts(), 1.0, 60.0).select(F.col("event_id").cast("string").alias("event_id"))


@report("event_pressure", f"WITH {EVENTS_SQL}, {EVENT_P} SELECT * FROM ep")
def event_pressure(v: Views):
    return context.event_pressure(v.zones, city_events(v), ref_ts())


@report("closure_pressure", f"WITH {EVENTS_SQL}, {CLOSURE_P} SELECT * FROM cp")
def closure_pressure(v: Views):
    return context.closure_pressure(v.zones, closures(v), ref_ts())


@report("speed_pressure", f"WITH {SPEEDS_SQL}, {SPEED_P} SELECT * FROM sp")
def speed_pressure(v: Views):
    return context.speed_pressure(v.zones, speeds(v))


@report("link_severity", f"WITH {SPEEDS_SQL} SELECT link_id, {r('kmh', 5)} AS speed_kmh, {r('severity', 6)} AS severity FROM ls")
def link_severity(v: Views):
    return speeds(v).select("link_id", round_half_up("speed_kmh", 5).alias("speed_kmh"), round_half_up("severity", 6).alias("severity"))


@report("stations_joined", "SELECT station_id, lat, lon, num_bikes_available AS bikes, num_docks_available AS docks FROM stations")
def stations_joined(v: Views):
    return stations(v)


GRID = "printf('%.3f', round(lat / 0.02::double, 0) * 0.02::double) || '_' || printf('%.3f', round(lon / 0.02::double, 0) * 0.02::double)"


@report("station_zone_signal", f"""SELECT zone_id, n AS stations_count, b::bigint AS bikes_available, d::bigint AS docks_available, {r('b / greatest(b + d, 1)::double', 3)} AS occupancy_ratio,
  {r('greatest(1 - b / greatest(b + d, 1)::double, 0) * 0.5::double', 3)} AS demand_boost FROM (SELECT {GRID} AS zone_id, count(*) AS n, sum(num_bikes_available) AS b, sum(num_docks_available) AS d FROM stations GROUP BY 1)""")
def station_zone_signal(v: Views):
    return context.station_zone_signal(stations(v))


DEMAND_SQL = f"""zd AS (SELECT z.zone_id, {r("least(3.2::double, 1 + least(1.5::double, count(s.station_id) / 5.0::double) + coalesce(max(ep.event_pressure), 0) + 0.22::double)", 3)} AS demand_index
  FROM zones z LEFT JOIN stations s ON abs(s.lat - z.lat) < 0.02 AND abs(s.lon - z.lon) < 0.025 AND s.num_bikes_available < 3
    AND {haversine('z.lat', 'z.lon', 's.lat', 's.lon')} <= 0.8 JOIN ep ON ep.zone_id = z.zone_id GROUP BY 1)"""


@report("zone_demand", f"WITH {EVENTS_SQL}, {EVENT_P}, {DEMAND_SQL} SELECT * FROM zd")
def zone_demand(v: Views):
    return context.zone_demand(v.zones, stations(v), context.event_pressure(v.zones, city_events(v), ref_ts()), 0.22)


LATEST = """latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY courier_id
  ORDER BY ts DESC, event_id) AS rn FROM positions) WHERE rn = 1)"""
SUPPLY_SQL = f"""zs AS (SELECT z.zone_id, {r('greatest(0.2::double, least(5.0::double, count(l.courier_id) / 4.0::double))', 3)} AS supply_index FROM zones z
  LEFT JOIN latest l ON {haversine('z.lat', 'z.lon', 'l.lat', 'l.lon')} <= 1.0 GROUP BY 1)"""


@report("zone_supply", f"WITH {LATEST}, {SUPPLY_SQL} SELECT * FROM zs")
def zone_supply(v: Views):
    return context.zone_supply(v.zones, fleet.latest_positions(v.positions))


def traffic_sql(incidents: str) -> str:
    near = f"""{haversine('z.lat', 'z.lon', 'i.lat', 'i.lon')} <= 1.5 AND abs(i.lat - z.lat) <= 1.5::double / 111.32::double
    AND abs(i.lon - z.lon) <= 1.5::double / (cos(radians(z.lat)) * 111.32::double)"""
    return f"""zt AS (SELECT z.zone_id, {r(f"least(2.4::double, 1 + least(0.45::double, count(i.incident_id) / 12.0::double) + 0.2::double + max(cp.closure_pressure) + max(sp.speed_pressure))", 3)} AS traffic_factor
  FROM zones z LEFT JOIN {incidents} i ON {near} JOIN cp ON cp.zone_id = z.zone_id JOIN sp ON sp.zone_id = z.zone_id GROUP BY 1)"""


@report("zone_traffic", f"WITH {EVENTS_SQL}, {CLOSURE_P}, {SPEEDS_SQL}, {SPEED_P}, {traffic_sql('incidents')} SELECT * FROM zt")
def zone_traffic(v: Views):
    return context.zone_traffic(v.zones, v.incidents, context.closure_pressure(v.zones, closures(v), ref_ts()),
                                context.speed_pressure(v.zones, speeds(v)), F.lit(PRECIP), ref_ts())


@report("source_freshness", f"""SELECT name, age::double AS age_s, m::double AS max_age_s, age > m AS stale FROM (VALUES ('gbfs', {AGES['gbfs']}, 180), ('weather', {AGES['weather']}, 1500),
  ('nyc311', {AGES['nyc311']}, 750), ('events', {AGES['events']}, 1500), ('dot_closure', {AGES['dot_closure']}, 3600), ('dot_speeds', {AGES['dot_speeds']}, 750)) t(name, age, m)
WHERE (SELECT count(*) FROM positions) > 0""")
def source_freshness(v: Views):
    return context.source_freshness(sources(v), ref_ts())


SIGNAL_META = """'gbfs+open-meteo;age_dot_closure_s=1200;age_dot_speeds_s=500;age_events_s=300;age_gbfs_s=100;age_nyc311_s=900;age_weather_s=400;event_count_nearby='
  || event_count_nearby || ';event_pressure=' || regexp_replace(regexp_replace(printf('%.4f', event_pressure), '0+$', ''), '\\.$', '')
  || ';freshness_fallback_applied=1;freshness_policy=stale_neutral_v1;freshness_stale_sources=1;stale_dot_closure=0;stale_dot_speeds=0;stale_events=0;stale_gbfs=0;stale_nyc311=1;stale_weather=0;temporal_hour_local=20;temporal_is_holiday=0;temporal_is_peak=0;temporal_is_weekend=1;temporal_pressure=0.08;weather_intensity=0.451;weather_precip_mm=3;weather_wind_kmh=18'"""


@report("context_signals_built", f"""WITH {EVENTS_SQL}, {EVENT_P}, {CLOSURE_P}, {SPEEDS_SQL}, {SPEED_P}, {LATEST}, {SUPPLY_SQL},
  {DEMAND_SQL.replace('0.22::double', '0.08::double')}, {traffic_sql('(SELECT * FROM incidents WHERE false)')}
SELECT zone_id, demand_index, supply_index, 1.75::double AS weather_factor, traffic_factor, event_pressure, closure_pressure, speed_pressure, {SIGNAL_META} AS source
FROM zd JOIN zs USING (zone_id) JOIN zt USING (zone_id) JOIN ep USING (zone_id) JOIN cp USING (zone_id) JOIN sp USING (zone_id)""")
def context_signals_built(v: Views):
    built = context.build_context_signals(
        v.zones, stations(v), city_events(v), closures(v), speeds(v), v.incidents, fleet.latest_positions(v.positions),
        PRECIP, WIND, sources(v), ref_ts())
    return built.drop("ts", "event_count_nearby")


META_SQL = """(CASE WHEN source LIKE '%;%' THEN map_from_entries(list_transform(string_split(source, ';')[2:], lambda x: {'k': string_split(x, '=')[1], 'v': string_split(x, '=')[2]})) ELSE MAP {} END)"""
PARSED_SQL = f"""ps AS (SELECT *, coalesce(try_cast(m['event_pressure'] AS double), 0) AS event_pressure, coalesce(try_cast(m['event_count_nearby'] AS bigint), 0) AS event_count_nearby,
    CASE WHEN m['temporal_is_peak'] = '1' THEN 1 ELSE 0 END::bigint AS is_peak_hour, coalesce(try_cast(m['freshness_stale_sources'] AS bigint), 0) AS context_stale_sources,
    string_split(source, ';')[1] AS tag FROM (SELECT *, {META_SQL} AS m FROM context_signals))"""


@report("signals_parsed", f"""WITH {PARSED_SQL} SELECT event_id, {r('event_pressure', 4)} AS event_pressure, event_count_nearby, is_peak_hour, context_stale_sources, tag AS source,
  -1.0::double AS age_gbfs_s FROM ps""")
def signals_parsed(v: Views):
    return context.parse_signal(v.context_signals).select(
        "event_id", "event_pressure", "event_count_nearby", "is_peak_hour", "context_stale_sources", "source", "age_gbfs_s")


QUALITY_SQL = f"""WITH {PARSED_SQL},
t AS (SELECT ts, count(*) AS zones, min(supply_index) AS a, max(supply_index) AS b, sum(i) / 1000.0::double / count(*) AS m, (sum(i * i) * count(*) - sum(i) * sum(i))::double / (count(*) * count(*))::double / 1000000.0::double AS var, avg((traffic_factor > 1.01)::int) AS nz,
    sum(cast(round(traffic_factor * 1000) AS bigint)) / 1000.0::double / count(*) AS tm, sum(cast(round(event_pressure * 10000) AS bigint)) / 10000.0::double / count(*) AS em, max(event_pressure) AS ex, avg((event_pressure > 0.001)::int) AS en FROM (SELECT *, cast(round(supply_index * 1000) AS bigint) AS i FROM ps) GROUP BY 1),
s AS (SELECT *, max({r('m', 4)}) OVER w - min({r('m', 4)}) OVER w AS span, count(*) OVER w AS cycles FROM t WINDOW w AS (ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT epoch_us(ts) AS ts_us, zones, {r('a', 3)} AS supply_min, {r('b', 3)} AS supply_max, {r('m', 3)} AS supply_mean, {r('sqrt(var)', 3)} AS supply_std, {r('var', 5)} AS supply_variance,
  {r('span', 5)} AS supply_window_span, cycles, cycles >= 6 AND span <= 0.03 AS supply_flat_alert, {r('nz', 3)} AS traffic_nonzero_rate, {r('tm', 3)} AS traffic_mean,
  {r('em', 4)} AS event_pressure_mean, {r('ex', 4)} AS event_pressure_max, {r('en', 4)} AS event_pressure_nonzero_rate FROM s"""


@report("context_quality", QUALITY_SQL)
def context_quality(v: Views):
    return context.context_quality(context.parse_signal(v.context_signals)).withColumn("ts_us", F.unix_micros("ts")).drop("ts")


EMA_SQL = f"""z0 AS (SELECT zone_id, event_id, epoch_us(ts) AS us, {r('demand_index', 3)} AS d, row_number() OVER (PARTITION BY zone_id ORDER BY ts, event_id) AS n FROM context_signals),
ze AS (SELECT zone_id, event_id, n, d, us, 0.0::double AS trend, 0.0::double AS ema, greatest(0.3::double, d) AS fc, NULL::double AS tick FROM z0 WHERE n = 1
  UNION ALL SELECT q.zone_id, q.event_id, q.n, q.d, q.us, {r('q.d - e.d', 3)}, {r('0.65::double * (q.d - e.d) + 0.35::double * e.ema', 3)},
    {r('greatest(0.3::double, q.d + (0.65::double * (q.d - e.d) + 0.35::double * e.ema) * 1.4::double)', 3)}, {r('greatest(0, (q.us - e.us) / 1000000.0::double)', 3)}
  FROM ze e JOIN z0 q ON q.zone_id = e.zone_id AND q.n = e.n + 1)"""


@report("zone_trend_ema", f"WITH RECURSIVE {EMA_SQL} SELECT zone_id, event_id, trend AS demand_trend, ema AS demand_trend_ema, {r('fc', 3)} AS forecast_demand_index_15m, tick AS context_tick_s FROM ze")
def zone_trend_ema(v: Views):
    return context.zone_trend_ema(v.context_signals)


STATE_SQL = f"""{EMA_SQL}, {PARSED_SQL}, zst AS (SELECT * FROM (SELECT ps.*, ze.trend, ze.ema, {r('ze.fc', 3)} AS fc, row_number() OVER (PARTITION BY ps.zone_id ORDER BY ps.ts DESC, ps.event_id) AS rn
  FROM ps JOIN ze ON ze.zone_id = ps.zone_id AND ze.event_id = ps.event_id) WHERE rn = 1)"""


@report("zone_context_state", f"""WITH RECURSIVE {STATE_SQL} SELECT zone_id, event_id, {r('demand_index', 3)} AS demand_index, {r('supply_index', 3)} AS supply_index, trend AS demand_trend, ema AS demand_trend_ema,
  fc AS forecast_demand_index_15m, {r('event_pressure', 4)} AS event_pressure, context_stale_sources FROM zst""")
def zone_context_state(v: Views):
    return context.zone_context_state(v.context_signals).select(
        "zone_id", "event_id", "demand_index", "supply_index", "demand_trend", "demand_trend_ema", "forecast_demand_index_15m",
        "event_pressure", "context_stale_sources")


OPPORTUNITY_SQL = f"""{STATE_SQL}, zo AS (SELECT s.zone_id, {r('demand_index', 3)} AS demand, greatest({r('supply_index', 3)}, 0.2) AS supply, {r('weather_factor', 3)} AS weather, greatest({r('traffic_factor', 3)}, 0.2) AS traffic,
  trend, ema, fc, event_pressure, context_stale_sources, {r('z.lat', 6)} AS lat, {r('z.lon', 6)} AS lon FROM zst s JOIN zones z USING (zone_id)),
zop AS (SELECT *, {r('demand / supply * weather / traffic', 4)} AS opportunity FROM zo)"""


def opportunity(v: Views) -> DataFrame:
    return context.zone_opportunity(context.zone_context_state(v.context_signals), v.zones)


@report("zone_opportunity", f"WITH RECURSIVE {OPPORTUNITY_SQL} SELECT zone_id, lat, lon, opportunity AS opportunity_score FROM zop")
def zone_opportunity(v: Views):
    return opportunity(v).select("zone_id", "lat", "lon", "opportunity_score")


@report("demand_trend_from_context", f"""WITH RECURSIVE {STATE_SQL},
x AS (SELECT zone_id, greatest({r('demand_index', 3)}, 0.1) AS d, greatest(fc, 0) AS f, greatest({r('traffic_factor', 3)}, 0.2) AS t FROM zst),
y AS (SELECT *, {r('(f - d) / d * 100', 1)} AS trend_pct FROM x)
SELECT zone_id, greatest(1, {r('d * 12', 0)})::bigint AS recent_count, {r('d', 1)} AS baseline_count, {r('greatest(8, 18 / t)', 1)} AS recent_speed_kmh, trend_pct,
  CASE WHEN trend_pct > 15 THEN 'rising' WHEN trend_pct < -15 THEN 'falling' ELSE 'stable' END AS signal,
  CASE WHEN trend_pct > 15 THEN 'send_courier' WHEN trend_pct < -15 THEN 'redeploy' ELSE 'keep_coverage' END AS action FROM y""")
def demand_trend_from_context(v: Views):
    return fleet.demand_trend_from_context(context.zone_context_state(v.context_signals))


def _coverage(demand: str, resolution: float = 0.02) -> str:
    from courierworks.catalog.fleet_reports import _coverage_sql

    return _coverage_sql(demand, resolution)


@report("zone_coverage_from_context", f"""WITH RECURSIVE {OPPORTUNITY_SQL}, {LATEST},
{_coverage('SELECT {i} AS i, {j} AS j, max(greatest(demand, fc)) AS demand FROM zop GROUP BY 1, 2')}""")
def zone_coverage_from_context(v: Views):
    return fleet.zone_coverage_from_context(opportunity(v), fleet.latest_positions(v.positions))


@report("zone_forecast", f"""WITH RECURSIVE {OPPORTUNITY_SQL},
q AS (SELECT *, greatest(0.3::double, demand + ema * 0.84::double + (weather - 1) * 0.25::double - greatest(0, traffic - 1) * 0.35::double * 2) AS fd,
  greatest(0.2::double, supply * (1 + greatest(0, traffic - 1) * 0.18::double * 2)) AS fs FROM zop)
SELECT zone_id, {r('fd', 6)} AS forecast_demand_index, {r('fs', 6)} AS forecast_supply_index, {r('fd / fs', 6)} AS forecast_pressure_ratio, {r('fd / fs * weather / traffic', 6)} AS forecast_opportunity_score,
  {r('least(1, abs(ema) * 1.7::double + abs(traffic - 1) * 0.95::double + abs(weather - 1) * 0.55::double)', 6)} AS forecast_volatility FROM q""")
def zone_forecast(v: Views):
    c = F.col
    out = fz.forecast_zone(c("demand_index"), c("supply_index"), c("weather_factor"), c("traffic_factor"), F.lit(0.0),
                           c("demand_trend_ema"), F.lit(60.0))
    return opportunity(v).select("zone_id", *[round_half_up(x, 6).alias(n) for n, x in out.items()])


@report("offers_asof_context", f"""SELECT o.offer_id, c.event_id AS signal_id, c.supply_index, (epoch_us(o.ts) - epoch_us(c.ts)) / 1000000.0::double AS context_age_s
FROM offers o ASOF LEFT JOIN context_signals c ON c.zone_id = o.zone_id AND c.ts <= o.ts""")
def offers_asof_context(v: Views):
    signals = v.context_signals.select("zone_id", F.col("ts").alias("ctx_ts"), F.col("event_id").alias("signal_id"), "supply_index")
    joined = asof_left(v.offers, signals, "zone_id", "ts", "ctx_ts", "signal_id", ["signal_id", "supply_index", "ctx_ts"])
    return joined.select("offer_id", "signal_id", "supply_index",
                         ((F.unix_micros("ts") - F.unix_micros("ctx_ts")) / 1e6).alias("context_age_s"))


ENRICH_SQL = f"""WITH RECURSIVE {EMA_SQL}, {PARSED_SQL},
oc AS (SELECT o.*, p.lat AS clat, p.lon AS clon, p.speed_kmh AS cspeed, p.status AS cstatus FROM offers o ASOF LEFT JOIN
  (SELECT * FROM positions QUALIFY row_number() OVER (PARTITION BY courier_id, ts ORDER BY event_id DESC) = 1) p ON p.courier_id = o.courier_id AND p.ts <= o.ts),
oz AS (SELECT oc.*, s.event_id AS signal_id, s.demand_index AS zd, s.supply_index AS zsup, s.weather_factor AS zw, s.traffic_factor AS zt FROM oc ASOF LEFT JOIN ps s ON s.zone_id = oc.zone_id AND s.ts <= oc.ts),
e1 AS (SELECT *, coalesce({haversine('clat', 'clon', 'pickup_lat', 'pickup_lon')}, 0) AS km, greatest(coalesce(cspeed, 18), 6) AS v, {r('coalesce(zd, demand_index)', 3)} AS d,
  greatest(coalesce({r('zsup', 3)}, 1), 0.2) AS s, coalesce({r('zw', 3)}, weather_factor) AS w, greatest(coalesce({r('zt', 3)}, traffic_factor), 0.2) AS t FROM oz),
e2 AS (SELECT *, km / v * 60 AS eta, (km + estimated_distance_km) * 0.621371::double / 31 * 3.65::double AS fuel FROM e1),
e3 AS (SELECT *, greatest(-2.0::double, estimated_fare_eur - fuel) / greatest(1, estimated_duration_min + eta) * 60 AS h, d / s AS pr FROM e2)
SELECT offer_id, {r('km', 3)} AS distance_to_pickup_km, {r('eta', 3)} AS eta_to_pickup_min, {r('fuel', 3)} AS fuel_cost_usd, {r('h', 3)} AS eur_per_hour_net, {r('pr', 3)} AS pressure_ratio,
  {r('greatest(0.01, least(0.99, 1 / (1 + exp(-((h - 16) / 10 + (pr - 1) * 0.9::double + (w - 1) * 0.4::double - (t - 1) * 0.35::double)))))', 4)} AS accept_score_heuristic,
  concat_ws(',', CASE WHEN h >= 22 THEN 'high_net_revenue' WHEN h < 14 THEN 'low_net_revenue' END, CASE WHEN pr >= 1.25 THEN 'high_demand_pressure' WHEN pr < 0.9 THEN 'low_demand_pressure' END,
    CASE WHEN t > 1.2 THEN 'traffic_penalty' END, CASE WHEN cstatus = 'delivering' THEN 'courier_busy' END) AS explanation FROM e3"""


@report("enrich_offers", ENRICH_SQL)
def enrich_offers(v: Views):
    from courierworks.plans.enrich import enrich_offers as enrich

    out = enrich(v.offers, v.positions, context.parse_signal(v.context_signals))
    return out.select("offer_id", "distance_to_pickup_km", "eta_to_pickup_min", "fuel_cost_usd", "eur_per_hour_net", "pressure_ratio",
                      "accept_score_heuristic", F.array_join("explanation", ",").alias("explanation"))


LOCAL = "(request_datetime - INTERVAL 5 HOUR)"


@report("temporal_context", f"""WITH t AS (SELECT DISTINCT request_datetime FROM trips),
l AS (SELECT *, hour({LOCAL}) + minute({LOCAL}) / 60.0::double AS h, isodow({LOCAL}) >= 6 AS we, cast({LOCAL} AS date) IN (DATE '2024-01-01', DATE '2024-01-15') AS ho FROM t),
p AS (SELECT *, (h >= 7 AND h < 10) OR (h >= 16 AND h < 20) AS pk FROM l)
SELECT epoch_us(request_datetime) AS ts_us, {r('h', 3)} AS hour_local, pk AS is_peak_hour, we AS is_weekend, ho AS is_holiday,
  {r('least(0.32::double, CASE WHEN pk THEN 0.14::double WHEN h >= 11 AND h < 14 THEN 0.05::double ELSE 0 END + CASE WHEN we THEN 0.08::double ELSE 0 END + CASE WHEN ho THEN 0.12::double ELSE 0 END)', 4)} AS temporal_pressure,
  CASE WHEN h >= 7 AND h < 10 THEN 0.18::double WHEN h >= 16 AND h < 20 THEN 0.22::double WHEN h >= 11 AND h < 14 THEN 0.07::double ELSE 0 END AS rush FROM p""")
def temporal_context(v: Views):
    times = v.trips.select("request_datetime").distinct()
    out = fx.temporal_context(F.col("request_datetime"))
    return times.select(F.unix_micros("request_datetime").alias("ts_us"), *[x.alias(n) for n, x in out.items()],
                        fx.rush_hour_factor(F.col("request_datetime")).alias("rush"))


@report("weather_scores", f"""SELECT offer_id, {r('1 + least(0.5::double, p / 4) + least(0.25::double, w / 45)', 3)} AS weather_factor,
  {r('least(p / 6, 1) * 0.65::double + least(w / 50, 1) * 0.35::double', 4)} AS weather_intensity FROM (SELECT offer_id, estimated_distance_km / 3 AS p, estimated_duration_min * 2 AS w FROM offers)""")
def weather_scores(v: Views):
    p, w = F.col("estimated_distance_km") / 3.0, F.col("estimated_duration_min") * 2.0
    return v.offers.select("offer_id", fx.weather_factor(p, w).alias("weather_factor"), fx.weather_intensity(p, w).alias("weather_intensity"))


@report("bearing_and_projection", f"""WITH b AS (SELECT offer_id, (degrees(atan2(sin(radians(dropoff_lon - pickup_lon)) * cos(radians(dropoff_lat)), cos(radians(pickup_lat)) * sin(radians(dropoff_lat))
    - sin(radians(pickup_lat)) * cos(radians(dropoff_lat)) * cos(radians(dropoff_lon - pickup_lon)))) + 360.0::double) % 360.0::double AS bearing, radians(pickup_lat) AS la, radians(pickup_lon) AS lo,
    estimated_distance_km / 6371.0::double AS arc FROM offers),
p AS (SELECT *, asin(sin(la) * cos(arc) + cos(la) * sin(arc) * cos(radians(bearing))) AS la2 FROM b)
SELECT offer_id, {r('bearing', 4)} AS bearing, {r('degrees(la2)', 5)} AS lat2,
  {r('degrees(lo + atan2(sin(radians(bearing)) * sin(arc) * cos(la), cos(arc) - sin(la) * sin(la2)))', 5)} AS lon2 FROM p""")
def bearing_and_projection(v: Views):
    b = bearing_deg("pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon")
    rows = v.offers.withColumn("b", b)
    lat2, lon2 = project_point("pickup_lat", "pickup_lon", "b", "estimated_distance_km")
    return rows.select("offer_id", round_half_up("b", 4).alias("bearing"), round_half_up(lat2, 5).alias("lat2"), round_half_up(lon2, 5).alias("lon2"))


@report("driver_grid_zone", f"WITH {LATEST} SELECT courier_id, {GRID} AS zone_cell FROM latest")
def driver_grid_zone(v: Views):
    return fleet.latest_positions(v.positions).select("courier_id", grid_zone_id("lat", "lon").alias("zone_cell"))


@report("metadata_tags", "SELECT event_id, string_split(source, ';')[1] AS tag, greatest(len(string_split(source, ';')) - 1, 0)::bigint AS entries FROM context_signals")
def metadata_tags(v: Views):
    return v.context_signals.select("event_id", metadata_tag("source").alias("tag"), F.size(metadata_map("source")).cast("long").alias("entries"))


@report("clean_floats", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.score') AS double), -1) AS score FROM events")
def clean_floats(v: Views):
    return v.events.select("event_id", finite(F.get_json_object("props", "$.score"), -1.0).alias("score"))


@report("latency_percentiles", """WITH s AS (SELECT status, speed_kmh AS x, row_number() OVER (PARTITION BY status ORDER BY speed_kmh) AS n, count(*) OVER (PARTITION BY status) AS c FROM positions)
SELECT status, min(x) FILTER (WHERE n >= ceil(c * 50 / 100.0::double)) AS p50, min(x) FILTER (WHERE n >= ceil(c * 95 / 100.0::double)) AS p95, min(x) FILTER (WHERE n >= ceil(c * 99 / 100.0::double)) AS p99 FROM s GROUP BY 1""")
def latency_percentiles(v: Views):
    return nearest_rank(v.positions, ["status"], "speed_kmh", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).drop("n")
