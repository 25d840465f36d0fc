"""Reports over positions: density, trajectories, scores, coverage, demand, surge."""

from __future__ import annotations

from pyspark.sql import functions as F

from courierworks.catalog.registry import haversine, r, report
from courierworks.operators import fleet, spatial
from courierworks.operators.keyed import first_by
from courierworks.session import stage
from courierworks.sources.adapters import REF_TS, Views, ref_ts

REF_SQL = f"TIMESTAMP '{REF_TS}'"


def cell(value: str, resolution: float, digits: int) -> str:
    text = f"cast({resolution} as double)"
    return r(f"round({value} / {text}, 0) * {text}", digits)


CANONICAL = """CASE WHEN lower(trim(coalesce({0}, ''))) IN ('delivering', 'on_trip', 'busy') THEN 'delivering'
  WHEN lower(trim(coalesce({0}, ''))) IN ('available', 'ready', 'waiting_order') THEN 'available'
  WHEN lower(trim(coalesce({0}, ''))) IN ('idle', 'offline', 'paused') THEN 'idle'
  WHEN lower(trim(coalesce({0}, ''))) = '' THEN 'unknown' ELSE lower(trim({0})) END"""
BUCKET = """CASE WHEN {0} IN ('available', 'delivering', 'repositioning', 'idle') THEN {0}
  WHEN {0} IN ('pickup_arrived', 'pickup_assigned', 'pickup_en_route') THEN 'pickup' ELSE 'unknown' END"""
LATEST = """latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY courier_id
  ORDER BY ts DESC, event_id) AS rn FROM positions) WHERE rn = 1)"""


@report("heatmap", f"""
SELECT {cell('lat', 0.01, 4)} AS lat_cell, {cell('lon', 0.01, 4)} AS lon_cell, count(*) AS passages,
  {r('coalesce(avg(speed_kmh), 0)', 1)} AS avg_speed_kmh
FROM positions GROUP BY 1, 2 ORDER BY passages DESC, lat_cell, lon_cell LIMIT 500""")
def heatmap(v: Views):
    return fleet.heatmap(v.positions)


@report("trajectory_summary", f"""
WITH steps AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM positions
    WINDOW w AS (PARTITION BY courier_id ORDER BY ts, event_id)),
s AS (SELECT courier_id, count(*) AS points, {r('coalesce(sum(' + haversine('plat', 'plon', 'lat', 'lon') + '), 0)', 2)} AS distance_km,
    {r('avg(speed_kmh)', 1)} AS avg_speed_kmh, {r('max(speed_kmh)', 1)} AS max_speed_kmh FROM steps GROUP BY 1),
d AS (SELECT courier_id, status FROM (SELECT courier_id, status, row_number() OVER (PARTITION BY courier_id
    ORDER BY count(*) DESC, status) AS rn FROM positions GROUP BY 1, 2) WHERE rn = 1),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY courier_id ORDER BY ts, event_id) AS rn FROM positions) WHERE rn = 1),
z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY courier_id ORDER BY ts DESC, event_id DESC) AS rn FROM positions) WHERE rn = 1)
SELECT s.courier_id, points, distance_km, avg_speed_kmh, max_speed_kmh, d.status AS dominant_status,
  a.lat AS first_lat, a.lon AS first_lon, epoch_us(a.ts) AS first_ts_us, z.lat AS last_lat, z.lon AS last_lon,
  epoch_us(z.ts) AS last_ts_us
FROM s JOIN d USING (courier_id) JOIN a USING (courier_id) JOIN z USING (courier_id)""")
def trajectory_summary(v: Views):
    return fleet.trajectory_summary(v.positions, bucket_seconds=600)


@report("step_km", f"""
SELECT courier_id, event_id, {r(haversine('plat', 'plon', 'lat', 'lon'), 6)} AS step_km
FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM positions
  WINDOW w AS (PARTITION BY courier_id ORDER BY ts, event_id))""")
def step_km(v: Views):
    from courierworks.functions.num import round_half_up

    return fleet.step_km(v.positions, bucket_seconds=600).select(
        "courier_id", "event_id", round_half_up("step_km", 6).alias("step_km"))


@report("fleet_productivity", f"""
SELECT count(DISTINCT courier_id) AS couriers, {r('avg(speed_kmh)', 1)} AS avg_speed_kmh,
  {r("avg(CASE WHEN status = 'delivering' THEN 1.0::double ELSE 0.0::double END) * 100", 1)} AS delivering_pct,
  count(*) FILTER (WHERE speed_kmh > 65) AS speed_alerts,
  count(*) FILTER (WHERE speed_kmh < 1 AND status = 'delivering') AS suspicious_stops FROM positions""")
def fleet_productivity(v: Views):
    return fleet.fleet_productivity(v.positions)


@report("driver_scores", f"""
WITH steps AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM positions
    WINDOW w AS (PARTITION BY courier_id ORDER BY ts, event_id)),
s AS (SELECT courier_id, count(*) AS points, coalesce(sum({haversine('plat', 'plon', 'lat', 'lon')}), 0) AS km,
    avg(speed_kmh) AS v, max(speed_kmh) AS vmax, coalesce(stddev_samp(speed_kmh), 0) AS sd,
    count(*) FILTER (WHERE status = 'delivering') AS d, count(*) FILTER (WHERE status = 'available') AS a,
    count(*) FILTER (WHERE status = 'idle') AS i, count(*) FILTER (WHERE speed_kmh > 50) AS speeding,
    count(*) FILTER (WHERE speed_kmh < 1 AND status = 'delivering') AS stops FROM steps GROUP BY 1),
p AS (SELECT *, {r('d::double / points * 100', 1)} AS delivering_pct, {r('a::double / points * 100', 1)} AS available_pct,
    {r('i::double / points * 100', 1)} AS idle_pct FROM s),
q AS (SELECT *, least(40.0::double, {r('delivering_pct * 0.4::double', 1)}) AS productivity,
    {r('30.0::double - least(30.0::double, ' + r('speeding::double / points * 100 * 1.5::double', 1) + ')', 1)} AS safety,
    {r('20.0::double - least(20.0::double, ' + r('stops::double / points * 100 * 2.0::double', 1) + ')', 1)} AS reliability,
    {r('greatest(0.0::double, 10.0::double - idle_pct * 0.15::double)', 1)} AS activity FROM p),
t AS (SELECT *, {r('greatest(0.0::double, productivity + safety + reliability + activity)', 1)} AS score FROM q)
SELECT courier_id, points, score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C'
    WHEN score >= 40 THEN 'D' ELSE 'E' END AS grade, productivity, safety, reliability, activity,
  {r('km', 2)} AS distance_km, {r('v', 1)} AS avg_speed_kmh, {r('vmax', 1)} AS max_speed_kmh, {r('sd', 2)} AS speed_stddev,
  delivering_pct, available_pct, idle_pct, speeding, stops FROM t""")
def driver_scores(v: Views):
    return fleet.driver_scores(v.positions, bucket_seconds=600)


@report("latest_positions", f"""
WITH {LATEST} SELECT courier_id, event_id, epoch_us(ts) AS ts_us, lat, lon, status FROM latest""")
def latest_positions(v: Views):
    return fleet.latest_positions(v.positions).select(
        "courier_id", "event_id", F.unix_micros("ts").alias("ts_us"), "lat", "lon", "status")


@report("first_positions", """
SELECT courier_id, event_id, epoch_us(ts) AS ts_us FROM (SELECT *, row_number() OVER (PARTITION BY courier_id
  ORDER BY ts, event_id) AS rn FROM positions) WHERE rn = 1""")
def first_positions(v: Views):
    return first_by(v.positions, ["courier_id"], "ts", "event_id").select(
        "courier_id", "event_id", F.unix_micros("ts").alias("ts_us"))


def _share(top: str) -> str:
    return r(f"coalesce(({top}) * 100.0::double / nullif(couriers, 0), 0)", 1)


STATUS_SQL = f"""{LATEST},
b AS (SELECT s, {BUCKET.format('s')} AS g FROM (SELECT {CANONICAL.format('status')} AS s FROM latest)),
c AS (SELECT count(*) AS couriers, {', '.join(f"count(*) FILTER (WHERE g = '{g}') AS {g}" for g in
    ['available', 'delivering', 'pickup', 'repositioning', 'idle', 'unknown'])},
    {', '.join(f"count(*) FILTER (WHERE s = '{s}') AS {s}" for s in
    ['pickup_assigned', 'pickup_en_route', 'pickup_arrived'])} FROM b),
fleet AS (SELECT *, {_share('delivering')} AS utilisation_pct, {_share('delivering + pickup + repositioning')} AS engagement_pct,
  {_share('pickup')} AS pickup_pct, {_share('repositioning')} AS repositioning_pct,
  {_share('available')} AS availability_pct, {_share('idle')} AS idle_pct FROM c)"""


@report("fleet_status", f"WITH {STATUS_SQL} SELECT * FROM fleet")
def fleet_status(v: Views):
    return fleet.fleet_status(fleet.latest_positions(v.positions))


@report("low_battery", f"""
WITH {LATEST} SELECT courier_id, {r('battery_pct', 1)} AS battery_pct, {CANONICAL.format('status')} AS status FROM latest
WHERE battery_pct > 0 AND battery_pct < 20 ORDER BY 2, 1 LIMIT 5""")
def low_battery(v: Views):
    return fleet.low_battery(fleet.latest_positions(v.positions))


def _coverage_sql(demand: str, resolution: float = 0.02) -> str:
    i, j = f"round(lat / {resolution}::double, 0)", f"round(lon / {resolution}::double, 0)"
    return f"""d AS ({demand.format(i=i, j=j)}),
s AS (SELECT {i} AS i, {j} AS j, count(*) AS drivers FROM latest GROUP BY 1, 2),
n AS (SELECT i, j, demand, coalesce(drivers, 0) AS drivers, demand / (SELECT max(demand)::double FROM d) AS ds,
  coalesce(drivers, 0) / (SELECT greatest(max(drivers), 1)::double FROM s) AS ss FROM d LEFT JOIN s USING (i, j))
SELECT {r(f'i * {resolution}::double', 4)} AS lat_cell, {r(f'j * {resolution}::double', 4)} AS lon_cell, demand, drivers, gap AS coverage_gap,
  CASE WHEN gap < -0.15 THEN 'over' WHEN gap > 0.20 THEN 'under' ELSE 'balanced' END AS state
FROM (SELECT *, {r('ds - ss', 3)} AS gap FROM n WHERE ds >= 0.1)"""


@report("zone_coverage", f"""
WITH {LATEST}, {_coverage_sql('SELECT {i} AS i, {j} AS j, count(*) AS demand FROM positions GROUP BY 1, 2')}""")
def zone_coverage(v: Views):
    return fleet.zone_coverage(v.positions, fleet.latest_positions(v.positions))


@report("demand_trend", f"""
WITH c AS (SELECT {cell('lat', 0.02, 4)} AS lat_cell, {cell('lon', 0.02, 4)} AS lon_cell,
    count(*) FILTER (WHERE ts >= {REF_SQL} - INTERVAL 15 MINUTE) AS recent_count,
    {r(f"avg(speed_kmh) FILTER (WHERE ts >= {REF_SQL} - INTERVAL 15 MINUTE)", 1)} AS recent_speed_kmh,
    count(*) FILTER (WHERE ts < {REF_SQL} - INTERVAL 15 MINUTE) AS b
  FROM positions WHERE ts BETWEEN {REF_SQL} - INTERVAL 60 MINUTE AND {REF_SQL} GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN b > 0 THEN b / 3.0::double ELSE recent_count::double END AS base FROM c WHERE recent_count >= 5),
u AS (SELECT *, {r('(recent_count - base) / base * 100', 1)} AS trend_pct FROM t)
SELECT lat_cell, lon_cell, recent_count, recent_speed_kmh, {r('base', 1)} AS baseline_count, trend_pct,
  CASE WHEN trend_pct > 15 THEN 'rising' WHEN trend_pct < -15 THEN 'falling' ELSE 'stable' END AS signal,
  CASE WHEN trend_pct > 15 THEN 'send_courier' WHEN trend_pct < -15 THEN 'redeploy' ELSE 'keep_coverage' END AS action
FROM u ORDER BY trend_pct DESC, lat_cell, lon_cell LIMIT 30""")
def demand_trend(v: Views):
    return fleet.demand_trend(v.positions, ref_ts())


@report("surge", f"""
WITH {LATEST},
d AS (SELECT z.zone_id, count(*) FILTER (WHERE p.ts >= {REF_SQL} - INTERVAL 15 MINUTE) AS recent,
    count(*) FILTER (WHERE p.ts < {REF_SQL} - INTERVAL 15 MINUTE) AS earlier
  FROM zones z JOIN positions p ON p.lat BETWEEN z.lat - 2.0::double / 111.32::double AND z.lat + 2.0::double / 111.32::double
   AND p.lon BETWEEN z.lon - 2.0::double / (111.32::double * greatest(cos(radians(z.lat)), 0.01::double))
   AND z.lon + 2.0::double / (111.32::double * greatest(cos(radians(z.lat)), 0.01::double))
  WHERE p.ts BETWEEN {REF_SQL} - INTERVAL 60 MINUTE AND {REF_SQL} GROUP BY 1),
s AS (SELECT z.zone_id, count(*) AS couriers, count(*) FILTER (WHERE {CANONICAL.format('l.status')} = 'available') AS available
  FROM zones z JOIN latest l ON {haversine('z.lat', 'z.lon', 'l.lat', 'l.lon')} <= 2.0 GROUP BY 1),
j AS (SELECT z.zone_id AS centre_id, coalesce(recent, 0) AS recent, coalesce(earlier, 0) AS earlier,
    coalesce(couriers, 0) AS couriers, coalesce(available, 0) AS available
  FROM zones z LEFT JOIN d USING (zone_id) LEFT JOIN s USING (zone_id)),
k AS (SELECT *, CASE WHEN earlier / 4.0::double >= 1 THEN
      {r('least(greatest(recent / (earlier / 4.0::double) - 1, 0), 2) / 2', 3)} WHEN recent > 5 THEN 0.3::double ELSE 0.0::double END AS demand_pressure,
    CASE WHEN couriers = 0 THEN 1.0::double ELSE {r('1.0::double - available / couriers::double', 3)} END AS supply_scarcity,
    CASE WHEN couriers = 0 THEN 'desert' WHEN available / couriers::double >= 0.5 THEN 'plenty' WHEN available / couriers::double >= 0.25 THEN 'moderate'
      WHEN available > 0 THEN 'tight' ELSE 'saturated' END AS supply_label FROM j),
m AS (SELECT *, {r('greatest(1.0::double, least(1.0::double + demand_pressure + 0.8::double * supply_scarcity, 3.0::double))', 2)} AS multiplier FROM k)
SELECT *, {r('5.0::double * multiplier', 2)} AS price_eur, CASE WHEN multiplier >= 2 THEN 'extreme' WHEN multiplier >= 1.5 THEN 'high'
  WHEN multiplier >= 1.2 THEN 'moderate' ELSE 'normal' END AS level FROM m""")
def surge(v: Views):
    centres = v.zones.select(F.col("zone_id").alias("centre_id"), "lat", "lon")
    return fleet.surge(v.positions, fleet.latest_positions(v.positions), centres, ref_ts())


@report("speed_baselines", f"""
SELECT {cell('lat', 0.02, 3)} AS lat_cell, {cell('lon', 0.02, 3)} AS lon_cell, {r('avg(speed_kmh)', 1)} AS avg_speed_kmh,
  {r('stddev_samp(speed_kmh)', 1)} AS std_speed_kmh, count(*) AS points FROM positions
WHERE ts BETWEEN {REF_SQL} - INTERVAL 2 HOUR AND {REF_SQL} GROUP BY 1, 2 HAVING count(*) >= 20""")
def speed_baselines(v: Views):
    return fleet.speed_baselines(v.positions, ref_ts())


@report("zone_hour_profile", f"""
SELECT {cell('lat', 0.01, 3)} AS lat_cell, {cell('lon', 0.01, 3)} AS lon_cell, hour(ts)::bigint AS hour,
  dayofweek(ts)::bigint AS weekday, count(*) AS points, {r('avg(speed_kmh)', 1)} AS avg_speed_kmh,
  count(*) FILTER (WHERE status = 'delivering') AS delivering FROM positions GROUP BY 1, 2, 3, 4""")
def zone_hour_profile(v: Views):
    return fleet.zone_hour_profile(v.positions)


@report("nearby_couriers", f"""
WITH {LATEST},
h AS (SELECT z.zone_id, l.courier_id, l.status, {haversine('z.lat', 'z.lon', 'l.lat', 'l.lon')} AS km FROM zones z, latest l),
k AS (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY km, courier_id) AS rank FROM h WHERE km <= 5.0)
SELECT zone_id, courier_id, status, {r('km', 6)} AS distance_km, rank FROM k WHERE rank <= 10 AND status IN ('available', 'idle')""")
def nearby_couriers(v: Views):
    from courierworks.functions.num import round_half_up

    latest = fleet.latest_positions(v.positions).select("courier_id", "status", "lat", "lon")
    found = spatial.nearby(latest, v.zones.select("zone_id", "lat", "lon"), "zone_id", 5.0, 10,
                           statuses=["available", "idle"])
    return found.select("zone_id", "courier_id", "status", round_half_up("distance_km", 6).alias("distance_km"),
                        F.col("rank").cast("long").alias("rank"))


@report("nearest_zone", f"""
WITH {LATEST},
d AS (SELECT courier_id, zone_id, {haversine('l.lat', 'l.lon', 'z.lat', 'z.lon')} AS km FROM latest l, zones z)
SELECT courier_id, zone_id, {r('km', 6)} AS zone_km FROM (SELECT *, row_number() OVER (PARTITION BY courier_id
  ORDER BY km, zone_id) AS rn FROM d) WHERE rn = 1""")
def nearest_zone(v: Views):
    from courierworks.functions.num import round_half_up

    latest = stage(fleet.latest_positions(v.positions).select("courier_id", "lat", "lon"))
    return spatial.nearest_zone(latest, v.zones, "courier_id").select(
        "courier_id", "zone_id", round_half_up("zone_km", 6).alias("zone_km"))


@report("count_within", f"""
SELECT z.zone_id, count(p.courier_id) AS n FROM zones z LEFT JOIN positions p
  ON {haversine('z.lat', 'z.lon', 'p.lat', 'p.lon')} <= 1.5 GROUP BY 1""")
def count_within(v: Views):
    return spatial.count_within(v.zones, v.positions, 1.5, "zone_id")


@report("max_normalise", f"""
WITH c AS (SELECT {cell('lat', 0.02, 4)} AS lat_cell, {cell('lon', 0.02, 4)} AS lon_cell, count(*) AS passages FROM positions GROUP BY 1, 2)
SELECT lat_cell, lon_cell, passages, {r('passages / (SELECT max(passages) FROM c)::double', 6)} AS share FROM c""")
def max_normalise(v: Views):
    from courierworks.functions.num import round_half_up

    cells = fleet.heatmap(v.positions, 0.02, top=None).drop("avg_speed_kmh")
    return fleet.max_normalise(cells, "passages", "share").withColumn("share", round_half_up("share", 6))
