"""Reports over GPS plausibility, live state and recent tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from courierworks.catalog.fleet_reports import BUCKET, CANONICAL, STATUS_SQL
from courierworks.catalog.registry import haversine, r, report
from courierworks.functions.num import round_half_up
from courierworks.functions.status import with_route, route_source
from courierworks.operators import fleet, guardrails, tracks
from courierworks.sources.adapters import REF_US, Views, ref_ts

MOVING = "('delivering', 'pickup_assigned', 'pickup_en_route', 'pickup_arrived', 'repositioning')"
GUARD_SQL = f"""g0 AS (SELECT courier_id, event_id, ts, lat, lon, speed_kmh, status, source_platform,
    row_number() OVER (PARTITION BY courier_id ORDER BY ts, event_id) AS n FROM positions),
g AS (
  SELECT courier_id, n, event_id, NULL::varchar AS reason, 0.0::double AS delta_s, 0.0::double AS km, 0.0::double AS kmh, 0::bigint AS fz,
    ts AS pt, lat AS alat, lon AS alon, NULL::timestamp AS bt, NULL::double AS blat, NULL::double AS blon, 0::bigint AS fc FROM g0 WHERE n = 1
  UNION ALL
  SELECT courier_id, n, event_id, reason, delta_s, CASE WHEN reason = 'non_monotonic_ts' THEN 0 ELSE km END,
    CASE WHEN reason IN ('non_monotonic_ts', 'jump_too_large') THEN 0 ELSE kmh END,
    CASE WHEN reason IS NULL OR reason = 'gps_frozen' THEN nf ELSE 0 END,
    CASE WHEN reason IS NULL THEN ts ELSE pt END, CASE WHEN reason IS NULL THEN lat ELSE alat END, CASE WHEN reason IS NULL THEN lon ELSE alon END,
    CASE WHEN reason IS NULL THEN pt ELSE bt END, CASE WHEN reason IS NULL THEN alat ELSE blat END, CASE WHEN reason IS NULL THEN alon ELSE blon END,
    CASE WHEN reason IS NULL THEN nf ELSE fc END
  FROM (SELECT *, CASE WHEN delta_s <= 0 THEN 'non_monotonic_ts' WHEN km > 4.0 THEN 'jump_too_large' WHEN kmh > 120.0 THEN 'implied_speed_too_high'
      WHEN bt IS NOT NULL AND epoch_us(ts) - epoch_us(bt) <= 90000000 AND {haversine('blat', 'blon', 'alat', 'alon')} >= 0.8
        AND {haversine('blat', 'blon', 'lat', 'lon')} <= 0.05 THEN 'implausible_backtrack'
      WHEN nf >= 4 THEN 'gps_frozen' END AS reason
    FROM (SELECT *, km / nullif(delta_s / 3600.0::double, 0) AS kmh,
        CASE WHEN km * 1000 <= 8.0 AND status IN {MOVING} AND speed_kmh >= 2.0 THEN fc + 1 ELSE 0 END AS nf
      FROM (SELECT q.courier_id, q.n, q.event_id, q.ts, q.lat, q.lon, q.speed_kmh, q.status, g.pt, g.alat, g.alon, g.bt, g.blat, g.blon, g.fc,
          (epoch_us(q.ts) - epoch_us(g.pt)) / 1000000.0::double AS delta_s, {haversine('g.alat', 'g.alon', 'q.lat', 'q.lon')} AS km
        FROM g JOIN g0 q ON q.courier_id = g.courier_id AND q.n = g.n + 1)))
)"""


@report("gps_guardrails", f"""WITH RECURSIVE {GUARD_SQL} SELECT courier_id, event_id, reason, {r('delta_s', 3)} AS delta_s,
  {r('km', 4)} AS distance_km, {r('kmh', 2)} AS implied_speed_kmh, fz AS frozen_count FROM g""")
def gps_guardrails(v: Views):
    verdicts = guardrails.gps_guardrails(v.positions)
    return verdicts.select(
        "courier_id", "event_id", "reason", round_half_up("delta_s", 3).alias("delta_s"),
        round_half_up("distance_km", 4).alias("distance_km"),
        round_half_up("implied_speed_kmh", 2).alias("implied_speed_kmh"), "frozen_count")


@report("live_state", f"""WITH RECURSIVE {GUARD_SQL},
c AS (SELECT g.courier_id, g.event_id, g.reason, g.fz, q.ts, q.lat, q.lon, q.source_platform FROM g JOIN g0 q USING (courier_id, event_id)),
ok AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY courier_id ORDER BY ts DESC, event_id) AS rn FROM c WHERE reason IS NULL) WHERE rn = 1),
bad AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY courier_id ORDER BY ts DESC, event_id DESC) AS rn FROM c WHERE reason IS NOT NULL) WHERE rn = 1)
SELECT ok.courier_id, ok.event_id, ok.lat, ok.lon, CASE WHEN bad.ts >= ok.ts THEN 'anomalous' ELSE 'ok' END AS anomaly_state,
  CASE WHEN bad.ts >= ok.ts THEN bad.reason WHEN ok.source_platform LIKE '%route=hold%' THEN 'routing_hold' ELSE '' END AS stale_reason,
  ok.fz AS frozen_count FROM ok LEFT JOIN bad USING (courier_id)""")
def live_state(v: Views):
    state = guardrails.live_state(guardrails.checked_positions(v.positions))
    return state.select("courier_id", "event_id", "lat", "lon", "anomaly_state", "stale_reason", "frozen_count")


LATEST = """latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY courier_id
  ORDER BY ts DESC, event_id) AS rn FROM positions) WHERE rn = 1)"""


@report("purge_ghosts", f"""WITH {LATEST} SELECT courier_id, epoch_us(ts) AS ts_us FROM latest
WHERE epoch_us(ts) >= {REF_US} - 90000000""")
def purge_ghosts(v: Views):
    return guardrails.purge_ghosts(fleet.latest_positions(v.positions), ref_ts(), 90.0).select(
        "courier_id", F.unix_micros("ts").alias("ts_us"))


TRACK = f"""track AS (SELECT courier_id, event_id, ts, lat, lon, speed_kmh, {CANONICAL.format('status')} AS status,
    coalesce(nullif(regexp_extract(lower(source_platform), '(^|\\|)route=([^|]*)', 2), ''), 'unknown') AS route_source
  FROM (SELECT *, row_number() OVER (PARTITION BY courier_id ORDER BY ts DESC, event_id DESC) AS rn FROM positions) WHERE rn <= 64)"""


def streaks(source: str, name: str) -> str:
    """Text of the longest frozen run per courier of a track."""
    return f"""{name}_m AS (SELECT *, {r('lat', 5)} AS lat5, {r('lon', 5)} AS lon5, status IN ('delivering', 'repositioning') AS busy FROM {source}),
{name}_n AS (SELECT *, CASE WHEN busy AND coalesce(lag(busy) OVER w AND lag(lat5) OVER w = lat5 AND lag(lon5) OVER w = lon5, false) THEN 0 ELSE 1 END AS isnew
  FROM {name}_m WINDOW w AS (PARTITION BY courier_id ORDER BY ts, event_id)),
{name}_r AS (SELECT *, sum(isnew) OVER (PARTITION BY courier_id ORDER BY ts, event_id) AS run FROM {name}_n),
{name}_g AS (SELECT courier_id, run, min(lat5) AS lat, min(lon5) AS lon, count(*) AS repetitions, min(ts) AS a, max(ts) AS b FROM {name}_r WHERE busy GROUP BY 1, 2),
{name}_d AS (SELECT *, cast({r('(epoch_us(b) - epoch_us(a)) / 1000000.0::double', 0)} AS bigint) AS duration_s FROM {name}_g
  WHERE repetitions >= 12 AND epoch_us(b) - epoch_us(a) >= 180000000),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY courier_id ORDER BY repetitions DESC, duration_s DESC, a) AS rn FROM {name}_d) WHERE rn = 1)"""


def stationary(source: str, name: str, speed: float) -> str:
    """Text of the final slow delivering run per courier of a track."""
    return f"""{name}_o AS (SELECT *, row_number() OVER (PARTITION BY courier_id ORDER BY ts DESC, event_id DESC) AS back,
    (status = 'delivering' AND speed_kmh <= {speed}) AS slow FROM {source}),
{name}_s AS (SELECT courier_id, min(CASE WHEN NOT slow THEN back END) AS stop FROM {name}_o GROUP BY 1),
{name} AS (SELECT courier_id, coalesce((epoch_us(max(ts) FILTER (WHERE stop IS NULL OR back < stop)) - epoch_us(min(ts) FILTER (WHERE stop IS NULL OR back < stop)))
    / 1000000.0::double, 0) AS stationary_s, count(*) FILTER (WHERE stop IS NULL OR back < stop) AS samples,
    max(CASE WHEN back = 1 THEN route_source END) AS last_route, max(CASE WHEN back = 1 THEN status END) AS last_status,
    max(CASE WHEN back = 1 THEN speed_kmh END) AS last_speed FROM {name}_o JOIN {name}_s USING (courier_id) GROUP BY 1)"""


@report("recent_track", f"WITH {TRACK} SELECT courier_id, event_id, status, route_source FROM track")
def recent_track(v: Views):
    return tracks.recent_track(v.positions).select("courier_id", "event_id", "status", "route_source")


@report("recent_track_arrays", f"WITH {TRACK} SELECT courier_id, count(*) AS points, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM track GROUP BY 1")
def recent_track_arrays(v: Views):
    arrays = tracks.track_arrays(tracks.recent_track(v.positions))
    return arrays.select("courier_id", F.size("track").cast("long").alias("points"),
                         F.unix_micros(F.element_at("track", 1)["ts"]).alias("first_us"),
                         F.unix_micros(F.element_at("track", -1)["ts"]).alias("last_us"))


@report("frozen_streaks", f"""WITH {TRACK}, {streaks('track', 's')} SELECT courier_id, lat, lon, repetitions, duration_s, epoch_us(a) AS start_us, epoch_us(b) AS end_us FROM s""")
def frozen_streaks(v: Views):
    return tracks.frozen_streaks(tracks.recent_track(v.positions)).select(
        "courier_id", "lat", "lon", "repetitions", "duration_s", F.unix_micros("start_ts").alias("start_us"),
        F.unix_micros("end_ts").alias("end_us"))


@report("gps_frozen_report", f"""WITH {TRACK}, t AS (SELECT * FROM track WHERE epoch_us(ts) BETWEEN {REF_US} - 1800000000 AND {REF_US}), {streaks('t', 's')}
SELECT courier_id, repetitions, duration_s FROM s""")
def gps_frozen_report(v: Views):
    return tracks.gps_frozen(tracks.recent_track(v.positions), ref_ts(), 30).select("courier_id", "repetitions", "duration_s")


@report("trailing_stationary", f"WITH {TRACK}, {stationary('track', 's', 1.5)} SELECT courier_id, {r('stationary_s', 6)} AS stationary_s, samples FROM s")
def trailing_stationary(v: Views):
    return tracks.trailing_stationary(tracks.recent_track(v.positions)).select(
        "courier_id", round_half_up("stationary_s", 6).alias("stationary_s"), "samples")


@report("idle_suspects", f"""WITH {TRACK}, {streaks('track', 'f')}, {stationary('track', 's', 1.5)}
SELECT s.courier_id, {r('last_speed', 1)} AS speed_kmh, cast({r('stationary_s', 0)} AS bigint) AS stationary_s, {r('stationary_s / 60', 1)} AS stationary_min,
  samples, CASE WHEN f.courier_id IS NOT NULL THEN 'gps_frozen' ELSE 'routing_hold' END AS reason
FROM s LEFT JOIN f USING (courier_id) WHERE stationary_s >= 120 AND last_status = 'delivering' AND (f.courier_id IS NOT NULL OR last_route = 'hold')""")
def idle_suspects(v: Views):
    return tracks.idle_suspects(tracks.recent_track(v.positions))


ANOMALY_SQL = f"""WITH {TRACK}, w AS (SELECT *, epoch_us(ts) >= {REF_US} - 1200000000 AS now FROM track WHERE epoch_us(ts) BETWEEN {REF_US} - 2400000000 AND {REF_US}),
n AS (SELECT * FROM w WHERE now), {streaks('n', 'f')}, {stationary('n', 's', 2.0)},
m AS (SELECT *, status IN {MOVING} AND route_source <> 'hold' AND speed_kmh BETWEEN 0 AND 90 AS trusted FROM w),
a AS (SELECT courier_id, count(*) FILTER (WHERE now) AS points, coalesce(max(speed_kmh) FILTER (WHERE trusted AND now), 0) AS vmax,
    coalesce(avg(speed_kmh) FILTER (WHERE trusted AND now), 0) AS vavg, count(*) FILTER (WHERE trusted AND now AND speed_kmh > 65) AS ex,
    count(*) FILTER (WHERE trusted AND now) AS nr, count(*) FILTER (WHERE trusted AND NOT now) AS nb,
    avg(speed_kmh) FILTER (WHERE trusted AND NOT now) AS mb, stddev_pop(speed_kmh) FILTER (WHERE trusted AND NOT now) AS sb FROM m GROUP BY 1),
j AS (SELECT a.*, CASE WHEN s.stationary_s >= 120 AND (f.courier_id IS NOT NULL OR s.last_route = 'hold') THEN s.stationary_s ELSE 0 END AS still,
    CASE WHEN s.stationary_s >= 120 AND f.courier_id IS NOT NULL THEN true ELSE false END AS frozen,
    CASE WHEN nb >= 4 AND nr >= 2 AND sb >= 2 THEN abs(vavg - mb) / sb ELSE 0 END AS z
  FROM a LEFT JOIN s USING (courier_id) LEFT JOIN f USING (courier_id) WHERE points > 0),
k AS (SELECT *, concat_ws(',', CASE WHEN ex >= 3 THEN 'speeding' END, CASE WHEN still >= 120 THEN 'suspicious_standstill' END,
    CASE WHEN z > 0.5 THEN 'behaviour_deviation' END) AS kinds FROM j)
SELECT courier_id, CASE WHEN still >= 120 OR (ex >= 3 AND vmax > 80) THEN 'critical' ELSE 'warning' END AS level, kinds,
  {r('vmax', 1)} AS speed_max_kmh, {r('vavg', 1)} AS speed_mean_kmh, {r('z', 2)} AS z_score, cast({r('still', 0)} AS bigint) AS stationary_s FROM k WHERE kinds <> ''"""


@report("detect_anomalies", ANOMALY_SQL)
def detect_anomalies(v: Views):
    # Twenty minutes and a low z limit, so that the squeezed test hour has all three kinds.
    found = tracks.detect_anomalies(tracks.recent_track(v.positions), ref_ts(), 20, z_limit=0.5)
    return found.drop("frozen", "last_ts").withColumn("kinds", F.array_join("kinds", ","))


HEALTH_SQL = f"""WITH {STATUS_SQL}, {TRACK}, {streaks('track', 'f')}, {stationary('track', 's', 1.5)},
i AS (SELECT count(*) AS blocked FROM s LEFT JOIN f USING (courier_id) WHERE stationary_s >= 120 AND last_status = 'delivering'
  AND (f.courier_id IS NOT NULL OR last_route = 'hold')),
lb AS (SELECT count(*) AS low_battery FROM latest WHERE battery_pct > 0 AND battery_pct < 20),
p AS (SELECT count(*) FILTER (WHERE speed_kmh > 65) AS speed_alerts FROM positions),
x AS (SELECT utilisation_pct, idle_pct, blocked, speed_alerts, low_battery, greatest(0, 100 - CASE WHEN utilisation_pct < 50 THEN 20 ELSE 0 END
  - CASE WHEN idle_pct > 20 THEN 15 ELSE 0 END - CASE WHEN blocked > 5 THEN 15 ELSE 0 END - CASE WHEN speed_alerts > 10 THEN 10 ELSE 0 END
  - CASE WHEN low_battery > 10 THEN 10 ELSE 0 END)::bigint AS score FROM fleet, i, lb, p)
SELECT score, utilisation_pct, idle_pct, blocked, speed_alerts, low_battery,
  coalesce(nullif(concat_ws(',', CASE WHEN utilisation_pct < 50 THEN 'raise_utilisation' END, CASE WHEN idle_pct > 20 THEN 'redeploy_idle' END,
    CASE WHEN blocked > 3 THEN 'contact_blocked' END, CASE WHEN speed_alerts > 5 THEN 'review_speeding' END,
    CASE WHEN low_battery > 5 THEN 'plan_charging' END), ''), 'all_normal') AS actions,
  CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 65 THEN 'good' WHEN score >= 45 THEN 'attention' ELSE 'critical' END AS level FROM x"""


@report("fleet_health", HEALTH_SQL)
def fleet_health(v: Views):
    latest = fleet.latest_positions(v.positions)
    health = fleet.fleet_health(fleet.fleet_status(latest), fleet.fleet_productivity(v.positions),
                                tracks.idle_suspects(tracks.recent_track(v.positions)), fleet.low_battery(latest, top=None))
    return health.withColumn("actions", F.array_join("actions", ","))


MERGE_SQL = f"""WITH {TRACK}, {LATEST},
h AS (SELECT courier_id, event_id, ts, lat, lon, 0 AS part FROM (SELECT *, row_number() OVER (PARTITION BY courier_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM positions WHERE epoch_us(ts) < {REF_US} - 1200000000) WHERE rn <= 60),
u AS (SELECT * FROM h UNION ALL SELECT courier_id, event_id, ts, lat, lon, 1 FROM track UNION ALL SELECT courier_id, event_id, ts, lat, lon, 2 FROM latest),
k AS (SELECT *, max(ts) OVER (PARTITION BY courier_id ORDER BY part, ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM u),
c AS (SELECT *, lead(ts) OVER w AS nts, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon FROM k WHERE newest IS NULL OR ts >= newest
  WINDOW w AS (PARTITION BY courier_id ORDER BY part, ts, event_id)),
e AS (SELECT *, row_number() OVER (PARTITION BY courier_id ORDER BY ts DESC, part DESC, event_id DESC) AS rn FROM c
  WHERE NOT coalesce((abs(nlat - lat) < 1e-6 AND abs(nlon - lon) < 1e-6) OR nts = ts, false))
SELECT courier_id, event_id, epoch_us(ts) AS ts_us FROM e WHERE rn <= 60"""


@report("merge_trails", MERGE_SQL)
def merge_trails(v: Views):
    old = v.positions.where(F.unix_micros("ts") < F.lit(REF_US - 1200000000))
    history = tracks.recent_track(old, 60)
    trail = tracks.merge_trails([history, tracks.recent_track(v.positions), fleet.latest_positions(v.positions)], 60)
    return trail.select("courier_id", "event_id", F.unix_micros("ts").alias("ts_us"))


@report("focus_positions", f"""WITH {LATEST} SELECT courier_id, {r(f'greatest(({REF_US} - epoch_us(ts)) / 1000000.0::double, 0)', 3)} AS age_s,
  ({REF_US} - epoch_us(ts)) / 1000000.0::double > 30 AS stale FROM latest""")
def focus_positions(v: Views):
    return tracks.focus_positions(fleet.latest_positions(v.positions), ref_ts()).select(
        "courier_id", round_half_up("age_s", 3).alias("age_s"), "stale")


@report("history_or_live", f"""WITH {LATEST}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY courier_id ORDER BY ts DESC, event_id) AS rn FROM positions
  WHERE epoch_us(ts) < {REF_US} - 3300000000) WHERE rn = 1)
SELECT coalesce(o.courier_id, l.courier_id) AS courier_id, CASE WHEN o.courier_id IS NULL THEN l.event_id ELSE o.event_id END AS event_id,
  CASE WHEN o.courier_id IS NULL THEN 'live' ELSE 'history' END AS source, o.courier_id IS NULL AS degraded FROM latest l FULL JOIN o USING (courier_id)""")
def history_or_live(v: Views):
    old = v.positions.where(F.unix_micros("ts") < F.lit(REF_US - 3300000000))
    return tracks.stale_or_live(fleet.latest_positions(old).select("courier_id", "event_id"),
                                fleet.latest_positions(v.positions).select("courier_id", "event_id"))


@report("reference_time", "SELECT epoch_us(max(ts)) AS ref_us FROM positions")
def reference_time(v: Views):
    return tracks.reference_time(None, None, v.positions, tracks.recent_track(v.positions)).select(
        F.unix_micros("ref_ts").alias("ref_us"))


@report("resample_track", f"""WITH {TRACK},
l AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM track WINDOW w AS (PARTITION BY courier_id ORDER BY ts, event_id)),
d AS (SELECT *, coalesce({haversine('lat', 'lon', 'lat2', 'lon2')}, 0) AS leg FROM l),
c AS (SELECT *, coalesce(sum(leg) OVER (PARTITION BY courier_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  greatest(ceil(leg / 0.5::double), 1)::int AS parts FROM d),
x AS (SELECT *, unnest(range(0, parts)) AS i FROM c)
SELECT courier_id, event_id, i::bigint AS i, {r('CASE WHEN lat2 IS NULL THEN lat ELSE lat + (lat2 - lat) * (i::double / parts) END', 5)} AS lat,
  {r('before + leg * CASE WHEN lat2 IS NULL THEN 0 ELSE i::double / parts END', 5)} AS km FROM x""")
def resample_track(v: Views):
    return tracks.resample_track(tracks.recent_track(v.positions), 0.5).select(
        "courier_id", "event_id", F.col("i").cast("long").alias("i"), round_half_up("lat", 5).alias("lat"),
        round_half_up("km", 5).alias("km"))


@report("status_and_route", f"""SELECT event_id, {CANONICAL.format('status')} AS canonical, {BUCKET.format(f"({CANONICAL.format('status')})")} AS bucket,
  regexp_extract(source_platform, 'route=([^|]*)', 1) AS route, split_part(source_platform, '|', 1) || '|route=hold' AS held FROM positions""")
def status_and_route(v: Views):
    from courierworks.functions.status import canonical_status, status_bucket

    return v.positions.select("event_id", canonical_status("status").alias("canonical"), status_bucket("status").alias("bucket"),
                              route_source("source_platform").alias("route"),
                              with_route("source_platform", F.lit("hold")).alias("held"))
