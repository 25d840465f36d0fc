"""Reports over raw messages, lakes and ride records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierworks.catalog.offer_reports import clamp
from courierworks.catalog.registry import haversine, r, report
from courierworks.functions.num import round_half_up
from courierworks.operators import fleet
from courierworks.session import new_folder
from courierworks.sources import ingest, lake, trips
from courierworks.sources.adapters import REF_US, Views, ref_ts
from courierworks.sources.events import normalize_events


def raw_messages(v: Views) -> DataFrame:
    """Positions as JSON messages; every 50th is cut short, every 70th has an impossible latitude."""
    lat = F.when(F.col("event_id") % 70 == 0, F.lit(123.0)).otherwise(F.col("lat"))
    body = F.to_json(F.struct(F.col("courier_id").alias("livreur_id"), lat.alias("lat"), "lon", "speed_kmh", "heading_deg", "status", "battery_pct",
                              F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp")))
    cut = F.when(F.col("event_id") % 50 == 0, F.substring(body, 1, 40)).otherwise(body)
    return v.positions.select("event_id", cut.alias("value"))


@report("parsed_positions", f"""SELECT event_id, courier_id, lat, lon, speed_kmh, status, battery_pct, epoch_us(ts) AS ts_us FROM positions WHERE event_id % 50 <> 0 AND event_id % 70 <> 0""")
def parsed_positions(v: Views):
    good, _ = ingest.validate_positions(ingest.parse_positions(raw_messages(v)))
    return good.select("event_id", "courier_id", "lat", "lon", "speed_kmh", "status", "battery_pct", F.unix_micros("ts").alias("ts_us"))


def letters(v: Views) -> DataFrame:
    _, rejects = ingest.validate_positions(ingest.parse_positions(raw_messages(v)))
    return ingest.dead_letters(rejects, "livreurs-gps", ref_ts())


@report("dlq_stats", """SELECT '2024-01-01' AS day, 'livreurs-gps' AS topic, CASE WHEN event_id % 50 = 0 THEN 'malformed_json' ELSE 'lat_range' END AS reason, count(*) AS rejects
FROM positions WHERE event_id % 50 = 0 OR event_id % 70 = 0 GROUP BY 3""")
def dlq_stats(v: Views):
    return ingest.dlq_stats(letters(v))


@report("dlq_peek", f"""SELECT 'livreurs-gps' AS topic, CASE WHEN event_id % 50 = 0 THEN 'malformed_json' ELSE 'lat_range' END AS reason, lower(hex(encode(
  CASE WHEN event_id % 50 = 0 THEN substr(body, 1, 40) ELSE body END))) AS raw_hex
FROM (SELECT event_id, '{{"livreur_id":"' || courier_id || '","lat":' || CASE WHEN event_id % 70 = 0 THEN '123.0' ELSE lat::VARCHAR END || ',"lon":-73.9,"status":"' || status || '","timestamp":"'
  || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '"}}' AS body FROM positions) WHERE event_id % 50 = 0 OR event_id % 70 = 0 ORDER BY reason, raw_hex LIMIT 20""")
def dlq_peek(v: Views):
    """The newest 20 letters among those of all messages, in a short layout whose numbers print alike in both engines."""
    lat = F.when(F.col("event_id") % 70 == 0, F.lit(123.0)).otherwise(F.col("lat"))
    body = F.to_json(F.struct(F.col("courier_id").alias("livreur_id"), lat.alias("lat"), F.lit(-73.9).alias("lon"), "status", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")))
    cut = F.when(F.col("event_id") % 50 == 0, F.substring(body, 1, 40)).otherwise(body)
    _, rejects = ingest.validate_positions(ingest.parse_positions(v.positions.select(cut.alias("value"))))
    return ingest.dlq_peek(ingest.dead_letters(rejects, "livreurs-gps", ref_ts()), 20).select("topic", "reason", "raw_hex")


@report("ingest_normalized", f"""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN {REF_US} ELSE epoch_us(ts) END AS ts_us, 8.0::double AS accuracy_m, 100.0::double AS battery_pct, 'courier.position.v1' AS event_type FROM positions""")
def ingest_normalized(v: Views):
    text = F.when(F.col("event_id") % 9 == 0, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    rows = v.positions.select("event_id", "courier_id", "lat", "lon", text.alias("ts"))
    return ingest.normalize_ingest(rows, ref_ts()).select("event_id", F.unix_micros("ts").alias("ts_us"), "accuracy_m", "battery_pct", "event_type")


@report("rate_limited", """SELECT event_id, row_number() OVER (PARTITION BY courier_id, epoch_us(ts) // 60000000 ORDER BY ts, event_id) > 2 AS refused FROM positions""")
def rate_limited(v: Views):
    return ingest.rate_limit_flag(v.positions, "courier_id", "ts", "event_id", 2).select("event_id", "refused")


def _folder(v: Views, name: str) -> str:
    return new_folder(v.spark, name)


@report("position_lake_window", f"""SELECT courier_id, count(*) AS points, {r('avg(speed_kmh)', 4)} AS avg_speed FROM positions
WHERE ts BETWEEN TIMESTAMP '2024-01-01 00:20:00' AND TIMESTAMP '2024-01-01 00:40:00' GROUP BY 1""")
def position_lake_window(v: Views):
    root = _folder(v, "positions")
    lake.write_position_lake(v.positions, root)
    rows = lake.read_position_lake(v.spark, root, datetime(2024, 1, 1, 0, 20), datetime(2024, 1, 1, 0, 40))
    return rows.groupBy("courier_id").agg(F.count("*").alias("points"), round_half_up(F.avg("speed_kmh"), 4).alias("avg_speed"))


@report("event_lake_topics", """SELECT 'order-offers-v1' AS topic, hour(ts)::bigint AS hour, count(*) AS n FROM offers GROUP BY 2
UNION ALL SELECT 'context-signals-v1', hour(ts)::bigint, count(*) FROM context_signals GROUP BY 2""")
def event_lake_topics(v: Views):
    root = _folder(v, "events")
    lake.write_event_lake(normalize_events(v.offers, v.order_events, v.context_signals), root)
    rows = lake.read_event_lake(v.spark, root, ["order-offers-v1", "context-signals-v1"])
    return rows.groupBy("topic", F.col("hour").cast("long").alias("hour")).agg(F.count("*").alias("n"))


@report("latest_event_time", "SELECT epoch_us(max(ts)) AS newest_us FROM positions")
def latest_event_time(v: Views):
    root = _folder(v, "positions")
    lake.write_position_lake(v.positions, root)
    newest = lake.latest_event_time(v.spark, root)
    return v.spark.range(1).select(F.unix_micros(F.lit(newest)).alias("newest_us"))


@report("lake_views", """SELECT 'copilot_events' AS name, count(*) AS n FROM (SELECT offer_id FROM offers UNION ALL SELECT event_id FROM order_events UNION ALL SELECT event_id FROM context_signals)
UNION ALL SELECT 'gps_events', count(*) FROM positions""")
def lake_views(v: Views):
    positions, events = _folder(v, "positions"), _folder(v, "events")
    lake.write_position_lake(v.positions, positions)
    lake.write_event_lake(normalize_events(v.offers, v.order_events, v.context_signals), events)
    lake.register_views(v.spark, positions, events)
    return v.spark.sql("SELECT 'gps_events' AS name, count(*) AS n FROM gps_events UNION ALL SELECT 'copilot_events', count(*) FROM copilot_events")


@report("compaction", """SELECT 5 * hours AS files_before, hours AS files_after, n AS rows_before, n AS rows_after, true AS row_count_ok
FROM (SELECT count(*) AS n, count(DISTINCT date_trunc('hour', ts)) AS hours FROM positions)""")
def compaction(v: Views):
    source, target = _folder(v, "small-files"), _folder(v, "compacted")
    lake.with_hour_parts(v.positions).repartition(5).write.partitionBy("year", "month", "day", "hour").parquet(source)
    done = lake.compact_partitions(v.spark, source, target, ["year", "month", "day", "hour"])
    return done.select("files_before", "files_after", "rows_before", "rows_after", "row_count_ok")


@report("lake_quarantine", "SELECT count(*) AS rows, 2::bigint AS bad_files FROM stations")
def lake_quarantine(v: Views):
    root = _folder(v, "stations")
    v.stations.write.parquet(root)
    for name in ("cut-short.parquet", "no-footer.parquet"):
        path = v.spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(v.spark._jsc.hadoopConfiguration()).create(path)
        out.writeBytes("PAR1 and then nothing that a reader knows")
        out.close()
    scan = lake.quarantine_scan(v.spark, root)
    bad = scan.agg(F.count("problem").alias("bad_files")).withColumn("__one", F.lit(1))
    rows = lake.read_valid(v.spark, root, scan).agg(F.count("*").alias("rows")).withColumn("__one", F.lit(1))
    return rows.join(bad, "__one").select("rows", "bad_files")


@report("lake_stats", "SELECT 3::bigint AS files, true AS some_bytes FROM (SELECT count(*) AS n FROM stations) WHERE n > 2")
def lake_stats(v: Views):
    root = _folder(v, "stations")
    v.stations.repartition(3).write.parquet(root)
    return lake.lake_stats(v.spark, root).select("files", (F.col("megabytes") > 0).alias("some_bytes"))


@report("prepared_trips", """SELECT l_orderkey, l_linenumber, dispatching_base_num, epoch_us(request_datetime) AS request_us, PULocationID AS pu, DOLocationID AS dest, trip_miles FROM trips
WHERE hvfhs_license_num = 'HV0003' AND PULocationID IS NOT NULL AND DOLocationID IS NOT NULL""")
def prepared_trips(v: Views):
    return trips.prepare_trips(v.trips, extra=["l_orderkey", "l_linenumber"]).select(
        "l_orderkey", "l_linenumber", "dispatching_base_num", F.unix_micros("request_datetime").alias("request_us"),
        F.col("PULocationID").alias("pu"), F.col("DOLocationID").alias("dest"), "trip_miles")


SECONDS = "cast(epoch_us({0}) // 1000000 as varchar)"
USABLE_SQL = f"""u0 AS (SELECT *, {r('trip_miles * 1.60934::double', 3)} AS km, {r('trip_time / 60.0::double', 2)} AS mins,
  {r('greatest(0, base_passenger_fare + tolls + bcf + sales_tax + congestion_surcharge + coalesce(airport_fee, 0))', 2)} AS fare FROM trips
  WHERE hvfhs_license_num = 'HV0003' AND PULocationID IS NOT NULL AND DOLocationID IS NOT NULL),
u AS (SELECT *, {SECONDS.format('request_datetime')} || '_' || PULocationID || '_' || DOLocationID || '_' || trip_time AS trip_key,
  dispatching_base_num || '|' || PULocationID || '|' || DOLocationID || '|' || {SECONDS.format('request_datetime')} || '|' || {SECONDS.format('pickup_datetime')} || '|' || {SECONDS.format('dropoff_datetime')} AS seed
  FROM u0 WHERE dropoff_datetime > pickup_datetime AND PULocationID > 0 AND DOLocationID > 0 AND km > 0 AND mins > 0)"""


def usable(v: Views, mode: str = "trip") -> DataFrame:
    return trips.usable_trips(trips.prepare_trips(v.trips, extra=["l_orderkey", "l_linenumber"]), mode)


@report("usable_trips", f"""WITH {USABLE_SQL} SELECT trip_key, 'tlc_drv_' || substr(sha1('trip|' || seed), 1, 12) AS courier_id, km AS trip_km, mins AS trip_min, fare,
  {r(clamp('km / greatest(mins / 60, 0.01)', 5, 90), 4)} AS avg_speed_kmh FROM u""")
def usable_trips(v: Views):
    return usable(v).select("trip_key", "courier_id", "trip_km", "trip_min", "fare", round_half_up("avg_speed_kmh", 4).alias("avg_speed_kmh"))


@report("courier_ids", f"""WITH {USABLE_SQL} SELECT trip_key, 'tlc_drv_' || substr(sha1('legacy|' || dispatching_base_num || '|' || PULocationID || '|' || strftime(request_datetime, '%Y-%m-%d')), 1, 12) AS legacy,
  'drv_demo_' || lpad(cast(('0x' || substr(sha1('fleet|' || dispatching_base_num || '|' || PULocationID || '|' || DOLocationID || '|' || strftime(request_datetime, '%Y-%m-%dT%H')), 1, 8))::bigint % 250 + 1 as varchar), 3, '0') AS pooled FROM u""")
def courier_ids(v: Views):
    return usable(v).select("trip_key", trips.assign_courier_id("legacy_zone_day").alias("legacy"), trips.assign_courier_id("fleet_pool").alias("pooled"))


@report("sampled_trips", f"WITH {USABLE_SQL} SELECT trip_key FROM u WHERE (('0x' || substr(sha1(trip_key), 1, 8))::bigint % 10000) / 10000.0::double < 0.25")
def sampled_trips(v: Views):
    return trips.sample_trips(usable(v), 0.25).select("trip_key")


def centroids(v: Views) -> DataFrame:
    return v.zones.select(F.regexp_replace("zone_id", "^nyc_", "").cast("long").alias("location_id"), "lat", "lon")


def located(v: Views) -> DataFrame:
    return trips.impute_zone_points(usable(v), centroids(v))


def _project(lat: str, lon: str, bearing: str, km: str) -> tuple[str, str]:
    la, lo, b, arc = f"radians({lat})", f"radians({lon})", f"radians({bearing})", f"(({km}) / 6371.0::double)"
    lat2 = f"asin(sin({la}) * cos({arc}) + cos({la}) * sin({arc}) * cos({b}))"
    lon2 = f"((degrees({lo} + atan2(sin({b}) * sin({arc}) * cos({la}), cos({arc}) - sin({la}) * sin({lat2}))) + 540::double) % 360::double - 180::double)"
    return f"degrees({lat2})", lon2


_FREE = _project("40.7580::double", "-73.9855::double", "b", "1.2::double")
_BACK = _project("d.lat", "d.lon", "(b + 180) % 360", clamp("kk * 0.8::double", 0.6, 5))
_ON = _project("pickup_lat", "pickup_lon", "CASE WHEN nopu THEN (b + 120) % 360 ELSE b END", "kk")
POINTS_SQL = f"""{USABLE_SQL}, cz AS (SELECT cast(substr(zone_id, 5) AS bigint) AS id, lat, lon FROM zones),
i0 AS (SELECT u.*, (('0x' || substr(sha1(seed), 1, 8))::bigint % 360)::double AS b, {clamp('km', 0.8, 8)} AS kk FROM u),
i1 AS (SELECT i0.*, p.lat AS plat, p.lon AS plon, d.lat AS dlat, d.lon AS dlon, p.lat IS NULL AS nopu, d.lat IS NULL AS nodo,
  CASE WHEN p.lat IS NULL AND d.lat IS NULL THEN {_FREE[0]} WHEN p.lat IS NULL THEN {_BACK[0]} ELSE p.lat END AS pickup_lat,
  CASE WHEN p.lat IS NULL AND d.lat IS NULL THEN {_FREE[1]} WHEN p.lat IS NULL THEN {_BACK[1]} ELSE p.lon END AS pickup_lon
  FROM i0 LEFT JOIN cz p ON p.id = PULocationID LEFT JOIN cz d ON d.id = DOLocationID),
pt AS (SELECT *, CASE WHEN nodo THEN {_ON[0]} ELSE dlat END AS dropoff_lat, CASE WHEN nodo THEN {_ON[1]} ELSE dlon END AS dropoff_lon FROM i1)"""


@report("trip_points", f"WITH {POINTS_SQL} SELECT trip_key, {', '.join(f'{r(c, 5)} AS {c}' for c in ['pickup_lat', 'pickup_lon', 'dropoff_lat', 'dropoff_lon'])} FROM pt")
def trip_points(v: Views):
    return located(v).select("trip_key", *[round_half_up(c, 5).alias(c) for c in ["pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon"]])


@report("trip_offers", f"WITH {USABLE_SQL} SELECT 'offer_' || substr(sha1(trip_key), 1, 20) AS event_id, 'tlc_offer_' || trip_key AS offer_id, fare AS estimated_fare_eur, km AS estimated_distance_km, mins AS estimated_duration_min, 'nyc_' || PULocationID AS zone_id FROM u")
def trip_offers(v: Views):
    return trips.trip_offers(located(v)).select("event_id", "offer_id", "estimated_fare_eur", "estimated_distance_km", "estimated_duration_min", "zone_id")


@report("trip_order_events", f"""WITH {USABLE_SQL} SELECT 'evt_accepted_' || substr(sha1(trip_key), 1, 20) AS event_id, 'accepted' AS status, epoch_us(request_datetime) AS ts_us, 0.0::double AS actual_fare_eur FROM u
UNION ALL SELECT 'evt_dropped_off_' || substr(sha1(trip_key), 1, 20), 'dropped_off', epoch_us(dropoff_datetime), fare FROM u""")
def trip_order_events(v: Views):
    return trips.trip_order_events(usable(v)).select("event_id", "status", F.unix_micros("ts").alias("ts_us"), "actual_fare_eur")


@report("trip_positions", f"""WITH {USABLE_SQL} SELECT 'pos_delivering_' || substr(sha1(trip_key || '_' || {SECONDS.format('pickup_datetime')}), 1, 20) AS event_id, 'delivering' AS status,
  {r(clamp('km / greatest(mins / 60, 0.01)', 5, 90), 1)} AS speed_kmh FROM u UNION ALL SELECT 'pos_available_' || substr(sha1(trip_key || '_' || {SECONDS.format('dropoff_datetime')}), 1, 20), 'available', 0.0::double FROM u""")
def trip_positions(v: Views):
    return trips.trip_positions(located(v)).select("event_id", "status", "speed_kmh")


@report("trip_candidates", f"""WITH {POINTS_SQL}, la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY courier_id ORDER BY ts DESC, event_id) AS rn FROM positions) WHERE rn = 1),
c0 AS (SELECT trip_key, la.courier_id, {haversine('la.lat', 'la.lon', 'pickup_lat', 'pickup_lon')} AS km_to, epoch_us(la.ts) AS free, epoch_us(request_datetime) AS req, epoch_us(pickup_datetime) AS pick FROM pt, la
  WHERE epoch_us(la.ts) <= epoch_us(pickup_datetime) + 120000000 AND epoch_us(request_datetime) - epoch_us(la.ts) <= 7200000000),
c1 AS (SELECT *, km_to / 22 * 60 AS eta, greatest(free, req) AS st FROM c0 WHERE km_to <= 11),
c2 AS (SELECT *, km_to + (st - req) / 60000000.0::double * 1.7::double + eta * 0.35::double + greatest((st + eta * 60000000.0::double - pick) / 60000000.0::double, 0) * 4 + 0.15::double AS cost FROM c1 WHERE eta <= 30 AND st + eta * 60000000.0::double <= pick + 120000000)
SELECT trip_key, courier_id, {r('cost', 5)} AS cost, rank FROM (SELECT *, row_number() OVER (PARTITION BY trip_key ORDER BY cost, courier_id) AS rank FROM c2) WHERE rank <= 3""")
def trip_candidates(v: Views):
    idle = fleet.latest_positions(v.positions).select("courier_id", F.col("ts").alias("available_at"), "lat", "lon")
    found = trips.trip_candidates(located(v), idle, max_idle_min=120.0)
    return found.select("trip_key", "courier_id", round_half_up("cost", 5).alias("cost"), F.col("rank").cast("long").alias("rank"))
