"""Fleet inputs derived from the generic test tables.

Every view is one SQL text with a few dialect marks, so the same definition serves Spark and the
engine that checks the results: `US(x)` microseconds of a timestamp, `TS(x)` timestamp from
microseconds, `DIV(a, b)` integer division. Table names stand in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courierworks.session import prepare

BASE_US = 1704067200000000  # 2024-01-01 00:00 UTC, start of the replay hour
REF_US = BASE_US + 3600 * 1000000  # its end, the reference time of every report
REF_TS = "2024-01-01 01:00:00"

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {}

VIEWS["zones"] = """
SELECT 'nyc_' || cast(n_nationkey + 1 as string) AS zone_id, n_name AS zone_name,
  cast(40600000 + (n_nationkey % 5) * 60000 as double) / 1000000 AS lat,
  cast(DIV(n_nationkey, 5) * 60000 - 74050000 as double) / 1000000 AS lon
FROM {nation}"""

VIEWS["positions"] = f"""
SELECT 'drv_' || lpad(cast(user_id as string), 4, '0') AS courier_id, event_id,
  TS({BASE_US} + DIV((US(ts) - {BASE_US}), 720)) AS ts,
  cast(40750000 + (user_id % 10 - 5) * 10000
    + CASE WHEN user_id % 15 IN (7, 8) THEN 0 WHEN user_id % 15 = 9 THEN (event_id % 2) * 8200
           ELSE (event_id * 7919) % 100 * 120 END
    + CASE WHEN event_id % 97 = 0 THEN 50000 ELSE 0 END as double) / 1000000 AS lat,
  cast((user_id % 7) * 10000 - 74000000
    + CASE WHEN user_id % 15 IN (7, 8, 9) THEN 0 ELSE (event_id * 104729) % 100 * 120 END as double) / 1000000 AS lon,
  CASE WHEN user_id % 15 = 8 THEN cast(0.5 as double) ELSE least(value, cast(130 as double)) END AS speed_kmh,
  cast((event_id * 37) % 360 as double) AS heading_deg,
  CASE WHEN user_id % 15 IN (7, 8) OR event_type = 'purchase' THEN 'delivering'
       WHEN event_type = 'click' THEN 'pickup_en_route' WHEN event_type = 'view' THEN 'available'
       WHEN event_type = 'signup' THEN 'idle' ELSE 'repositioning' END AS status,
  cast(8 as double) AS accuracy_m, cast((event_id * 13) % 101 as double) AS battery_pct,
  CASE WHEN event_id % 10 = 0 THEN 'tlc_hvfhv|route=hold' WHEN event_id % 10 < 3 THEN 'tlc_hvfhv|route=linear'
       ELSE 'tlc_hvfhv|route=osrm' END AS source_platform
FROM {{events}}"""

VIEWS["offers"] = f"""
SELECT 'off_' || cast(o_orderkey as string) AS offer_id, 'ord_' || cast(o_orderkey as string) AS order_id,
  'drv_' || lpad(cast(o_custkey % 150 as string), 4, '0') AS courier_id,
  'nyc_' || cast(1 + o_custkey % 25 as string) AS zone_id,
  TS({BASE_US} + (o_orderkey * 7919) % 3600000 * 1000) AS ts,
  cast(40600000 + (o_custkey % 5) * 60000 + (o_orderkey * 17) % 9000 as double) / 1000000 AS pickup_lat,
  cast(DIV((o_custkey % 25), 5) * 60000 - 74050000 + (o_orderkey * 29) % 9000 as double) / 1000000 AS pickup_lon,
  cast(40600000 + (o_orderkey % 5) * 60000 as double) / 1000000 AS dropoff_lat,
  cast(DIV((o_orderkey % 25), 5) * 60000 - 74050000 as double) / 1000000 AS dropoff_lon,
  cast(400 + (o_orderkey * 37) % 2100 as double) / 100 AS estimated_fare_eur,
  cast(15 + (o_custkey * 7) % 105 as double) / 10 AS estimated_distance_km,
  cast(80 + (o_orderkey * 11) % 270 as double) / 10 AS estimated_duration_min,
  cast(60 + (o_orderkey * 13) % 160 as double) / 100 AS demand_index,
  cast(90 + (o_orderkey * 3) % 55 as double) / 100 AS weather_factor,
  cast(85 + (o_custkey * 5) % 60 as double) / 100 AS traffic_factor,
  'offered' AS status, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'tlc_hvfhv|route=osrm' END AS source_platform
FROM {{orders}}"""

VIEWS["order_events"] = f"""
SELECT 'evt_' || k || '_' || cast(o_orderkey as string) AS event_id,
  'off_' || cast(o_orderkey as string) AS offer_id, 'ord_' || cast(o_orderkey as string) AS order_id,
  'drv_' || lpad(cast(o_custkey % 150 as string), 4, '0') AS courier_id,
  'nyc_' || cast(1 + o_custkey % 25 as string) AS zone_id,
  CASE WHEN k = 'accepted' AND o_orderkey % 17 = 0 THEN ' Accepted ' ELSE k END AS status,
  TS({BASE_US} + (o_orderkey * 7919) % 3600000 * 1000 + off_us) AS ts,
  CASE WHEN k = 'dropped_off' THEN cast(420 + (o_orderkey * 41) % 2150 as double) / 100 END AS actual_fare_eur,
  CASE WHEN k = 'dropped_off' THEN cast(16 + (o_custkey * 7) % 110 as double) / 10 END AS actual_distance_km,
  CASE WHEN k = 'dropped_off' THEN cast((o_orderkey * 11) % 300 as double) / 10 END AS actual_duration_min
FROM (SELECT o_orderkey, o_custkey, 'accepted' AS k, 30000000 AS off_us FROM {{orders}} WHERE o_orderstatus IN ('F', 'O')
  UNION ALL SELECT o_orderkey, o_custkey, 'dropped_off', 1200000000 FROM {{orders}} WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey, o_custkey, 'rejected', 45000000 FROM {{orders}} WHERE o_orderstatus = 'P'
  UNION ALL SELECT o_orderkey, o_custkey, 'rejected', 20000000 FROM {{orders}}
    WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 13 = 0) x"""

VIEWS["context_signals"] = f"""
SELECT 'ctx_' || cast(z as string) || '_' || cast(tick as string) AS event_id,
  'nyc_' || cast(z as string) AS zone_id, TS({BASE_US} + tick * 60000000) AS ts,
  cast(30 + (n * 9 + z) % 110 as double) / 100 AS demand_index,
  cast(10 + (tick * 7 + z * 3) % 90 as double) / 100 AS supply_index,
  cast(95 + (tick % 10) * 4 as double) / 100 AS weather_factor,
  cast(90 + n * 7 % 60 as double) / 100 AS traffic_factor,
  CASE WHEN tick % 20 = 19 THEN 'gbfs' ELSE 'gbfs+open-meteo;event_pressure=0.' || lpad(cast((n * 7) % 75 as string), 2, '0')
    || ';event_count_nearby=' || cast(n % 6 as string) || ';temporal_is_peak=' || cast(tick % 2 as string)
    || ';freshness_stale_sources=' || cast(n % 4 as string) END AS source,
  'context_poller_public' AS source_platform
FROM (SELECT user_id % 25 + 1 AS z, DIV(DIV((US(ts) - {BASE_US}), 720), 60000000) AS tick, count(*) AS n
      FROM {{events}} GROUP BY 1, 2) g"""

VIEWS["trips"] = f"""
SELECT CASE WHEN l_linenumber % 4 = 0 THEN 'HV0005' ELSE 'HV0003' END AS hvfhs_license_num,
  'B0' || cast(2000 + l_suppkey % 50 as string) AS dispatching_base_num,
  TS({BASE_US} + (l_orderkey * l_linenumber * 104729) % 2592000 * 1000000) AS request_datetime,
  TS({BASE_US} + ((l_orderkey * l_linenumber * 104729) % 2592000 + 60 + l_partkey % 600) * 1000000) AS pickup_datetime,
  TS({BASE_US} + ((l_orderkey * l_linenumber * 104729) % 2592000 + 60 + l_partkey % 600
     + cast(l_quantity as bigint) * 90) * 1000000) AS dropoff_datetime,
  CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE l_suppkey % 30 + 1 END AS PULocationID, l_partkey % 30 AS DOLocationID,
  l_quantity / cast(5 as double) AS trip_miles, cast(l_quantity as bigint) * 90 AS trip_time,
  l_extendedprice / cast(2500 as double) AS base_passenger_fare, l_tax AS tolls, l_discount AS bcf,
  cast(0 as double) AS sales_tax, cast(2.75 as double) AS congestion_surcharge, cast(NULL as double) AS airport_fee,
  cast(0 as double) AS tips, cast(0 as double) AS driver_pay,
  l_linenumber, l_orderkey, l_partkey, l_suppkey
FROM {{lineitem}}"""

VIEWS["stations"] = """
SELECT 'st_' || cast(s_suppkey as string) AS station_id,
  cast(40600000 + (s_suppkey % 5) * 60000 + (s_suppkey * 31) % 6000 as double) / 1000000 AS lat,
  cast(DIV((s_suppkey % 25), 5) * 60000 - 74050000 as double) / 1000000 AS lon,
  s_suppkey % 9 AS num_bikes_available, s_suppkey % 14 AS num_docks_available FROM {supplier}"""

VIEWS["incidents"] = """
SELECT c_custkey AS incident_id,
  cast(40600000 + (c_custkey % 5) * 60000 + (c_custkey * 53) % 20000 as double) / 1000000 AS lat,
  cast(DIV((c_custkey % 25), 5) * 60000 - 74050000 + (c_custkey * 61) % 20000 as double) / 1000000 AS lon
FROM {customer} WHERE c_custkey % 3 = 0"""

VIEWS["city_events"] = f"""
SELECT p_partkey AS event_id, p_name AS event_name,
  CASE WHEN p_partkey % 4 = 0 THEN 'Parade' WHEN p_partkey % 4 = 1 THEN 'Block Party' WHEN p_partkey % 4 = 2 THEN 'Sport' ELSE 'Other' END AS event_type,
  CASE WHEN p_partkey % 5 = 0 THEN 'Manhattan' WHEN p_partkey % 5 = 1 THEN 'BK' WHEN p_partkey % 5 = 2 THEN 'queens'
       WHEN p_partkey % 5 = 3 THEN 'X' ELSE 'unknown place' END AS event_borough,
  TS({BASE_US} + (p_partkey * 211) % 14400 * 1000000) AS start_ts,
  TS({BASE_US} + ((p_partkey * 211) % 14400 + (p_size - 2) * 120) * 1000000) AS end_ts FROM {{part}}"""

VIEWS["link_speeds"] = """
SELECT c_custkey AS link_id,
  cast(40600000 + (c_custkey % 5) * 60000 + (c_custkey * 47) % 30000 as double) / 1000000 AS lat,
  cast(DIV((c_custkey % 25), 5) * 60000 - 74050000 as double) / 1000000 AS lon,
  cast((c_custkey * 7) % 40 as double) AS speed_mph FROM {customer} WHERE c_custkey % 2 = 0"""

VIEWS["driver_profiles"] = """
SELECT 'drv_' || lpad(cast(c_custkey as string), 4, '0') AS courier_id,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE cast(10 + c_custkey % 20 as double) END AS target_eur_h,
  cast(18 + c_custkey % 30 as double) AS vehicle_mpg, cast(c_custkey % 11 as double) / 10 AS aversion_risque,
  cast(c_custkey % 80 as double) AS max_eta FROM {customer} WHERE c_custkey < 150"""

VIEWS["mission_journal"] = f"""
SELECT 'mis_' || cast(o_orderkey as string) AS mission_id,
  'drv_' || lpad(cast(o_custkey % 150 as string), 4, '0') AS courier_id, 'nyc_' || cast(1 + o_custkey % 25 as string) AS zone_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'conservative' WHEN o_orderkey % 3 = 1 THEN 'balanced' ELSE 'aggressive' END AS dispatch_strategy,
  cast((o_orderkey * 19) % 400 as double) / 10 AS elapsed_min, cast((o_orderkey * 23) % 50 as double) / 100 AS final_distance_km,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE cast(100 + (o_orderkey * 3) % 200 as double) / 10 END AS baseline_eur_h,
  cast(90 + (o_orderkey * 5) % 220 as double) / 10 AS predicted_potential_eur_h,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE cast(80 + (o_orderkey * 7) % 240 as double) / 10 END AS realized_best_offer_eur_h,
  TS({BASE_US} + (o_orderkey * 7919) % 3600000 * 1000) AS completed_at FROM {{orders}} WHERE o_orderstatus = 'F'"""

_MARKS = {
    "spark": {"US": "unix_micros(cast({0} as timestamp))", "TS": "timestamp_micros({0})", "DIV": "(({0}) div ({1}))"},
    "duckdb": {"US": "epoch_us({0})", "TS": "make_timestamp({0})", "DIV": "(({0}) // ({1}))"},
}


def expand_marks(text: str, dialect: str) -> str:
    """Replace US(), TS() and DIV() calls; arguments may contain nested parentheses and marks."""
    marks = _MARKS[dialect]
    out, i = [], 0
    for match in iter(lambda: re.compile(r"\b(US|TS|DIV)\(").search(text, i), None):
        out.append(text[i:match.start()])
        depth, j, args, start = 1, match.end(), [], match.end()
        while depth:
            if text[j] == "(":
                depth += 1
            elif text[j] == ")":
                depth -= 1
            elif text[j] == "," and depth == 1:
                args.append(text[start:j])
                start = j + 1
            j += 1
        args.append(text[start:j - 1])
        out.append(marks[match.group(1)].format(*(expand_marks(a.strip(), dialect) for a in args)))
        i = j
    out.append(text[i:])
    return "".join(out)


def ref_ts() -> Column:
    return F.lit(REF_TS).cast("timestamp")


class Views:
    """Lazy access to base tables and derived views of one data folder: `Views(spark, path).positions`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS and name not in TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            if name in TABLES:
                self._cache[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                text = expand_marks(VIEWS[name], "spark")
                inputs = {table: getattr(self, table) for table in set(re.findall(r"\{(\w+)\}", text))}
                self._cache[name] = self.spark.sql(text, **inputs)
        return self._cache[name]


def check_sql(body: str) -> str:
    """SQL for the checking engine: the views that `body` names, in front of it as common table expressions."""
    body = body.strip()
    names = [name for name in VIEWS if re.search(rf"\b{name}\b", body)]
    ctes = []
    for name in names:
        text = re.sub(r"\{(\w+)\}", r"\1", expand_marks(VIEWS[name], "duckdb")).strip()
        ctes.append(f"{name} AS ({text})")
    body = expand_marks(body, "duckdb")
    if re.match(r"(?i)with\s+recursive\b", body):
        head, rest = "WITH RECURSIVE ", ", " + re.sub(r"(?i)^with\s+recursive\s+", "", body)
    elif re.match(r"(?i)with\b", body):
        head, rest = "WITH ", ", " + re.sub(r"(?i)^with\s+", "", body)
    else:
        head, rest = "WITH ", "\n" + body
    if not ctes:
        return body
    return head + ",\n".join(ctes) + rest
