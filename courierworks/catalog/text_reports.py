"""Reports over pages, feeds and service health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierworks.catalog.registry import r, report
from courierworks.functions import context as fx
from courierworks.functions import text
from courierworks.functions.num import round_half_up
from courierworks.operators import context, health
from courierworks.sources.adapters import REF_US, Views, ref_ts

_STRIP = "html"
for _name in text.HIDDEN:
    _STRIP = f"""array_to_string(list_transform(string_split_regex({_STRIP}, '(?i)<{_name}\\b'), lambda p, i: CASE WHEN i = 1 THEN p
      ELSE ' ' || array_to_string(string_split_regex(p, '(?i)</{_name}\\s*>')[2:], ' ') END), '')"""
_STRIP = f"""array_to_string(list_transform(string_split({_STRIP}, '<'), lambda p, i: CASE WHEN i = 1 THEN p WHEN strpos(p, '>') < 2 THEN '<' || p
  ELSE CASE WHEN lower(regexp_extract(p, '^/?[A-Za-z0-9]+')) IN ({', '.join(f"'{t}'" for t in text.LINE_TAGS)}) THEN chr(10) ELSE ' ' END || substr(p, strpos(p, '>') + 1) END), '')"""
for _entity, _char in [("&amp;", "&"), ("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"')]:
    _STRIP = f"replace({_STRIP}, '{_entity}', '{_char}')"


@report("page_lines", f"""WITH l AS (SELECT page_id, trim(regexp_replace(unnest(string_split_regex({_STRIP}, '\\r\\n|[\\n\\r\\x0b\\x0c]')), '\\s+', ' ', 'g')) AS line FROM pages)
SELECT page_id, count(*) AS lines, sum(length(line))::bigint AS characters FROM l WHERE line <> '' GROUP BY 1""")
def page_lines(v: Views):
    return text.html_lines(v.pages, "page_id").groupBy("page_id").agg(
        F.count("*").alias("lines"), F.sum(F.length("line").cast("long")).alias("characters"))


def advisories(v: Views) -> DataFrame:
    """A small advisory page per city event: a borough heading and one line on a closure."""
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Full closed bridge and double-lane works no. "), F.col("event_id").cast("string"))).otherwise(
        F.concat(F.lit("Rolling closure of a single lane near stop no. "), F.col("event_id").cast("string")))
    page = F.concat(F.lit("<html><h2>"), "event_borough", F.lit("</h2><p>Note: lanes may be closed at short notice</p><p>"), line, F.lit("</p><li>"), line, F.lit("</li></html>"))
    return v.city_events.select("event_id", page.alias("html"))


@report("closures_extracted", f"""SELECT event_id, CASE event_borough WHEN 'Manhattan' THEN 'manhattan' WHEN 'BK' THEN 'brooklyn' WHEN 'queens' THEN 'queens' ELSE 'bronx' END AS borough,
  {r("CASE WHEN event_id % 3 = 0 THEN 1.32::double ELSE 0.57::double END", 4)} AS severity, {REF_US} - 7200000000 AS start_us FROM city_events WHERE event_borough <> 'unknown place'""")
def closures_extracted(v: Views):
    out = text.extract_closures(advisories(v), "event_id", ref_ts())
    return out.select("event_id", "borough", round_half_up("severity", 4).alias("severity"), F.unix_micros("start_ts").alias("start_us"))


@report("speed_samples", f"""SELECT link_id, lat, lon, {r('speed_mph * 1.60934::double', 3)} AS speed_kmh FROM link_speeds WHERE speed_mph > 0""")
def speed_samples(v: Views):
    word = lambda c: F.col(c).cast("string")
    line = (F.when(F.col("link_id") % 3 == 0, F.concat_ws(",", word("lat"), word("lon"), word("speed_mph")))
            .when(F.col("link_id") % 3 == 1, F.concat_ws(", ", word("lon"), word("lat"), word("speed_mph")))
            .otherwise(F.concat_ws(",", F.lit("link"), word("lat"), word("lon"), F.lit("mph"), word("speed_mph"))))
    feed = v.link_speeds.select("link_id", F.concat(F.lit("no sample here\n"), line).alias("text"))
    return text.extract_speed_samples(feed, "link_id").select("link_id", "lat", "lon", "speed_kmh")


@report("charging_stations", f"""SELECT 'hub_' || station_id || '_' || replace(printf('%.5f', {r('lat', 5)}), '.', '_') || '_' || replace(printf('%.5f', abs({r('lon', 5)})), '.', '_') || '_level_2' AS slug_id, 'Hub ' || station_id || ' - Queens - Level 2' AS name,
  lat, lon, 7.2::double AS power_kw, 'nyc_open_data_ev_stations' AS source FROM stations WHERE lat BETWEEN 40.49 AND 40.92 AND lon BETWEEN -74.27 AND -73.68
UNION ALL SELECT station_id::VARCHAR, 'Map ' || station_id, lat, lon, greatest(num_docks_available::double, 11), 'openchargemap_nyc' FROM stations WHERE lat BETWEEN 40.49 AND 40.92 AND lon BETWEEN -74.27 AND -73.68""")
def charging_stations(v: Views):
    """Every station in both layouts; on the map it has three connections, one of unknown power."""
    rows = v.stations.select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.concat(F.lit("Hub "), "station_id").alias("station_name"),
                             F.lit("").alias("street"), F.lit("Queens").alias("borough"), F.lit("Level 2").alias("type_of_charger"))
    point = F.struct(F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"), F.concat(F.lit(" Map "), "station_id").alias("Title"))
    powers = F.array(*[F.struct(x.cast("double").alias("PowerKW")) for x in (F.lit(11.0), F.lit(None), F.col("num_docks_available"))])
    mapped = v.stations.select(F.col("station_id").alias("ID"), point.alias("AddressInfo"), powers.alias("Connections"))
    return text.normalize_charging_stations(mapped, rows).select(F.col("station_id").alias("slug_id"), "name", "lat", "lon", "power_kw", "source")


@report("fuel_prices", f"""SELECT p_partkey, {r('p_retailprice / 500', 4)} AS price FROM part""")
def fuel_prices(v: Views):
    feed = F.concat(F.lit("<prices><diesel>n/a</diesel><regular>"), F.format_string("%.6f", F.col("p_retailprice") / 500.0), F.lit("</regular></prices>"))
    return v.part.select("p_partkey", round_half_up(text.fuel_price_from_feed(feed, "diesel"), 4).alias("price"))


@report("recent_incidents", f"""SELECT incident_id FROM incidents WHERE incident_id % 5 IN (0, 1, 2) AND incident_id % 11 < 6""")
def recent_incidents(v: Views):
    kind = F.element_at(F.array(*[F.lit(x) for x in ["Traffic Signal", "Blocked Driveway", "Illegal Parking", "Noise", "Graffiti"]]),
                        (F.col("incident_id") % 5 + 1).cast("int"))
    created = F.timestamp_micros((F.lit(REF_US) - F.col("incident_id") % 11 * 3_600_000_000).cast("long"))
    rows = v.incidents.select("incident_id", kind.alias("complaint_type"), created.alias("created_date"),
                              F.col("lat").cast("string").alias("latitude"), F.col("lon").cast("string").alias("longitude"))
    return fx.recent_incidents(rows, ref_ts()).select("incident_id")


@report("boroughs", """SELECT event_id, CASE event_borough WHEN 'Manhattan' THEN 'manhattan' WHEN 'BK' THEN 'brooklyn' WHEN 'queens' THEN 'queens' WHEN 'X' THEN 'bronx' END AS normalized,
  CASE event_borough WHEN 'Manhattan' THEN 'manhattan' WHEN 'queens' THEN 'queens' END AS inferred FROM city_events""")
def boroughs(v: Views):
    return v.city_events.select("event_id", fx.normalize_borough("event_borough").alias("normalized"),
                                fx.infer_borough(F.concat(F.lit("works in "), "event_borough", F.lit("/east"))).alias("inferred"))


def runs(v: Views) -> DataFrame:
    """One row of service figures per tick of the context signals."""
    quality = context.context_quality(context.parse_signal(v.context_signals))
    k = F.unix_micros("ts") / 60_000_000 - F.lit(28401120)
    rows = quality.select(k.cast("long").alias("run_id"), "supply_flat_alert", "zones")
    n = F.col("run_id")
    return rows.select(
        "run_id", (n % 4 == 0).alias("supply_flat_alert"), F.when(n % 7 == 0, "single_driver").otherwise("fleet").alias("replay_mode"), (n % 3).alias("stale_sources_count"),
        (n % 3 == 2).alias("stale_dot_speeds"), F.when(n % 5 == 0, "ok").otherwise("late").alias("dot_speeds_status"), (n % 6).alias("dot_speeds_rows"),
        (n % 2 == 0).alias("context_fallback_applied"), (n % 10).alias("route_requests"), F.lit("running").alias("routing_state"), (n % 13 == 0).alias("routing_degraded"),
        (F.lit(0.7) + (n % 4) / 10.0).alias("routing_success_rate"), ((n % 5) / 10.0).alias("hold_rate"), (n % 17 != 0).alias("model_loaded"),
        (n % 19 != 0).alias("model_accepted"), F.lit("running").alias("replay_status"))


HEALTH_SQL = """rn AS (SELECT (epoch_us(ts) // 60000000 - 28401120)::bigint AS n FROM context_signals GROUP BY 1),
dq AS (SELECT n, n % 4 = 0 AND n % 7 <> 0 AS flat, n % 3 = 2 AS opt, n % 5 <> 0 AS late, greatest(n % 3 - CASE WHEN n % 3 = 2 THEN 1 ELSE 0 END, 0) AS core FROM rn),
df AS (SELECT *, concat_ws(',', CASE WHEN flat THEN 'supply_flat' END, CASE WHEN NOT opt AND late THEN 'dot_speeds' END, CASE WHEN core > 0 THEN 'core_context_fallback' END) AS flags FROM dq),
ds AS (SELECT *, CASE WHEN flags <> '' THEN 'monitoring' ELSE 'ok' END AS data_status, CASE WHEN flags <> '' THEN 'Context monitored' WHEN n % 2 = 0 AND opt THEN 'Fallback stable' ELSE 'Context fresh' END AS context_summary,
  CASE WHEN n % 13 = 0 THEN 'degraded' WHEN n % 10 = 0 THEN 'warming_up' WHEN 0.7::double + (n % 4) / 10.0::double < 0.8 OR (n % 5) / 10.0::double > 0.30 THEN 'monitoring' ELSE 'ok' END AS routing_status FROM df),
rd AS (SELECT *, concat_ws(',', CASE WHEN n % 17 = 0 THEN 'model_unavailable' END, CASE WHEN n % 19 = 0 THEN 'model_quality_gate' END, CASE WHEN routing_status = 'degraded' THEN 'routing_degraded' END) AS blocking FROM ds)"""


@report("service_health", f"""WITH {HEALTH_SQL} SELECT n AS run_id, flags AS monitoring_flags, data_status, context_summary, routing_status, blocking AS blocking_issues,
  CASE WHEN blocking <> '' THEN 'degraded' WHEN routing_status IN ('warming_up', 'monitoring') OR data_status = 'monitoring' THEN 'monitoring' ELSE 'ok' END AS readiness_status FROM rd""")
def service_health(v: Views):
    rows = health.readiness(health.routing_health(health.data_quality_health(runs(v))))
    return rows.select("run_id", F.array_join("monitoring_flags", ",").alias("monitoring_flags"), "data_status", "context_summary", "routing_status",
                       F.array_join("blocking_issues", ",").alias("blocking_issues"), "readiness_status")


@report("quality_badges", f"""WITH {HEALTH_SQL} SELECT n AS run_id, 'model_gate' AS code, CASE WHEN n % 19 <> 0 THEN 'good' ELSE 'warn' END AS tone FROM rd
UNION ALL SELECT n, 'context', CASE WHEN data_status = 'ok' THEN 'good' ELSE 'warn' END FROM rd
UNION ALL SELECT n, 'routing', CASE WHEN routing_status = 'ok' THEN 'good' WHEN routing_status = 'degraded' THEN 'bad' ELSE 'warn' END FROM rd""")
def quality_badges(v: Views):
    rows = health.readiness(health.routing_health(health.data_quality_health(runs(v))))
    return health.quality_badges(rows).where("code <> 'demo_readiness'").select("run_id", "code", "tone")


@report("routing_rates", """SELECT offer_id, n::double / nullif(q, 0) AS success, h::double / nullif(p, 0) AS hold FROM (SELECT offer_id, floor(demand_index * 3)::bigint AS q, floor(demand_index)::bigint AS n,
  floor(estimated_fare_eur)::bigint - 4 AS p, floor(weather_factor)::bigint AS h FROM offers)""")
def routing_rates(v: Views):
    whole = lambda c: F.floor(c).cast("long")
    rows = v.offers.select("offer_id", whole(F.col("demand_index") * 3).alias("routing_requests"), whole(F.col("demand_index")).alias("routing_successes"),
                           (whole(F.col("estimated_fare_eur")) - 4).alias("positions_emitted"), whole(F.col("weather_factor")).alias("hold_ticks"))
    return context.routing_rates(rows).select("offer_id", F.col("routing_success_rate").alias("success"), F.col("hold_rate").alias("hold"))
