"""Reports over the mart, its key figures, the wide event table and the replay."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierworks.catalog.registry import r, report
from courierworks.functions.num import round_half_up
from courierworks.operators import kpi, replay
from courierworks.operators.keyed import dedupe_keep_first
from courierworks.plans import mart
from courierworks.sources.adapters import Views
from courierworks.sources.events import normalize_events

NET = "(estimated_fare_eur * 0.75::double - estimated_distance_km * 0.621371::double / 31.0::double * 3.65::double)"
NET_H = f"(CASE WHEN estimated_duration_min > 0 THEN greatest({NET} / (estimated_duration_min / 60.0::double), 0) ELSE 0 END)"
PARTS = "year(ts)::bigint AS year, month(ts)::bigint AS month, day(ts)::bigint AS day, hour(ts)::bigint AS hour"
OFFERS_SQL = f"""fo AS (SELECT offer_id, order_id, courier_id, zone_id, coalesce(nullif(source_platform, ''), 'unknown') AS source_platform, ts, {PARTS},
  estimated_fare_eur, estimated_distance_km, estimated_duration_min, demand_index, 1.0::double AS supply_index, weather_factor, traffic_factor,
  demand_index / 1.0::double AS pressure_ratio, {NET} AS net_eur, {NET_H} AS net_eur_h,
  estimated_distance_km * 0.621371::double / 31.0::double * 3.65::double AS fuel_cost_usd, lower(trim(status)) AS status FROM offers)"""
EVENTS_SQL = f"""fe AS (SELECT event_id, offer_id, order_id, courier_id, zone_id, ts, {PARTS}, lower(trim(status)) AS status,
  actual_fare_eur, actual_distance_km, actual_duration_min FROM order_events)"""
SIGNALS_SQL = f"""fc AS (SELECT event_id, zone_id, coalesce(nullif(source_platform, ''), 'unknown') AS source_platform, ts, {PARTS}, demand_index, supply_index,
  weather_factor, traffic_factor, coalesce(demand_index / nullif(supply_index, 0), 0) AS pressure_ratio,
  (demand_index > 0.7 AND supply_index < 0.4) AS surge_candidate FROM context_signals)"""
MISSIONS_SQL = f"""{OFFERS_SQL}, {EVENTS_SQL},
lo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY ts DESC) AS rn FROM fo) WHERE rn = 1),
fm AS (SELECT e.event_id AS mission_id, e.courier_id, e.zone_id, e.ts AS completed_at, e.status, e.actual_fare_eur, e.actual_distance_km,
    e.actual_duration_min, lo.estimated_fare_eur, lo.estimated_distance_km, lo.estimated_duration_min,
    e.actual_fare_eur * 0.75::double - e.actual_distance_km * 0.621371::double / 31.0::double * 3.65::double AS realized_net_eur,
    CASE WHEN coalesce(e.actual_duration_min, 0) > 0 THEN (e.actual_fare_eur * 0.75::double - e.actual_distance_km * 0.621371::double / 31.0::double * 3.65::double)
      / (e.actual_duration_min / 60.0::double) END AS realized_net_eur_h FROM fe e LEFT JOIN lo USING (offer_id))"""


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def fact_offers(v: Views) -> DataFrame:
    return mart.fact_offers(v.offers)


def fact_events(v: Views) -> DataFrame:
    return mart.fact_order_events(v.order_events)


def fact_signals(v: Views) -> DataFrame:
    # The `source` of a signal is metadata, not a platform, so it stays out of the contract.
    return mart.fact_context_signals(v.context_signals.drop("source"))


def fact_missions(v: Views) -> DataFrame:
    return mart.fact_missions(fact_events(v), fact_offers(v))


@report("fact_offers", f"""WITH {OFFERS_SQL} SELECT offer_id, order_id, courier_id, zone_id, source_platform, epoch_us(ts) AS ts_us, year, month, day, hour,
  {', '.join(f'{r(c, 6)} AS {c}' for c in ['pressure_ratio', 'net_eur', 'net_eur_h', 'fuel_cost_usd'])}, status FROM fo""")
def fact_offers_report(v: Views):
    out = _long(fact_offers(v), "year", "month", "day", "hour")
    return out.select("offer_id", "order_id", "courier_id", "zone_id", "source_platform", F.unix_micros("ts").alias("ts_us"),
                      "year", "month", "day", "hour", *[round_half_up(c, 6).alias(c) for c in
                      ["pressure_ratio", "net_eur", "net_eur_h", "fuel_cost_usd"]], "status")


@report("fact_order_events", f"""WITH {EVENTS_SQL} SELECT event_id, offer_id, order_id, courier_id, zone_id, 'unknown' AS source_platform,
  'order.event.v1' AS event_type, status, epoch_us(ts) AS ts_us, year, month, day, hour, actual_fare_eur, actual_distance_km,
  actual_duration_min, 0.0::double AS net_eur, 0.0::double AS net_eur_h FROM fe""")
def fact_order_events_report(v: Views):
    out = _long(fact_events(v), "year", "month", "day", "hour")
    return out.select("event_id", "offer_id", "order_id", "courier_id", "zone_id", "source_platform", "event_type", "status",
                      F.unix_micros("ts").alias("ts_us"), "year", "month", "day", "hour", "actual_fare_eur",
                      "actual_distance_km", "actual_duration_min", "net_eur", "net_eur_h")


@report("fact_context_signals", f"""WITH {SIGNALS_SQL} SELECT event_id, 'unknown_courier' AS courier_id, zone_id, source_platform, epoch_us(ts) AS ts_us, hour, demand_index,
  supply_index, {r('pressure_ratio', 6)} AS pressure_ratio, surge_candidate FROM fc""")
def fact_context_signals_report(v: Views):
    return _long(fact_signals(v), "hour").select(
        "event_id", F.lit("unknown_courier").alias("courier_id"), "zone_id", "source_platform", F.unix_micros("ts").alias("ts_us"), "hour",
        "demand_index", "supply_index", round_half_up("pressure_ratio", 6).alias("pressure_ratio"), "surge_candidate")


@report("fact_missions", f"""WITH {MISSIONS_SQL} SELECT mission_id, courier_id, zone_id, epoch_us(completed_at) AS completed_us, status,
  actual_fare_eur, estimated_fare_eur, estimated_distance_km, estimated_duration_min, {r('realized_net_eur', 6)} AS realized_net_eur,
  {r('realized_net_eur_h', 6)} AS realized_net_eur_h FROM fm""")
def fact_missions_report(v: Views):
    return fact_missions(v).select(
        "mission_id", "courier_id", "zone_id", F.unix_micros("completed_at").alias("completed_us"), "status", "actual_fare_eur",
        "estimated_fare_eur", "estimated_distance_km", "estimated_duration_min",
        round_half_up("realized_net_eur", 6).alias("realized_net_eur"),
        round_half_up("realized_net_eur_h", 6).alias("realized_net_eur_h"))


@report("kpi_signal_volume", f"WITH {SIGNALS_SQL} SELECT count(*) AS total_signals FROM fc")
def kpi_signal_volume(v: Views):
    return kpi.signal_volume(fact_signals(v))


@report("kpi_surge_rate", f"""WITH {SIGNALS_SQL} SELECT {r('count(*) FILTER (WHERE surge_candidate) * 100.0::double / nullif(count(*), 0)', 2)}
  AS surge_rate_pct FROM fc""")
def kpi_surge_rate(v: Views):
    return kpi.surge_rate(fact_signals(v))


@report("kpi_pressure", f"WITH {SIGNALS_SQL} SELECT {r('avg(pressure_ratio)', 4)} AS avg_pressure_ratio FROM fc")
def kpi_pressure(v: Views):
    return kpi.mean_pressure(fact_signals(v))


@report("kpi_top_zones", f"WITH {SIGNALS_SQL} SELECT zone_id, count(*) AS signals FROM fc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def kpi_top_zones(v: Views):
    return kpi.top_zones(fact_signals(v))


@report("kpi_accept_rate", f"""WITH {EVENTS_SQL},
n AS (SELECT offer_id, status FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY ts DESC NULLS LAST, event_id) AS rn
  FROM fe WHERE status IN ('accepted', 'rejected')) WHERE rn = 1)
SELECT count(*) AS decided_offers, count(*) FILTER (WHERE status = 'accepted') AS accepted_offers,
  count(*) FILTER (WHERE status = 'rejected') AS rejected_offers,
  {r("count(*) FILTER (WHERE status = 'accepted') * 100.0::double / nullif(count(*), 0)", 2)} AS accept_rate_pct FROM n""")
def kpi_accept_rate(v: Views):
    return kpi.accept_rate(fact_events(v))


@report("kpi_offer_net", f"WITH {OFFERS_SQL} SELECT {r('avg(net_eur_h)', 2)} AS avg_net_eur_h, {r('avg(net_eur)', 2)} AS avg_net_eur FROM fo")
def kpi_offer_net(v: Views):
    return kpi.offer_net(fact_offers(v))


@report("kpi_by_platform", """SELECT coalesce(nullif(split_part(source, ';', 1), ''), 'unknown') AS source_platform, count(*) AS cnt
FROM context_signals GROUP BY 1 ORDER BY cnt DESC, 1 LIMIT 10""")
def kpi_by_platform(v: Views):
    # Signals of the first schema version carry the tag in `source` only.
    return kpi.by_platform(mart.fact_context_signals(v.context_signals.drop("source_platform")))


@report("kpi_hour_profile", f"""WITH {SIGNALS_SQL} SELECT hour, {r('avg(demand_index)', 4)} AS avg_demand, {r('avg(pressure_ratio)', 4)} AS avg_pressure
FROM fc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def kpi_hour_profile(v: Views):
    return _long(kpi.hour_profile(fact_signals(v)), "hour")


@report("kpi_weather_profile", f"""WITH {SIGNALS_SQL} SELECT {r('weather_factor', 1)} AS weather_bucket, {r('avg(demand_index)', 4)} AS avg_demand,
  count(*) AS n FROM fc GROUP BY 1""")
def kpi_weather_profile(v: Views):
    return kpi.weather_profile(fact_signals(v))


@report("kpi_missions", f"""WITH {MISSIONS_SQL} SELECT count(*) AS missions, {r('avg(realized_net_eur_h)', 2)} AS avg_realized_net_eur_h
FROM fm WHERE realized_net_eur_h IS NOT NULL""")
def kpi_missions(v: Views):
    return kpi.realised_missions(fact_missions(v))


@report("compaction_probe_volume", f"SELECT count(*) AS signals, {r('avg(demand_index)', 6)} AS avg_demand FROM context_signals")
def compaction_probe_volume(v: Views):
    return kpi.signal_count_and_demand(fact_signals(v))


@report("compaction_probe_pressure", f"""WITH {SIGNALS_SQL} SELECT zone_id, {r('avg(pressure_ratio)', 6)} AS avg_pressure FROM fc
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def compaction_probe_pressure(v: Views):
    return kpi.pressure_by_zone(fact_signals(v))


WIDE_SQL = """w AS (
SELECT 'order-offers-v1' AS topic, 'order.offer.v1' AS event_type, NULL AS event_id, offer_id, '' AS order_id, courier_id, 'offered' AS status, zone_id,
  'normalized-order-offer' AS source, coalesce(nullif(trim(source_platform), ''), 'unknown') AS source_platform, estimated_fare_eur,
  NULL::double AS actual_fare_eur, demand_index, NULL::double AS supply_index, ts FROM offers
UNION ALL SELECT 'order-events-v1', 'order.event.v1', event_id, offer_id, order_id, courier_id, status, zone_id, 'normalized-order-event', 'unknown',
  NULL, actual_fare_eur, NULL, NULL, ts FROM order_events
UNION ALL SELECT 'context-signals-v1', 'context.signal.v1', event_id, '', '', '', 'signal', zone_id, source, 'context_poller_public', NULL, NULL,
  demand_index, supply_index, ts FROM context_signals)"""


@report("wide_events", f"""WITH {WIDE_SQL} SELECT topic, event_type, event_id, offer_id, order_id, courier_id, status, zone_id, source, source_platform,
  estimated_fare_eur, actual_fare_eur, demand_index, supply_index, epoch_us(ts) AS ts_us FROM w""")
def wide_events(v: Views):
    return normalize_events(v.offers, v.order_events, v.context_signals).select(
        "topic", "event_type", "event_id", "offer_id", "order_id", "courier_id", "status", "zone_id", "source",
        "source_platform", "estimated_fare_eur", "actual_fare_eur", "demand_index", "supply_index",
        F.unix_micros("ts").alias("ts_us"))


REPLAY_SQL = f"""WITH {WIDE_SQL},
e AS (SELECT ts, topic, coalesce(event_id, '') AS event_id, courier_id, status, source_platform, NULL::double AS lat FROM w WHERE topic = 'order-events-v1'
  AND ts BETWEEN TIMESTAMP '2024-01-01 00:15:00' AND TIMESTAMP '2024-01-01 00:45:00' ORDER BY ts DESC, courier_id, event_id LIMIT 300),
p AS (SELECT ts, 'livreurs-gps' AS topic, '' AS event_id, courier_id, status, 'position_lake' AS source_platform, lat FROM positions
  WHERE ts BETWEEN TIMESTAMP '2024-01-01 00:15:00' AND TIMESTAMP '2024-01-01 00:45:00' ORDER BY ts DESC, courier_id LIMIT 300)
SELECT epoch_us(ts) AS ts_us, topic, event_id, courier_id, status, source_platform, lat FROM (SELECT * FROM e UNION ALL SELECT * FROM p)
ORDER BY ts DESC, courier_id, event_id LIMIT 300"""


@report("replay_tail", REPLAY_SQL)
def replay_tail(v: Views):
    events = normalize_events(order_events=v.order_events)
    tail = replay.replay_tail(events, v.positions, datetime(2024, 1, 1, 0, 15), datetime(2024, 1, 1, 0, 45), limit=300)
    return tail.select(F.unix_micros("ts").alias("ts_us"), "topic", "event_id", "courier_id", "status", "source_platform", "lat")


@report("replay_union", """SELECT topic, event_type, status, count(*) AS n, count(lat) AS located, count(actual_fare_eur) AS paid FROM (
SELECT 'order-events-v1' AS topic, 'order.event.v1' AS event_type, status, NULL::double AS lat, actual_fare_eur FROM order_events
UNION ALL SELECT 'livreurs-gps', 'courier.position.v1', coalesce(status, 'unknown'), lat, NULL FROM positions) GROUP BY ALL""")
def replay_union(v: Views):
    union = replay.replay(normalize_events(order_events=v.order_events), v.positions)
    return union.groupBy("topic", "event_type", "status").agg(
        F.count("*").alias("n"), F.count("lat").alias("located"), F.count("actual_fare_eur").alias("paid"))


@report("focus_trail", """SELECT event_id, lat, lon, speed_kmh FROM positions WHERE courier_id = 'drv_0042' ORDER BY ts DESC, event_id DESC LIMIT 60""")
def focus_trail(v: Views):
    from courierworks.operators.tracks import focus_trail as trail

    return trail(v.positions, "drv_0042", 60).select("event_id", "lat", "lon", "speed_kmh")


@report("dedupe_offers_per_courier_zone", """SELECT courier_id, zone_id, offer_id FROM (SELECT *, row_number() OVER (
  PARTITION BY courier_id, zone_id ORDER BY ts, offer_id) AS rn FROM offers) WHERE rn = 1""")
def dedupe_offers(v: Views):
    return dedupe_keep_first(v.offers, ["courier_id", "zone_id"], [F.asc("ts"), F.asc("offer_id")]).select(
        "courier_id", "zone_id", "offer_id")
