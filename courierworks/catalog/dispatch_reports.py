"""Reports that tell drivers where to go, and the missions that came of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierworks.catalog.context_reports import OPPORTUNITY_SQL, opportunity
from courierworks.catalog.offer_reports import AROUND_SQL, LATEST, PROFILES_SQL, around, clamp
from courierworks.catalog.registry import haversine, r, report
from courierworks.functions import zones as fz
from courierworks.functions.num import round_half_up
from courierworks.operators import fleet, missions, profiles
from courierworks.operators.keyed import top_per_key
from courierworks.plans import dispatch
from courierworks.session import stage
from courierworks.sources.adapters import Views


def drivers(v: Views) -> DataFrame:
    latest = fleet.latest_positions(v.positions).select("courier_id", "lat", "lon", "status", "ts")
    return profiles.with_profile(latest, v.driver_profiles)


DRIVERS_SQL = f"""{LATEST}, {PROFILES_SQL},
dr AS (SELECT l.courier_id, l.lat, l.lon, l.status, l.ts, coalesce(target_eur_h, 18.0::double) AS target_eur_h, coalesce(vehicle_mpg, 31.0::double) AS vehicle_mpg,
  coalesce(aversion_risque, 0.5::double) AS risk, coalesce(dispatch_strategy, 'balanced') AS strategy FROM latest l LEFT JOIN pf USING (courier_id))"""
BASE_SQL = f"WITH RECURSIVE {OPPORTUNITY_SQL}, {DRIVERS_SQL}"
KM = haversine("d.lat", "d.lon", "z.lat", "z.lon")
NEXT_SQL = f"""nz AS (SELECT courier_id, zone_id, opportunity, km, 0.3::double * least(km / 15, 1) AS pen FROM (SELECT d.courier_id, z.zone_id, z.opportunity, {KM} AS km FROM dr d, zop z)),
nr AS (SELECT *, {r('greatest(0, greatest(opportunity, 0) * (1 - pen))', 3)} AS adjusted FROM nz),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY courier_id ORDER BY adjusted DESC, zone_id) AS rank FROM nr) WHERE rank <= 5)"""


@report("next_best_zone", f"""{BASE_SQL}, {NEXT_SQL} SELECT courier_id, zone_id, rank, {r('km', 3)} AS distance_km, {r('km / 24 * 60', 2)} AS reposition_time_min,
  {r('pen', 4)} AS distance_penalty_pct, adjusted AS adjusted_opportunity_score FROM nb""")
def next_best_zone(v: Views):
    out = dispatch.next_best_zone(drivers(v), opportunity(v), 5, distance_weight=0.3)
    return out.select("courier_id", "zone_id", F.col("rank").cast("long").alias("rank"), "distance_km", "reposition_time_min",
                      "distance_penalty_pct", "adjusted_opportunity_score")


@report("next_best_zone_homeward", f"""{BASE_SQL},
h AS (SELECT d.courier_id, z.zone_id, z.opportunity, {KM} AS km, {haversine('d.lat', 'd.lon', '40.72', '-73.85')} AS dh, {haversine('z.lat', 'z.lon', '40.72', '-73.85')} AS zh FROM dr d, zop z),
g AS (SELECT *, 0.3::double * least(km / 15, 1) AS pen, CASE WHEN dh > 0.1 THEN greatest(-1, least(1, (dh - zh) / dh)) END AS hf FROM h WHERE km <= 12.0),
a AS (SELECT *, {r('greatest(0, greatest(opportunity, 0) * (1 - pen + CASE WHEN hf > 0 THEN hf * 0.3::double * 0.6::double ELSE 0 END))', 3)} AS adjusted FROM g)
SELECT courier_id, zone_id, rank, {r('hf', 3)} AS homeward_factor, adjusted AS adjusted_opportunity_score FROM (SELECT *, row_number() OVER (PARTITION BY courier_id ORDER BY adjusted DESC, zone_id) AS rank FROM a) WHERE rank <= 5""")
def next_best_zone_homeward(v: Views):
    people = drivers(v).withColumns({"home_lat": F.lit(40.72), "home_lon": F.lit(-73.85)})
    out = dispatch.next_best_zone(people, opportunity(v), 5, distance_weight=0.3, max_distance_km=12.0, with_home=True)
    return out.select("courier_id", "zone_id", F.col("rank").cast("long").alias("rank"), "homeward_factor", "adjusted_opportunity_score")


ETA = "greatest(1, km / greatest(8, 24 / greatest(traffic, 0.6)) * 60)"
SHIFT_SQL = f"""fz AS (SELECT *, greatest(0.3::double, demand + ema * 0.84::double + (weather - 1) * 0.25::double - greatest(0, traffic - 1) * 0.35::double * 2) AS fd,
  greatest(0.2::double, supply * (1 + greatest(0, traffic - 1) * 0.18::double * 2)) AS fs, least(1, abs(ema) * 1.7::double + abs(traffic - 1) * 0.95::double + abs(weather - 1) * 0.55::double) AS vol FROM zop),
sh AS (SELECT d.courier_id, d.target_eur_h AS target, d.vehicle_mpg AS mpg, z.*, {KM} AS km FROM dr d, fz z),
sh2 AS (SELECT *, {ETA} AS eta, {r('greatest(0, opportunity * (1 - 0.3::double * least(km / 15, 1)) * 0.44::double + fd / fs * weather / traffic * 0.56::double)', 9)} AS shift FROM sh),
sh3 AS (SELECT *, km * 0.621371::double / mpg * 3.65::double + greatest(0, eta / 60 * greatest(target, 8) * 0.32::double) * (1 + 0.22::double * (1 + least(1.5, greatest(traffic - 1, 0) * 0.8::double + vol))) AS cost,
  target * {clamp('0.82::double + (shift - 1) * 0.48::double', 0.6, 1.85)} AS gross FROM sh2),
sh4 AS (SELECT *, greatest(gross - cost, 0) AS net, {r(clamp(f"0.35::double + {clamp('(shift - 0.7::double) / 1.15::double')} * 0.43::double + (1 - vol) * 0.24::double - {clamp('context_stale_sources / 5.0::double')} * 0.12::double", 0.08, 0.98), 4)} AS confidence FROM sh3),
sh5 AS (SELECT *, {r('shift', 4)} AS shift4, {r('net', 2)} AS net2 FROM sh4),
sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY courier_id ORDER BY shift4 DESC, net2 DESC, confidence DESC, zone_id) AS rank FROM sh5) WHERE rank <= 3)"""


def shift(v: Views) -> DataFrame:
    return dispatch.shift_plan(drivers(v), opportunity(v), 60, 3)


@report("shift_plan", f"""{BASE_SQL}, {SHIFT_SQL} SELECT courier_id, zone_id, rank, shift4 AS shift_score, net2 AS estimated_net_eur_h, confidence, {r('eta', 2)} AS eta_min,
  {r('cost', 2)} AS reposition_total_cost_eur, fd / fs >= 1.25 AS strong FROM sp""")
def shift_plan(v: Views):
    return shift(v).select("courier_id", "zone_id", F.col("rank").cast("long").alias("rank"), "shift_score", "estimated_net_eur_h", "confidence",
                           "eta_min", "reposition_total_cost_eur", F.exists("reasons", lambda x: x.startswith("Strong forecast")).alias("strong"))


def _setting(name: str) -> str:
    s = fz.STRATEGIES
    return f"(CASE strategy WHEN 'conservative' THEN {s['conservative'][name]}::double WHEN 'aggressive' THEN {s['aggressive'][name]}::double ELSE {s['balanced'][name]}::double END)"


_STAY = f"""st AS (SELECT dr.*, b.offer_id AS stay_offer_id, coalesce(b.objective_score, 0) AS stay_score, coalesce(b.gap, -6) AS stay_gap, coalesce(b.eur_per_hour_net, 0) AS stay_eur,
  coalesce(b.target_hourly_net_eur, 18) AS target FROM dr LEFT JOIN (SELECT * FROM best WHERE rank = 1) b USING (courier_id))"""
OPTIONS_SQL = f"""{BASE_SQL}, {AROUND_SQL.replace(LATEST + ',', '', 1).replace(PROFILES_SQL + ',', '', 1)}, {_STAY},
o1 AS (SELECT d.*, z.zone_id, z.demand, z.supply, z.weather, z.traffic, z.ema, z.opportunity, {KM} AS km, {clamp('20::double * ' + _setting('eta_limit_multiplier'), 3, 60)} AS max_eta,
    {clamp('(' + clamp('30::double * ' + _setting('forecast_horizon_multiplier'), 10, 90) + ') / 30', 0.5, 2.5)} AS scale FROM st d, zop z),
o2 AS (SELECT *, {ETA} AS eta, greatest(0.3::double, demand + ema * (0.4::double + 0.22::double * scale) + (weather - 1) * 0.25::double - greatest(0, traffic - 1) * 0.35::double * scale) AS fd,
  greatest(0.2::double, supply * (1 + greatest(0, traffic - 1) * 0.18::double * scale)) AS fs, least(1, abs(ema) * 1.7::double + abs(traffic - 1) * 0.95::double + abs(weather - 1) * 0.55::double) AS vol FROM o1),
o3 AS (SELECT *, greatest(0, eta / 60 * greatest(target, 8) * 0.32::double) AS tc, opportunity * {_setting('opportunity_current_weight')} + fd / fs * weather / traffic * {_setting('opportunity_forecast_weight')} AS opp FROM o2 WHERE eta <= max_eta * 1.8::double),
o4 AS (SELECT *, km * 0.621371::double / vehicle_mpg * 3.65::double + tc + tc * 0.22::double * (1 + least(1.5, greatest(traffic - 1, 0) * 0.8::double + vol)) AS cost,
  target * {clamp('0.85::double + (opp - 1) * 0.45::double', 0.65, 1.65)} AS potential FROM o3),
o5 AS (SELECT *, greatest(0, potential - cost * 0.85::double) AS adj, greatest(0, potential - cost * 0.85::double) - stay_eur AS gain, least(1, cost / greatest(6, target * 0.55::double)) AS pen,
  0.8::double + risk * 0.8::double AS rk, 1.05::double - risk * 0.35::double AS rw FROM o4),
o6 AS (SELECT *, {r(clamp(f'''{_setting('weight_opportunity')} * rw * {clamp('(opp - 0.8::double) / 1.4::double')} + {_setting('weight_eta')} * rk * {clamp('1 - eta / max_eta')}
  + {_setting('weight_pressure')} * rw * {clamp('(fd / fs - 0.85::double) / 1.2::double')} + {_setting('weight_target_need')} * rw * {clamp('(4 - stay_gap) / 12')}
  + {_setting('weight_net_gain')} * rw * {clamp('(gain + 5) / 14')} - {_setting('penalty_cost')} * rk * pen - {_setting('penalty_volatility')} * rk * vol'''), 4)} AS score FROM o5),
op AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY courier_id ORDER BY score DESC, {r('adj', 2)} DESC, {r('eta', 2)}, zone_id) AS rank FROM o6) WHERE rank <= 5)"""


def stay(v: Views) -> DataFrame:
    return dispatch.with_stay(drivers(v), around(v))


@report("reposition_options", f"""{OPTIONS_SQL} SELECT courier_id, zone_id, rank, score AS dispatch_score, {r('adj', 2)} AS risk_adjusted_potential_eur_h, {r('gain', 2)} AS net_gain_vs_stay_eur_h,
  {r('eta', 2)} AS eta_min, {r('cost', 2)} AS reposition_total_cost_eur FROM op""")
def reposition_options(v: Views):
    return dispatch.reposition_options(stay(v), opportunity(v)).select(
        "courier_id", "zone_id", F.col("rank").cast("long").alias("rank"), "dispatch_score", "risk_adjusted_potential_eur_h",
        "net_gain_vs_stay_eur_h", "eta_min", "reposition_total_cost_eur")


DISPATCH_SQL = f"""{OPTIONS_SQL},
mv AS (SELECT st.*, op.zone_id AS move_zone_id, coalesce(op.score, 0) AS ms, coalesce({r('op.eta', 2)}, 999) AS me, coalesce({r('op.adj', 2)}, 0) AS mp, coalesce({r('op.gain', 2)}, 0) AS mg,
  {clamp('20::double * ' + _setting('eta_limit_multiplier').replace('strategy', 'st.strategy'), 3, 60)} AS mx FROM st LEFT JOIN op ON op.courier_id = st.courier_id AND op.rank = 1),
dc AS (SELECT *, CASE WHEN stay_score <= 0 AND ms <= 0 THEN 1 WHEN stay_score <= 0 AND me <= mx THEN 2 WHEN stay_score <= 0 THEN 3 WHEN ms <= 0 THEN 4
  WHEN mg < {_setting('negative_net_gain_guard')} + risk * 0.6::double AND stay_score >= 0.35 THEN 5 WHEN stay_score >= 0.72 AND ms - stay_score < 0.13 THEN 6
  WHEN ms - stay_score >= {_setting('delta_threshold')} + risk * 0.05::double AND me <= mx AND mg >= {_setting('min_net_gain_for_reposition')} + risk * 0.7::double THEN 7
  WHEN stay_gap < -2.5 AND mp >= stay_eur + 2 AND mg >= 0 AND me <= mx THEN 8 WHEN me > mx AND stay_score >= 0.4 THEN 9 WHEN stay_score < 0.35 AND me <= mx AND mg >= 1 THEN 10 ELSE 11 END AS rule FROM mv)"""


@report("instant_dispatch", f"""{DISPATCH_SQL} SELECT courier_id, strategy AS dispatch_strategy, CASE WHEN rule IN (1, 3) THEN 'wait' WHEN rule IN (2, 7, 8, 10) THEN 'reposition' ELSE 'stay' END AS decision,
  {r('''CASE rule WHEN 1 THEN 0.2::double WHEN 2 THEN greatest(0.45::double, ms) WHEN 3 THEN 0.3::double WHEN 4 THEN greatest(0.45::double, stay_score) WHEN 5 THEN greatest(0.44::double, stay_score)
    WHEN 6 THEN greatest(0.5::double, stay_score) WHEN 7 THEN greatest(0.45::double, least(0.98::double, 0.55::double + (ms - stay_score) * 0.9::double)) WHEN 8 THEN greatest(0.48::double, ms)
    WHEN 9 THEN greatest(0.45::double, stay_score) WHEN 10 THEN greatest(0.46::double, ms) ELSE greatest(0.42::double, stay_score) END''', 4)} AS confidence, stay_offer_id, move_zone_id FROM dc""")
def instant_dispatch(v: Views):
    rows = stay(v).withColumn("max_reposition_eta_min", F.lit(20.0))
    options = dispatch.reposition_options(rows, opportunity(v))
    return dispatch.instant_dispatch(rows, options).drop("reasons")


@report("market_zones", f"""WITH RECURSIVE {OPPORTUNITY_SQL}, mz AS (SELECT zone_id, greatest(demand, 0) / supply AS s, context_stale_sources <= 2 AS fresh FROM zop),
mp AS (SELECT * FROM mz WHERE fresh OR NOT (SELECT bool_or(fresh) FROM mz)),
mr AS (SELECT *, row_number() OVER (ORDER BY s DESC, zone_id) AS h, row_number() OVER (ORDER BY s, zone_id) AS c FROM mp)
SELECT 'hot' AS kind, h AS rank, zone_id, {r('s', 4)} AS market_score, CASE WHEN s >= 1.2 THEN 'Hot right now' ELSE 'Calm / low demand' END AS label, NOT fresh AS stale FROM mr WHERE h <= 5
UNION ALL SELECT 'calm', c, zone_id, {r('s', 4)}, CASE WHEN s >= 1.2 THEN 'Hot right now' ELSE 'Calm / low demand' END, NOT fresh FROM mr WHERE c <= 5""")
def market_zones(v: Views):
    return dispatch.market_zones(opportunity(v))


@report("market_moves", f"""{BASE_SQL}, {NEXT_SQL}, t AS (SELECT nb.*, dr.target_eur_h AS target, {r('km / 24 * 60', 2)} AS eta FROM nb JOIN dr USING (courier_id) WHERE opportunity >= 1.02),
u AS (SELECT *, {clamp('0.46::double + greatest(opportunity - 1, 0) * 0.28::double + CASE WHEN eta > 0 AND eta <= 12 THEN 0.05::double ELSE 0 END', 0.42, 0.94)} AS ds FROM t)
SELECT courier_id, zone_id, rank, {r('ds', 4)} AS dispatch_score, {r('target + greatest((opportunity - 1) * 7, CASE WHEN opportunity >= 1.08 THEN 0.5::double ELSE 0 END)', 2)} AS potential_eur_h,
  CASE WHEN ds >= 0.68 THEN 'Take' ELSE 'Maybe' END AS badge FROM u""")
def market_moves(v: Views):
    people = drivers(v)
    best = dispatch.next_best_zone(people, opportunity(v), 5, distance_weight=0.3).join(people.select("courier_id", "target_eur_h"), "courier_id")
    return dispatch.market_reposition(best, F.col("target_eur_h")).withColumn("rank", F.col("rank").cast("long"))


NEAR, PLAIN, MOVERS, PLANNED = ["available"], ["available", "delivering"], ["available", "delivering", "idle"], ["available", "delivering", "idle"]
MARKET = ["available", "delivering", "idle", "repositioning"]


def _with_status(words: list[str]) -> str:
    return "dr.status IN (" + ", ".join(f"'{w}'" for w in words) + ")"


BRIEF_SQL = f"""{OPTIONS_SQL}, {SHIFT_SQL}, {NEXT_SQL},
wn AS (SELECT courier_id, list(offer_id ORDER BY rank) AS a FROM best JOIN dr USING (courier_id) WHERE rank <= 3 AND {_with_status(NEAR)} GROUP BY 1),
wp AS (SELECT courier_id, list(offer_id ORDER BY rank) AS a FROM (SELECT courier_id, offer_id, row_number() OVER (PARTITION BY courier_id ORDER BY ts DESC, offer_id) AS rank FROM offers) JOIN dr USING (courier_id)
  WHERE rank <= 3 AND {_with_status(PLAIN)} GROUP BY 1),
wm AS (SELECT courier_id, list(op.zone_id ORDER BY rank) AS a FROM op JOIN dr USING (courier_id) WHERE rank <= 3 AND {_with_status(MOVERS)} GROUP BY 1),
wk AS (SELECT courier_id, list(zone_id ORDER BY rank) AS a FROM nb JOIN dr USING (courier_id) WHERE rank <= 3 AND opportunity >= 1.02 AND {_with_status(MARKET)} GROUP BY 1),
ws AS (SELECT courier_id, string_agg(zone_id, ',' ORDER BY rank) AS a FROM sp JOIN dr USING (courier_id) WHERE {_with_status(PLANNED)} GROUP BY 1),
wx AS (SELECT courier_id, string_agg(zone_id, ',' ORDER BY rank) AS a FROM nb WHERE rank <= 3 GROUP BY 1),
wr AS (SELECT d.courier_id, coalesce(wn.a, wp.a) IS NOT NULL AS offer, wm.a IS NOT NULL AS moves, coalesce(wn.a, wp.a, wm.a, wk.a) AS a, coalesce(wm.a[1], wk.a[1]) AS move, ws.a IS NOT NULL AS planned, coalesce(ws.a, wx.a, '') AS shift_zones
  FROM dr d LEFT JOIN wn USING (courier_id) LEFT JOIN wp USING (courier_id) LEFT JOIN wm USING (courier_id) LEFT JOIN wk USING (courier_id) LEFT JOIN ws USING (courier_id) LEFT JOIN wx USING (courier_id))
SELECT courier_id, CASE WHEN offer THEN 'offer' WHEN moves THEN 'reposition' WHEN a IS NOT NULL THEN 'market_reposition' ELSE 'hold' END AS primary_kind, a[1] AS primary_id,
  concat_ws(',', a[2], a[3], CASE WHEN offer THEN move END) AS alternatives, planned, shift_zones FROM wr"""


@report("driver_brief", BRIEF_SQL)
def driver_brief(v: Views):
    """Every source of a brief; who is busy sees fewer of them, so all paths from a nearby offer to hold occur."""
    people, zones = stay(v), opportunity(v)
    status = people.select("courier_id", "status")
    seen_by = lambda df, words: df.join(status.where(F.col("status").isin(words)).select("courier_id"), "courier_id", "left_semi")
    listed = top_per_key(v.offers.select("courier_id", "offer_id", "ts"), ["courier_id"], [F.desc("ts"), F.asc("offer_id")], 3, rank="rank")
    best = dispatch.next_best_zone(people, zones, 5, distance_weight=0.3).join(people.select("courier_id", "target_eur_h"), "courier_id")
    best = stage(best)
    brief = dispatch.driver_brief(
        people, seen_by(around(v), NEAR), seen_by(listed, PLAIN), seen_by(dispatch.reposition_options(people, zones), MOVERS),
        seen_by(dispatch.market_reposition(best, F.col("target_eur_h")), MARKET), seen_by(shift(v), PLANNED), dispatch.market_shift_items(best, F.col("target_eur_h")))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["id"]), ",")
    return brief.select("courier_id", "primary_kind", "primary_id", ids("alternatives").alias("alternatives"),
                        F.coalesce(F.try_element_at("shift_items", F.lit(1))["kind"] == "shift", F.lit(False)).alias("planned"), ids("shift_items").alias("shift_zones"))


LIVE_SQL = f"""{BASE_SQL}, nd AS (SELECT d.courier_id, d.status, z.zone_id, z.demand, z.supply, {KM} AS km, row_number() OVER (PARTITION BY d.courier_id ORDER BY {KM}, z.zone_id) AS rn FROM dr d, zop z),
lo AS (SELECT courier_id, status, zone_id, demand, {r('demand / greatest(supply, 0.01)', 4)} AS pressure, {r(clamp('demand / greatest(supply, 0.01) / 5 * 0.6::double + demand * 0.4::double'), 3)} AS opp FROM nd WHERE rn = 1)"""


def live_opportunity(v: Views) -> DataFrame:
    return dispatch.driver_opportunity(fleet.latest_positions(v.positions), opportunity(v), v.zones)


@report("driver_opportunity", f"{LIVE_SQL} SELECT courier_id, zone_id, pressure AS pressure_ratio, opp AS driver_opportunity, CASE WHEN opp >= 0.7 THEN 'accept_next' WHEN opp >= 0.45 THEN 'reposition' ELSE 'hold' END AS best_action FROM lo")
def driver_opportunity(v: Views):
    return live_opportunity(v).select("courier_id", "zone_id", "pressure_ratio", "driver_opportunity", "best_action")


@report("fleet_overview", f"""{LIVE_SQL}, zc AS (SELECT zone_id, count(*) AS n FROM lo GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
ot AS (SELECT lo.courier_id, opp FROM lo JOIN latest USING (courier_id) ORDER BY opp DESC, latest.ts DESC, lo.courier_id DESC LIMIT 10)
SELECT (SELECT count(*) FROM lo) AS active_drivers, (SELECT {r('avg(demand)', 4)} FROM lo) AS avg_demand_index, (SELECT {r('avg(pressure)', 4)} FROM lo) AS avg_pressure_ratio,
  (SELECT string_agg(zone_id, ',' ORDER BY n DESC, zone_id) FROM zc) AS top_zones, (SELECT count(*) FROM lo WHERE status = 'delivering') AS delivering,
  (SELECT string_agg(courier_id, ',' ORDER BY opp DESC, courier_id) FROM ot WHERE opp >= 0.6) AS top_opportunities""")
def fleet_overview(v: Views):
    row = dispatch.fleet_overview(live_opportunity(v))
    return row.select("active_drivers", "avg_demand_index", "avg_pressure_ratio", F.array_join("top_zones", ",").alias("top_zones"),
                      F.coalesce(F.col("status_distribution")["delivering"], F.lit(0)).alias("delivering"),
                      F.array_join("top_opportunities", ",").alias("top_opportunities"))


@report("rank_live_drivers", f"""{LIVE_SQL}, oc AS (SELECT courier_id, count(*) AS n FROM offers GROUP BY 1)
SELECT l.courier_id, l.status, coalesce(oc.n, 0) AS offer_count, lo.opp AS opportunity, CASE WHEN coalesce(oc.n, 0) > 0 THEN 100.0::double ELSE 0 END + coalesce(oc.n, 0) * 12.0::double + lo.opp * 10.0::double
  + CASE WHEN l.status IN ('available', 'idle') THEN 8 WHEN l.status LIKE 'pickup%' THEN 6 WHEN l.status = 'repositioning' THEN 5 WHEN l.status = 'delivering' THEN 4 ELSE 0 END AS rank_score
FROM latest l LEFT JOIN oc USING (courier_id) JOIN lo USING (courier_id)""")
def rank_live_drivers(v: Views):
    counts = v.offers.groupBy("courier_id").agg(F.count("*").alias("offer_count"))
    latest = fleet.latest_positions(v.positions).select("courier_id", "status")
    return dispatch.rank_live_drivers(latest, counts, live_opportunity(v).select("courier_id", "driver_opportunity"))


@report("driver_position", f"""{BASE_SQL}, cell AS (SELECT courier_id, {r('lat', 6)} AS lat, {r('lon', 6)} AS lon, printf('%.3f', round(lat / 0.02::double, 0) * 0.02::double) || '_' || printf('%.3f', round(lon / 0.02::double, 0) * 0.02::double) AS zone_cell FROM latest),
zs AS (SELECT printf('%.3f', round(lat / 0.02::double, 0) * 0.02::double) || '_' || printf('%.3f', round(lon / 0.02::double, 0) * 0.02::double) AS zone_cell, max(opportunity) AS zone_opportunity FROM zop GROUP BY 1)
SELECT courier_id, lat, lon, zone_cell, zone_opportunity FROM cell LEFT JOIN zs USING (zone_cell)""")
def driver_position(v: Views):
    from courierworks.functions.geo import grid_zone_id

    context_by_cell = opportunity(v).groupBy(grid_zone_id("lat", "lon").alias("zone_cell")).agg(F.max("opportunity_score").alias("zone_opportunity"))
    latest = fleet.latest_positions(v.positions).select(
        "courier_id", round_half_up("lat", 6).alias("lat"), round_half_up("lon", 6).alias("lon"), grid_zone_id("lat", "lon").alias("zone_cell"))
    return latest.join(context_by_cell, "zone_cell", "left")


OUTCOME_SQL = f"""mo AS (SELECT *, {r('predicted_potential_eur_h - baseline_eur_h', 3)} AS pd, {r('realized_best_offer_eur_h - baseline_eur_h', 3)} AS rd FROM mission_journal),
ms AS (SELECT *, CASE WHEN rd IS NOT NULL THEN rd >= 0 ELSE final_distance_km <= 0.25 END AS success, CASE WHEN rd IS NOT NULL AND pd IS NOT NULL THEN {r(clamp('1 - abs(rd - pd) / 8'), 4)} END AS al FROM mo),
mj AS (SELECT * FROM ms)"""
STATS_SQL = f"""count(*) AS missions, count(*) FILTER (WHERE success) AS successes, {r('count(*) FILTER (WHERE success) * 100.0::double / count(*)', 2)} AS success_rate_pct, {r('avg(elapsed_min)', 3)} AS avg_elapsed_min,
  {r('avg(pd)', 3)} AS avg_predicted_delta_eur_h, {r('avg(rd)', 3)} AS avg_realized_delta_eur_h, {r('count(*) FILTER (WHERE rd >= 0) * 100.0::double / nullif(count(rd), 0)', 2)} AS realized_win_rate_pct, {r('avg(al)', 4)} AS avg_alignment_score"""


@report("mission_outcomes", f"WITH {OUTCOME_SQL} SELECT mission_id, dispatch_strategy, pd AS predicted_delta_eur_h, rd AS realized_delta_eur_h, success, al AS alignment_score FROM ms")
def mission_outcomes(v: Views):
    return missions.mission_outcomes(v.mission_journal).select(
        "mission_id", "dispatch_strategy", "predicted_delta_eur_h", "realized_delta_eur_h", "success", "alignment_score")


@report("mission_stats", f"""WITH {OUTCOME_SQL} SELECT courier_id, {STATS_SQL}, count(*) FILTER (WHERE dispatch_strategy = 'conservative') AS conservative_missions,
  count(*) FILTER (WHERE dispatch_strategy = 'balanced') AS balanced_missions, count(*) FILTER (WHERE dispatch_strategy = 'aggressive') AS aggressive_missions, epoch_us(max(completed_at)) AS latest_us FROM mj GROUP BY 1""")
def mission_stats(v: Views):
    stats = missions.mission_stats(missions.journal(missions.mission_outcomes(v.mission_journal)))
    return stats.withColumn("latest_us", F.unix_micros("latest_completed_at")).drop("latest_completed_at")


@report("session_report", f"""WITH {OUTCOME_SQL}, f AS (SELECT courier_id, {STATS_SQL} FROM mj GROUP BY 1),
z AS (SELECT courier_id, string_agg(zone_id, ',' ORDER BY n DESC, zone_id) AS top_zones FROM (SELECT courier_id, zone_id, count(*) AS n, row_number() OVER (PARTITION BY courier_id ORDER BY count(*) DESC, zone_id) AS rn FROM mj GROUP BY 1, 2) WHERE rn <= 5 GROUP BY 1)
SELECT f.*, top_zones FROM f JOIN z USING (courier_id)""")
def session_report(v: Views):
    return missions.session_report(missions.journal(missions.mission_outcomes(v.mission_journal))).withColumn(
        "top_zones", F.array_join("top_zones", ","))
