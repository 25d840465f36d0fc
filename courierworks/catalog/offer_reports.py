"""Reports over offers: features, scores, explanations, rankings and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierworks.catalog.registry import haversine, r, report
from courierworks.functions import scoring
from courierworks.functions.num import round_half_up
from courierworks.operators import fleet, offers, profiles
from courierworks.sources.adapters import Views


def clamp(x: str, low: float = 0.0, high: float = 1.0) -> str:
    return f"greatest(least({x}, {high}::double), {low}::double)"


# Context columns that the offers table of the tests lacks, as functions of the columns it has.
CONTEXT = {
    "distance_to_pickup_km": "abs(pickup_lat - dropoff_lat) * 30.0D",
    "eta_to_pickup_min": "abs(pickup_lat - dropoff_lat) * 75.0D",
    "supply_index": "weather_factor - 0.5D",
    "event_pressure": "traffic_factor / 5.0D",
    "event_count_nearby": "floor(demand_index * 3.0D)",
    "weather_precip_mm": "(weather_factor - 0.85D) * 6.0D",
    "weather_wind_kmh": "traffic_factor * 12.0D",
    "temporal_hour_local": "floor(estimated_fare_eur)",
    "is_peak_hour": "CASE WHEN demand_index > 1.6D THEN 1.0D ELSE 0.0D END",
    "is_weekend": "CASE WHEN estimated_fare_eur > 20.0D THEN 1.0D ELSE 0.0D END",
    "is_holiday": "CASE WHEN estimated_fare_eur < 5.0D THEN 1.0D ELSE 0.0D END",
    "context_fallback_applied": "CASE WHEN traffic_factor > 1.3D THEN 1.0D ELSE 0.0D END",
    "context_stale_sources": "floor(traffic_factor * 3.0D) - 1.0D",
    "platform_fee_pct": "20.0D + floor(demand_index * 6.0D)",
}


def inputs(v: Views) -> DataFrame:
    return v.offers.selectExpr("*", *[f"cast({text} as double) AS {name}" for name, text in CONTEXT.items()])


def scored(v: Views, details: bool = False) -> DataFrame:
    return offers.score_offers(inputs(v), v.driver_profiles, details=details)


PROFILES_SQL = f"""dp AS (SELECT courier_id, {r(clamp('coalesce(target_eur_h, 18.0::double)', 0, 150), 3)} AS target_eur_h,
  {r(clamp('coalesce(vehicle_mpg, 31.0::double)', 1, 120), 3)} AS vehicle_mpg, {r(clamp('coalesce(aversion_risque, 0.5::double)'), 3)} AS aversion_risque,
  {r(clamp('coalesce(max_eta, 20.0::double)', 3, 60), 3)} AS max_eta FROM driver_profiles),
pf AS (SELECT *, CASE WHEN aversion_risque >= 0.67 THEN 'conservative' WHEN aversion_risque <= 0.33 THEN 'aggressive' ELSE 'balanced' END AS dispatch_strategy FROM dp)"""
_CONTEXT_SQL = ", ".join(f"cast({t} as double) AS {n}" for n, t in CONTEXT.items()).replace("0D", "0::double").replace("5D", "5::double").replace("6D", "6::double").replace("3D", "3::double")
FEATURES_SQL = f"""{PROFILES_SQL},
si AS (SELECT o.*, {_CONTEXT_SQL}, coalesce(pf.target_eur_h, 18.0::double) AS target_hourly_net_eur, coalesce(pf.vehicle_mpg, 31.0::double) AS vehicle_mpg,
  coalesce(pf.aversion_risque, 0.5::double) AS risk, coalesce(pf.max_eta, 20.0::double) AS max_eta, coalesce(pf.dispatch_strategy, 'balanced') AS dispatch_strategy
  FROM offers o LEFT JOIN pf USING (courier_id)),
s1 AS (SELECT * REPLACE (greatest(supply_index, 0.2::double) AS supply_index, greatest(weather_precip_mm, 0) AS weather_precip_mm,
    {clamp('temporal_hour_local', -1, 24)} AS temporal_hour_local, greatest(context_stale_sources, 0) AS context_stale_sources) FROM si),
s2 AS (SELECT *, {clamp('weather_precip_mm / 6 * 0.65::double + weather_wind_kmh / 50 * 0.35::double')} AS weather_intensity,
    is_peak_hour * 0.14::double + CASE WHEN temporal_hour_local >= 11 AND temporal_hour_local < 14 AND is_peak_hour < 0.5 THEN 0.05::double ELSE 0 END
      + is_weekend * 0.08::double + is_holiday * 0.12::double AS temporal_pressure,
    estimated_distance_km + distance_to_pickup_km AS total_distance_km, greatest(1.0::double, estimated_duration_min + eta_to_pickup_min) AS total_duration_min,
    (estimated_distance_km + distance_to_pickup_km) * 0.621371::double / vehicle_mpg * 3.65::double AS fuel_cost_usd,
    estimated_fare_eur * (platform_fee_pct / 100) AS platform_fee_eur FROM s1),
s3 AS (SELECT *, estimated_fare_eur - fuel_cost_usd - platform_fee_eur AS estimated_net_eur, demand_index / supply_index AS pressure_ratio,
    fuel_cost_usd / greatest(estimated_fare_eur, 0.01::double) AS fuel_share FROM s2),
f AS (SELECT *, estimated_net_eur / total_duration_min * 60 AS estimated_net_eur_h, estimated_net_eur / total_duration_min * 60 - target_hourly_net_eur AS gap FROM s3)"""
COMPONENTS_SQL = f"""{FEATURES_SQL},
c AS (SELECT *, {clamp('(estimated_net_eur_h + 5) / 35')} AS net_hourly, {clamp('(estimated_net_eur + 1.5::double) / 18')} AS net_trip,
    1 - {clamp('(fuel_share - 0.06::double) / 0.25::double')} AS fuel_efficiency, 1 - {clamp('(total_duration_min - 14) / 32')} AS time_efficiency,
    {clamp(f'''{clamp('pressure_ratio - 0.75::double')} * 0.47::double + {clamp('(weather_factor - 0.85::double) / 0.35::double')} * 0.18::double
      + (1 - {clamp('(traffic_factor - 0.9::double) / 0.7::double')}) * 0.17::double
      + {clamp('event_pressure / 0.8::double * 0.72::double + least(event_count_nearby, 5) / 5 * 0.28::double')} * 0.10::double
      + {clamp('temporal_pressure / 0.35::double * 0.7::double + (is_peak_hour * 0.55::double + is_weekend * 0.25::double + is_holiday * 0.20::double)')} * 0.08::double
      + weather_intensity * 0.06::double - ({clamp('context_stale_sources / 4')} * 0.22::double + context_fallback_applied * 0.12::double)''')} AS context FROM f)"""
SCORED_SQL = f"""{COMPONENTS_SQL},
a AS (SELECT *, {clamp('0.06::double + 0.88::double * (net_hourly * 0.46::double + net_trip * 0.18::double + fuel_efficiency * 0.16::double + time_efficiency * 0.12::double + context * 0.08::double)', 0.01, 0.99)} AS accept_score FROM c),
b AS (SELECT *, {clamp('(gap + 8) / 16')} AS target_part, {clamp('(pressure_ratio - 0.8::double) / 1.2::double')} AS pressure_part,
    {clamp(f"{clamp('1 - distance_to_pickup_km / 5')} * 0.58::double + time_efficiency * 0.42::double")} AS w_time, fuel_efficiency AS w_fuel,
    {clamp(f'''{clamp('0.5::double + (risk - 0.5::double) * 0.12::double', 0.35, 0.85)}
      + CASE WHEN gap < 0 THEN {clamp('abs(gap) / 12')} * (0.12::double * (0.85::double + risk * 0.5::double)) ELSE 0 END
      + CASE WHEN fuel_share > 0.18 THEN {clamp('(fuel_share - 0.18::double) / 0.22::double')} * (0.06::double * (0.8::double + risk * 0.6::double)) ELSE 0 END
      - CASE WHEN gap > 3 THEN {clamp('(gap - 3) / 9')} * (0.04::double * (1.1::double - risk * 0.6::double)) ELSE 0 END''', 0.35, 0.9)} AS threshold,
    {clamp(f'''1 - ({clamp('(traffic_factor - 1) / 0.8::double')} * 0.28::double + weather_intensity * 0.22::double
      + {clamp('context_stale_sources / 4 * 0.65::double + context_fallback_applied * 0.35::double')} * 0.2::double
      + {clamp('greatest(-gap, 0) / 12')} * 0.18::double + {clamp('1 - accept_score')} * 0.12::double)''')} AS risk_part FROM a),
w AS (SELECT *, {clamp('accept_score * 0.62::double + target_part * 0.23::double + pressure_part * 0.15::double')} AS w_gain FROM b),
sc AS (SELECT *, {r(clamp('w_gain * 0.62::double + w_time * 0.23::double + w_fuel * 0.15::double'), 4)} AS objective_score,
    CASE WHEN accept_score >= threshold THEN 'accept' ELSE 'reject' END AS decision, estimated_net_eur_h AS eur_per_hour_net FROM w),
scored AS (SELECT *, CASE WHEN objective_score >= 0.68 THEN 'accept' WHEN objective_score >= 0.45 THEN 'consider' ELSE 'skip' END AS action FROM sc)"""


@report("driver_profiles", f"WITH {PROFILES_SQL} SELECT * FROM pf")
def driver_profiles(v: Views):
    return profiles.normalize_driver_profile(v.driver_profiles)


@report("upsert_profiles", f"""WITH u AS (SELECT courier_id, max_by(baseline_eur_h, completed_at) FILTER (WHERE baseline_eur_h IS NOT NULL) AS t,
    max_by(final_distance_km * 2, completed_at) AS a FROM (SELECT *, row_number() OVER (PARTITION BY courier_id ORDER BY completed_at DESC, mission_id) AS rn FROM mission_journal) GROUP BY 1)
SELECT coalesce(d.courier_id, u.courier_id) AS courier_id, {r(clamp('coalesce(u.t, d.target_eur_h, 18.0::double)', 0, 150), 3)} AS target_eur_h,
  {r(clamp('coalesce(u.a, d.aversion_risque, 0.5::double)'), 3)} AS aversion_risque, {r(clamp('coalesce(d.max_eta, 20.0::double)', 3, 60), 3)} AS max_eta
FROM driver_profiles d FULL JOIN u ON u.courier_id = d.courier_id""")
def upsert_profiles(v: Views):
    updates = v.mission_journal.select(
        "courier_id", F.col("baseline_eur_h").alias("target_eur_h"), F.lit(None).cast("double").alias("vehicle_mpg"),
        (F.col("final_distance_km") * 2).alias("aversion_risque"), F.lit(None).cast("double").alias("max_eta"),
        F.col("completed_at").alias("updated_at"))
    return profiles.upsert_profiles(v.driver_profiles, updates).select("courier_id", "target_eur_h", "aversion_risque", "max_eta")


FEATURE_OUT = ["total_distance_km", "total_duration_min", "weather_intensity", "temporal_pressure", "fuel_cost_usd",
               "platform_fee_eur", "estimated_net_eur", "pressure_ratio", "estimated_net_eur_h"]


@report("feature_map", f"WITH {FEATURES_SQL} SELECT offer_id, {', '.join(f'{r(c, 6)} AS {c}' for c in FEATURE_OUT)}, {r('gap', 6)} AS target_gap_eur_h FROM f")
def feature_map(v: Views):
    rows = profiles.with_profile(inputs(v), v.driver_profiles).withColumn("target_hourly_net_eur", F.col("target_eur_h"))
    return scoring.add_features(rows).select("offer_id", *[round_half_up(c, 6).alias(c) for c in [*FEATURE_OUT, "target_gap_eur_h"]])


COMPONENTS = ["net_hourly", "net_trip", "fuel_efficiency", "time_efficiency", "context"]


@report("score_components", f"WITH {COMPONENTS_SQL} SELECT offer_id, {', '.join(f'{r(c, 6)} AS {c}' for c in COMPONENTS)} FROM c")
def score_components(v: Views):
    parts = scoring.score_components()
    return scored(v).select("offer_id", *[round_half_up(parts[c], 6).alias(c) for c in COMPONENTS])


@report("score_offers", f"""WITH {SCORED_SQL} SELECT offer_id, courier_id, {r('accept_score', 6)} AS accept_score, {r('threshold', 6)} AS decision_threshold, decision,
  objective_score, objective_score AS recommendation_score, action AS recommendation_action, 'heuristic' AS model_used FROM scored""")
def score_offers(v: Views):
    return scored(v).select("offer_id", "courier_id", round_half_up("accept_score", 6).alias("accept_score"),
                            round_half_up("decision_threshold", 6).alias("decision_threshold"), "decision",
                            "objective_score", "recommendation_score", "recommendation_action", "model_used")


REASONS_SQL = """coalesce(nullif(concat_ws(',', CASE WHEN estimated_net_eur_h >= 22 THEN 'high_estimated_net_revenue' WHEN estimated_net_eur_h < 14 THEN 'low_estimated_net_revenue' END,
  CASE WHEN gap >= 2 THEN 'above_target_hourly_goal' WHEN gap < -2 THEN 'below_target_hourly_goal' END,
  CASE WHEN pressure_ratio >= 1.25 THEN 'strong_demand_pressure' WHEN pressure_ratio < 0.9 THEN 'weak_demand_pressure' END,
  CASE WHEN weather_factor < 0.95 THEN 'weather_downside' END, CASE WHEN traffic_factor > 1.2 THEN 'traffic_penalty' END,
  CASE WHEN event_pressure >= 0.12 THEN 'event_demand_uplift' END, CASE WHEN temporal_pressure >= 0.1 THEN 'temporal_demand_uplift' END,
  CASE WHEN context_fallback_applied >= 0.5 THEN 'context_fallback_mode' END,
  CASE WHEN total_duration_min >= 35 THEN 'long_offer_duration' WHEN total_duration_min <= 15 AND estimated_net_eur_h >= 18 THEN 'short_offer_efficiency' END,
  CASE WHEN platform_fee_pct >= 30 THEN 'high_platform_fee' END, CASE WHEN estimated_fare_eur > 0 AND fuel_cost_usd / estimated_fare_eur > 0.2 THEN 'fuel_cost_penalty' END,
  CASE WHEN least(distance_to_pickup_km / greatest(total_distance_km, 0.1), 1) > 0.45 THEN 'long_pickup_detour' END), ''), 'balanced_offer_profile')"""
SIGNALS_SQL = """concat_ws(',', CASE WHEN gap >= 2 THEN 'above_target_hourly_goal' WHEN gap < -2 THEN 'below_target_hourly_goal' END,
  CASE WHEN pressure_ratio >= 1.3 THEN 'zone_high_demand_pressure' WHEN pressure_ratio < 0.95 THEN 'zone_low_demand_pressure' END,
  CASE WHEN distance_to_pickup_km > 3 THEN 'pickup_far' WHEN distance_to_pickup_km <= 1 THEN 'pickup_near' END,
  CASE WHEN w_time <= 0.35 THEN 'time_efficiency_low' END, CASE WHEN w_fuel <= 0.35 THEN 'fuel_efficiency_low' END)"""
_LEVEL = "CASE WHEN {s} >= 0.65 THEN '{hi}' WHEN {s} <= 0.4 THEN '{lo}' END"
CODES_SQL = f"""coalesce(nullif(concat_ws(',', {', '.join(_LEVEL.format(s=r(s, 4), hi=hi, lo=lo) for s, hi, lo in [
    ('w_gain', 'GAIN_STRONG', 'GAIN_WEAK'), ('w_time', 'TIME_EFFICIENT', 'TIME_HEAVY'), ('w_fuel', 'FUEL_EFFICIENT', 'FUEL_HEAVY'), ('risk_part', 'RISK_LOW', 'RISK_HIGH')])},
  CASE WHEN gap >= 2 THEN 'TARGET_ABOVE' WHEN gap <= -2 THEN 'TARGET_BELOW' END, CASE WHEN context_fallback_applied >= 0.5 THEN 'CONTEXT_FALLBACK' END,
  CASE WHEN context_stale_sources >= 2 THEN 'CONTEXT_STALE' END, CASE WHEN accept_score >= threshold + 0.1::double THEN 'DECISION_CONFIDENT'
  WHEN accept_score >= threshold THEN 'DECISION_BORDERLINE' ELSE 'DECISION_BELOW_THRESHOLD' END), ''), 'PROFILE_BALANCED')"""


@report("offer_explanations", f"""WITH {SCORED_SQL} SELECT offer_id, {REASONS_SQL} AS reasons, {SIGNALS_SQL} AS signals, {CODES_SQL} AS reason_codes,
  {r(clamp('w_gain * 0.42::double + w_time * 0.2::double + w_fuel * 0.18::double + risk_part * 0.2::double'), 4)} AS total_score,
  {r('risk_part', 4)} AS risk_score, {r('w_gain * 0.42::double', 4)} AS gain_contribution,
  CASE WHEN w_time >= 0.62 THEN 'positive' WHEN w_time <= 0.42 THEN 'negative' ELSE 'neutral' END AS time_impact FROM scored""")
def offer_explanations(v: Views):
    b = F.col("breakdown")
    return scored(v).select(
        "offer_id", F.array_join("reasons", ",").alias("reasons"), F.array_join("signals", ",").alias("signals"),
        F.array_join("reason_codes", ",").alias("reason_codes"), b["total_score"].alias("total_score"),
        b["risk"]["score"].alias("risk_score"), b["gain"]["contribution"].alias("gain_contribution"),
        b["time"]["impact"].alias("time_impact"))


def _impact(x: str, hi: float, lo: float, words: tuple[str, str, str] = ("positive", "neutral", "negative"), strict: bool = False) -> str:
    return f"CASE WHEN {x} >= {hi} THEN '{words[0]}' WHEN {x} {'<=' if strict else '<'} {lo} THEN '{words[2]}' ELSE '{words[1]}' END"


_BAD = ("negative", "neutral", "positive")
_DETAILS = [("net_hourly", "estimated_net_eur_h", 3, _impact("estimated_net_eur_h", 20, 12, strict=True)),
            ("net_trip", "estimated_net_eur", 3, _impact("estimated_net_eur", 8, 3, strict=True)),
            ("fuel_share_of_fare", "fuel_share * 100", 3, _impact("fuel_share * 100", 22, 12, _BAD)),
            ("total_time", "total_duration_min", 3, _impact("total_duration_min", 35, 22, _BAD)),
            ("target_gap", "gap", 3, _impact("gap", 1, -1, strict=True)),
            ("demand_pressure", "pressure_ratio", 3, _impact("pressure_ratio", 1.2, 0.9, strict=True)),
            ("traffic_factor", "traffic_factor", 3, _impact("traffic_factor", 1.2, 1.05, _BAD)),
            ("event_pressure", "event_pressure", 4, _impact("event_pressure", 0.18, 0.05)),
            ("temporal_pressure", "temporal_pressure", 4, _impact("temporal_pressure", 0.14, 0.06)),
            ("weather_intensity", "weather_intensity", 4, _impact("weather_intensity", 0.22, 0.08)),
            ("context_fallback", "context_fallback_applied", 3, "CASE WHEN context_fallback_applied >= 0.5 THEN 'negative' ELSE 'neutral' END"),
            ("context_stale_sources", "context_stale_sources", 3, "CASE WHEN context_stale_sources >= 2 THEN 'negative' ELSE 'neutral' END"),
            ("score_component_net_hourly", "net_hourly", 3, _impact("net_hourly", 0.62, 0.42, strict=True)),
            ("score_component_fuel", "fuel_efficiency", 3, _impact("fuel_efficiency", 0.62, 0.42, strict=True)),
            ("accept_score", "accept_score", 4, _impact("accept_score", 0.65, 0.45, strict=True)),
            ("decision_threshold", "threshold", 4, "'neutral'")]


@report("explanation_details", f"WITH {SCORED_SQL} " + " UNION ALL ".join(
    f"SELECT offer_id, '{code}' AS code, {r(value, digits)} AS value, {impact} AS impact FROM scored" for code, value, digits, impact in _DETAILS))
def explanation_details(v: Views):
    rows = scored(v, details=True).select("offer_id", F.explode("details").alias("d"))
    return rows.select("offer_id", "d.code", "d.value", "d.impact")


COSTS = ["estimated_fare_eur", "total_distance_km", "total_duration_min", "fuel_cost_usd", "platform_fee_eur",
         "estimated_net_eur", "estimated_net_eur_h", "target_hourly_net_eur"]


@report("cost_breakdown", f"WITH {FEATURES_SQL} SELECT offer_id, {', '.join(f'{r(c, 3)} AS {c}' for c in COSTS)} FROM f")
def cost_breakdown(v: Views):
    return scored(v, details=True).select("offer_id", *[F.col("costs")[c].alias(c) for c in COSTS])


RANK_SQL = f"""{SCORED_SQL},
k AS (SELECT *, row_number() OVER o AS rank, count(*) OVER p AS n, first_value(eur_per_hour_net) OVER q AS best, last_value(eur_per_hour_net) OVER q AS worst,
    coalesce(nth_value(eur_per_hour_net, 2) OVER q, first_value(eur_per_hour_net) OVER q) AS second, row_number() OVER (PARTITION BY courier_id ORDER BY eur_per_hour_net, offer_id) AS place
  FROM scored WINDOW o AS (PARTITION BY courier_id ORDER BY eur_per_hour_net DESC, estimated_net_eur DESC, accept_score DESC, offer_id), p AS (PARTITION BY courier_id),
    q AS (PARTITION BY courier_id ORDER BY eur_per_hour_net DESC, estimated_net_eur DESC, accept_score DESC, offer_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
m AS (SELECT courier_id, max(eur_per_hour_net) AS median FROM k WHERE place = n // 2 + 1 GROUP BY 1),
ranked AS (SELECT k.*, median, CASE WHEN eur_per_hour_net < 9 THEN 'reject' WHEN rank = 1 AND eur_per_hour_net >= 14 AND (n <= 1 OR eur_per_hour_net - second >= 1) THEN 'top_pick'
    WHEN target_hourly_net_eur > 0 AND eur_per_hour_net < target_hourly_net_eur - 0.75::double THEN 'below_target' ELSE 'viable' END AS recommendation
  FROM k JOIN m USING (courier_id))"""


@report("rank_offers", f"""WITH {RANK_SQL} SELECT courier_id, offer_id, rank, recommendation, {r('eur_per_hour_net - best', 2)} AS delta_vs_top_eur_h,
  {r('eur_per_hour_net - median', 2)} AS delta_vs_median_eur_h FROM ranked""")
def rank_offers(v: Views):
    return offers.rank_offers(scored(v), "courier_id").select(
        "courier_id", "offer_id", "rank", "recommendation", "delta_vs_top_eur_h", "delta_vs_median_eur_h")


@report("offer_set_summary", f"""WITH {RANK_SQL} SELECT courier_id, count(*) AS offers, max(CASE WHEN recommendation = 'top_pick' THEN offer_id END) AS top_pick_offer_id,
  {r('min(best)', 2)} AS best_eur_h, {r('min(worst)', 2)} AS worst_eur_h, {r('min(median)', 2)} AS median_eur_h, {r('min(best) - min(worst)', 2)} AS gain_vs_worst_eur_h
FROM ranked GROUP BY 1""")
def offer_set_summary(v: Views):
    return offers.offer_set_summary(offers.rank_offers(scored(v), "courier_id"), "courier_id")


@report("driver_offer_list", f"""WITH {SCORED_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY courier_id ORDER BY accept_score DESC, eur_per_hour_net DESC, offer_id) AS rank,
    count(*) OVER (PARTITION BY courier_id) AS offers, count(*) FILTER (WHERE decision = 'accept') OVER (PARTITION BY courier_id) AS accepted FROM scored WHERE accept_score >= 0.3)
SELECT courier_id, offer_id, rank, offers, accepted, {r('accepted * 100.0::double / offers', 1)} AS accept_rate_pct FROM l WHERE rank <= 20""")
def driver_offer_list(v: Views):
    return offers.driver_offer_list(scored(v), "score", 20, 0.3).select(
        "courier_id", "offer_id", F.col("rank").cast("long").alias("rank"), "offers", "accepted", "accept_rate_pct")


@report("offer_quality", f"""WITH {SCORED_SQL} SELECT count(*) AS offers, count(*) FILTER (WHERE decision = 'accept') AS accepted, count(*) FILTER (WHERE decision = 'reject') AS rejected,
  0::bigint AS unknown, {r("count(*) FILTER (WHERE decision = 'accept') * 100.0::double / count(*)", 2)} AS accept_rate_pct,
  {r("count(*) FILTER (WHERE decision = 'reject') * 100.0::double / count(*)", 2)} AS reject_rate_pct, {r('avg(accept_score)', 4)} AS avg_accept_score,
  {r('avg(eur_per_hour_net)', 4)} AS avg_eur_per_hour_net, (SELECT offer_id FROM scored ORDER BY accept_score DESC, eur_per_hour_net DESC, offer_id DESC LIMIT 1) AS top_offer_id FROM scored""")
def offer_quality(v: Views):
    return offers.offer_quality(scored(v))


LATEST = """latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY courier_id
  ORDER BY ts DESC, event_id) AS rn FROM positions) WHERE rn = 1)"""
AROUND_OFFERS = f"""{LATEST}, ro AS (SELECT * FROM offers),
no AS (SELECT ro.*, {r(haversine('l.lat', 'l.lon', 'ro.pickup_lat', 'ro.pickup_lon'), 3)} AS near_km FROM ro JOIN latest l USING (courier_id)
  WHERE {haversine('l.lat', 'l.lon', 'ro.pickup_lat', 'ro.pickup_lon')} <= 8.0)"""


def _around(text: str) -> str:
    """The scoring text over the nearby offers instead of all of them."""
    return text.replace("FROM offers o LEFT JOIN", "FROM no o LEFT JOIN").replace(
        "cast(abs(pickup_lat - dropoff_lat) * 30.0::double as double) AS distance_to_pickup_km", "near_km AS distance_to_pickup_km")


AROUND_SQL = f"""{AROUND_OFFERS}, {_around(SCORED_SQL)},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY courier_id ORDER BY objective_score DESC, accept_score DESC, eur_per_hour_net DESC, offer_id) AS rank FROM scored) WHERE rank <= 5)"""


def around(v: Views) -> DataFrame:
    rows = inputs(v).drop("distance_to_pickup_km")
    return offers.best_offers_around(rows, fleet.latest_positions(v.positions), v.driver_profiles, radius_km=8.0)


@report("best_offers_around", f"WITH {AROUND_SQL} SELECT courier_id, offer_id, rank, objective_score AS recommendation_score, action AS recommendation_action, {r('accept_score', 6)} AS accept_score FROM best")
def best_offers_around(v: Views):
    return around(v).select("courier_id", "offer_id", F.col("rank").cast("long").alias("rank"), "recommendation_score",
                            "recommendation_action", round_half_up("accept_score", 6).alias("accept_score"))


@report("offer_action_counts", f"""WITH {AROUND_SQL} SELECT courier_id, count(*) FILTER (WHERE action = 'accept') AS accept, count(*) FILTER (WHERE action = 'consider') AS consider,
  count(*) FILTER (WHERE action = 'skip') AS skip FROM best GROUP BY 1""")
def offer_action_counts(v: Views):
    return offers.action_counts(around(v))


@report("offer_coach", f"""WITH {SCORED_SQL} SELECT offer_id, CASE WHEN traffic_factor >= 1.22 THEN 'Heavy' WHEN traffic_factor >= 1.08 THEN 'Moderate' ELSE 'Light' END AS traffic,
  CASE action WHEN 'accept' THEN 'Take' WHEN 'consider' THEN 'Maybe' ELSE CASE WHEN accept_score >= 0.7 THEN 'Take' WHEN accept_score >= 0.45 THEN 'Maybe' ELSE 'Skip' END END AS badge,
  CASE WHEN traffic_factor >= 1.22 THEN 'Heavy traffic may stretch the ETA.' WHEN fuel_cost_usd >= 2.8 THEN 'Fuel burn is noticeable on this run.'
    WHEN gap < -1 THEN 'This delivery sits below your current hourly target.' ELSE 'Routing is estimated rather than OSRM-verified.' END AS warning,
  accept_score >= 0.75 AS confident FROM scored""")
def offer_coach(v: Views):
    rows = scored(v, details=True).withColumn("coach", offers.coach_reasons())
    return rows.select("offer_id", offers.traffic_level(F.col("traffic_factor")).alias("traffic"),
                       offers.decision_badge(F.col("recommendation_action"), F.col("accept_score")).alias("badge"),
                       offers.coach_warning().alias("warning"),
                       F.exists("coach", lambda t: t.startswith("High copilot confidence")).alias("confident"))
