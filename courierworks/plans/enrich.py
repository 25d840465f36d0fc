"""Offers joined to the state of their courier and zone at the time of the offer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierworks.functions.cost import fuel_cost_usd
from courierworks.functions.geo import haversine_km
from courierworks.functions.num import at_least, clamp, round_half_up
from courierworks.functions.scoring import either, words
from courierworks.operators.keyed import asof_left

ZONE_DEFAULTS = {
    "event_pressure": 0.0, "event_count_nearby": 0, "weather_precip_mm": 0.0, "weather_wind_kmh": 0.0,
    "weather_intensity": 0.0, "temporal_hour_local": -1.0, "is_peak_hour": 0, "is_weekend": 0, "is_holiday": 0,
    "temporal_pressure": 0.0, "context_fallback_applied": 0, "context_stale_sources": 0, "gbfs_demand_boost": 0.0,
}


def enrich_offers(offers: DataFrame, positions: DataFrame, zone_signals: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """Offer features from the newest courier position and zone signal at or before the offer.

    `zone_signals` are parsed signals. The net revenue here has no platform fee and is not below -2.
    """
    couriers = positions.select("courier_id", F.col("ts").alias("courier_ts"), "event_id", F.col("lat").alias("courier_lat"),
                                F.col("lon").alias("courier_lon"), F.col("speed_kmh").alias("courier_speed"), F.col("status").alias("courier_status"))
    have = [c for c in ZONE_DEFAULTS if c in zone_signals.columns]
    zones = zone_signals.select("zone_id", F.col("ts").alias("zone_ts"), F.col("event_id").alias("signal_id"),
                                *[F.col(c).alias(f"zone_{c}") for c in ["demand_index", "supply_index", "weather_factor", "traffic_factor"]], *have)
    rows = asof_left(offers, couriers, "courier_id", "ts", "courier_ts", "event_id",
                     ["courier_lat", "courier_lon", "courier_speed", "courier_status"], hot_rows=hot_rows)
    rows = asof_left(rows, zones, "zone_id", "ts", "zone_ts", "signal_id",
                     [c for c in zones.columns if c not in ("zone_id", "zone_ts", "signal_id")], hot_rows=hot_rows)
    missing = {c: F.lit(ZONE_DEFAULTS[c]) for c in ZONE_DEFAULTS if c not in have}
    rows = rows.withColumns({**{c: F.coalesce(c, F.lit(ZONE_DEFAULTS[c])) for c in have}, **missing})
    km = F.coalesce(haversine_km("courier_lat", "courier_lon", "pickup_lat", "pickup_lon"), F.lit(0.0))
    rows = rows.withColumns({
        "__km": km, "__speed": at_least(F.coalesce("courier_speed", F.lit(18.0)), 6.0),
        "demand_index": F.coalesce("zone_demand_index", "demand_index") + F.col("gbfs_demand_boost"),
        "supply_index": at_least(F.coalesce("zone_supply_index", F.lit(1.0)), 0.2),
        "weather_factor": F.coalesce("zone_weather_factor", "weather_factor"),
        "traffic_factor": at_least(F.coalesce("zone_traffic_factor", "traffic_factor"), 0.2)})
    rows = rows.withColumns({"__eta": F.col("__km") / F.col("__speed") * 60.0,
                             "__fuel": fuel_cost_usd(F.col("__km") + at_least("estimated_distance_km", 0.0))})
    net = at_least(F.col("estimated_fare_eur") - F.col("__fuel"), -2.0)
    rows = rows.withColumns({
        "__hourly": net / at_least(F.col("estimated_duration_min") + F.col("__eta"), 1.0) * 60.0,
        "__pressure": F.col("demand_index") / F.col("supply_index")})
    h, p, t = F.col("__hourly"), F.col("__pressure"), F.col("traffic_factor")
    logit = (h - 16.0) / 10.0 + (p - 1.0) * 0.9 + (F.col("weather_factor") - 1.0) * 0.4 - (t - 1.0) * 0.35
    explanation = words([
        either((h >= 22, "high_net_revenue"), (h < 14, "low_net_revenue")),
        either((p >= 1.25, "high_demand_pressure"), (p < 0.9, "low_demand_pressure")),
        either((t > 1.2, "traffic_penalty")), either((F.col("courier_status") == "delivering", "courier_busy"))])
    keep = [c for c in offers.columns if c not in ("demand_index", "supply_index", "weather_factor", "traffic_factor")]
    return rows.select(
        *keep, "courier_lat", "courier_lon", F.coalesce("courier_status", F.lit("unknown")).alias("courier_status"),
        *[round_half_up(c, 3).alias(c) for c in ["demand_index", "supply_index", "weather_factor", "traffic_factor"]],
        *[c for c in ZONE_DEFAULTS if c != "gbfs_demand_boost"],
        round_half_up("__km", 3).alias("distance_to_pickup_km"), round_half_up("__eta", 3).alias("eta_to_pickup_min"),
        round_half_up(p, 3).alias("pressure_ratio"), round_half_up("__fuel", 3).alias("fuel_cost_usd"),
        round_half_up(h, 3).alias("eur_per_hour_net"),
        round_half_up(clamp(1.0 / (1.0 + F.exp(-logit)), 0.01, 0.99), 4).alias("accept_score_heuristic"), explanation.alias("explanation"))
