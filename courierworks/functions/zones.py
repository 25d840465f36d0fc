"""Zone outlook, repositioning cost and dispatch strategies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courierworks.functions.cost import fuel_cost_usd
from courierworks.functions.geo import haversine_km
from courierworks.functions.num import ColumnLike, at_least, clamp, col_of

BASE_SPEED_KMH = 24.0

# The parameters of the three dispatch strategies.
STRATEGIES = {
    "conservative": {
        "eta_limit_multiplier": 0.85, "forecast_horizon_multiplier": 0.8, "opportunity_current_weight": 0.58,
        "opportunity_forecast_weight": 0.42, "weight_opportunity": 0.34, "weight_eta": 0.17, "weight_pressure": 0.15,
        "weight_target_need": 0.14, "weight_net_gain": 0.16, "penalty_cost": 0.19, "penalty_volatility": 0.12,
        "negative_net_gain_guard": -0.5, "delta_threshold": 0.12, "min_net_gain_for_reposition": 0.1,
    },
    "balanced": {
        "eta_limit_multiplier": 1.0, "forecast_horizon_multiplier": 1.0, "opportunity_current_weight": 0.45,
        "opportunity_forecast_weight": 0.55, "weight_opportunity": 0.32, "weight_eta": 0.16, "weight_pressure": 0.14,
        "weight_target_need": 0.12, "weight_net_gain": 0.2, "penalty_cost": 0.14, "penalty_volatility": 0.08,
        "negative_net_gain_guard": -1.0, "delta_threshold": 0.1, "min_net_gain_for_reposition": -0.5,
    },
    "aggressive": {
        "eta_limit_multiplier": 1.2, "forecast_horizon_multiplier": 1.25, "opportunity_current_weight": 0.34,
        "opportunity_forecast_weight": 0.66, "weight_opportunity": 0.29, "weight_eta": 0.12, "weight_pressure": 0.14,
        "weight_target_need": 0.12, "weight_net_gain": 0.25, "penalty_cost": 0.1, "penalty_volatility": 0.06,
        "negative_net_gain_guard": -2.1, "delta_threshold": 0.08, "min_net_gain_for_reposition": -1.0,
    },
}


def strategy_name(value: ColumnLike) -> Column:
    word = F.lower(F.trim(col_of(value)))
    return F.when(word.isin("conservative", "aggressive"), word).otherwise(F.lit("balanced"))


def strategy_value(strategy: ColumnLike, name: str) -> Column:
    """One parameter of the row's strategy."""
    word = strategy_name(strategy)
    return (F.when(word == "conservative", F.lit(STRATEGIES["conservative"][name]))
            .when(word == "aggressive", F.lit(STRATEGIES["aggressive"][name]))
            .otherwise(F.lit(STRATEGIES["balanced"][name])))


def forecast_zone(demand: Column, supply: Column, weather: Column, traffic: Column, boost: Column, trend: Column,
                  horizon: Column) -> dict[str, Column]:
    """Expected demand, supply, pressure, opportunity and volatility of a zone after `horizon` minutes."""
    scale = clamp(horizon / 30.0, 0.5, 2.5)
    jam = at_least(traffic - 1.0, 0.0)
    demand_then = at_least(
        demand + trend * (0.4 + 0.22 * scale) + boost * 0.7 + (weather - 1.0) * 0.25 - jam * 0.35 * scale, 0.3)
    supply_then = at_least(supply * (1.0 + jam * 0.18 * scale), 0.2)
    pressure = demand_then / supply_then
    return {
        "forecast_demand_index": demand_then, "forecast_supply_index": supply_then,
        "forecast_pressure_ratio": pressure,
        "forecast_opportunity_score": at_least(pressure * weather / at_least(traffic, 0.2), 0.0),
        "forecast_volatility": clamp(F.abs(trend) * 1.7 + F.abs(traffic - 1.0) * 0.95 + F.abs(weather - 1.0) * 0.55),
    }


def reposition_cost(km: Column, eta_min: Column, fuel_price: Column, mpg: Column, target_eur_h: Column,
                    traffic: Column, volatility: Column) -> dict[str, Column]:
    """Fuel, time and risk cost of a drive to another zone and its penalty between 0 and 1."""
    fuel = fuel_cost_usd(km, mpg, fuel_price)
    time = at_least(eta_min / 60.0 * (at_least(target_eur_h, 8.0) * 0.32), 0.0)
    risk = time * 0.22 * (1.0 + clamp(at_least(traffic - 1.0, 0.0) * 0.8 + volatility, 0.0, 1.5))
    total = fuel + time + risk
    return {
        "travel_cost_usd": fuel, "time_cost_eur": time, "risk_cost_eur": risk, "reposition_total_cost_eur": total,
        "reposition_cost_penalty": clamp(total / at_least(target_eur_h * 0.55, 6.0)),
    }


def leg_eta_min(km: Column, traffic: Column) -> Column:
    """Minutes for a distance: 24 km/h slowed by traffic, not under 8 km/h; at least one minute."""
    speed = at_least(BASE_SPEED_KMH / at_least(traffic, 0.6), 8.0)
    return at_least(km / speed * 60.0, 1.0)


def reposition_leg(lat1: ColumnLike, lon1: ColumnLike, lat2: ColumnLike, lon2: ColumnLike,
                   traffic: Column) -> tuple[Column, Column]:
    km = haversine_km(lat1, lon1, lat2, lon2)
    return km, leg_eta_min(km, traffic)


def dispatch_decision(stay_score: Column, stay_gap: Column, stay_eur_h: Column, move_score: Column, move_eta: Column,
                      move_potential: Column, max_eta: Column, move_gain: Column, gain_guard: Column,
                      delta_threshold: Column, min_gain: Column) -> Column:
    """Struct {decision, confidence, reasons}: stay, reposition or wait. The first rule that holds decides."""
    delta = move_score - stay_score
    near = move_eta <= max_eta
    outcome = lambda decision, confidence, *reasons: F.struct(
        F.lit(decision).alias("decision"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"),
        F.array(*[F.lit(r) for r in reasons]).alias("reasons"))
    rules = [
        ((stay_score <= 0) & (move_score <= 0), outcome("wait", 0.2, "insufficient_real_time_candidates")),
        ((stay_score <= 0) & near, outcome("reposition", at_least(move_score, 0.45), "no_profitable_local_offer")),
        (stay_score <= 0, outcome("wait", 0.3, "no_profitable_local_offer", "reposition_eta_too_high")),
        (move_score <= 0, outcome("stay", at_least(stay_score, 0.45), "best_local_offer_available")),
        ((move_gain < gain_guard) & (stay_score >= 0.35),
         outcome("stay", at_least(stay_score, 0.44), "reposition_net_gain_negative")),
        ((stay_score >= 0.72) & (delta < 0.13), outcome("stay", at_least(stay_score, 0.5), "strong_local_offer_available")),
        ((delta >= delta_threshold) & near & (move_gain >= min_gain),
         outcome("reposition", clamp(0.55 + delta * 0.9, 0.45, 0.98), "zone_opportunity_outweighs_local_offer")),
        ((stay_gap < -2.5) & (move_potential >= stay_eur_h + 2.0) & (move_gain >= 0) & near,
         outcome("reposition", at_least(move_score, 0.48), "below_hourly_target_reposition_can_help")),
        (~near & (stay_score >= 0.4), outcome("stay", at_least(stay_score, 0.45), "reposition_eta_too_high")),
        ((stay_score < 0.35) & near & (move_gain >= 1.0),
         outcome("reposition", at_least(move_score, 0.46), "local_offer_weak_reposition_has_positive_edge")),
    ]
    chain = F.when(*rules[0])
    for condition, value in rules[1:]:
        chain = chain.when(condition, value)
    return chain.otherwise(outcome("stay", at_least(stay_score, 0.42), "best_local_offer_available"))
