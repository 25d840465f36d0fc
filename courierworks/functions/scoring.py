"""Offer features, scores, decisions and explanations.

`add_features` turns raw offer columns into the feature columns; the other functions are expressions
over those columns, so a scored table is one projection without Python in the row path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierworks.functions.cost import FUEL_PRICE_USD_GALLON, VEHICLE_MPG, fuel_cost_usd
from courierworks.functions.num import clamp, col_of, finite, flag, round_half_up

# The weights of the scores.
SCORE_WEIGHTS = {"net_hourly": 0.46, "net_trip": 0.18, "fuel_efficiency": 0.16, "time_efficiency": 0.12, "context": 0.08}
OBJECTIVE_WEIGHTS = {"w_gain": 0.62, "w_time": 0.23, "w_fuel": 0.15}
EXPLAIN_WEIGHTS = {"gain": 0.42, "time": 0.2, "fuel": 0.18, "risk": 0.2}

RAW_DEFAULTS = {
    "estimated_fare_eur": 0.0, "estimated_distance_km": 0.0, "estimated_duration_min": 1.0,
    "distance_to_pickup_km": 0.0, "eta_to_pickup_min": 0.0, "demand_index": 1.0, "supply_index": 1.0,
    "weather_factor": 1.0, "traffic_factor": 1.0, "event_pressure": 0.0, "event_count_nearby": 0.0,
    "weather_precip_mm": 0.0, "weather_wind_kmh": 0.0, "temporal_hour_local": -1.0, "is_peak_hour": 0.0,
    "is_weekend": 0.0, "is_holiday": 0.0, "context_fallback_applied": 0.0, "context_stale_sources": 0.0,
    "fuel_price_usd_gallon": FUEL_PRICE_USD_GALLON, "vehicle_mpg": VEHICLE_MPG, "platform_fee_pct": 25.0,
    "other_costs_eur": 0.0, "target_hourly_net_eur": 18.0,
}
# Lower and upper bounds of the raw inputs (None: unbounded).
RAW_BOUNDS = {
    "estimated_fare_eur": (0.0, None), "estimated_distance_km": (0.0, None), "estimated_duration_min": (1.0, None),
    "distance_to_pickup_km": (0.0, None), "eta_to_pickup_min": (0.0, None), "supply_index": (0.2, None),
    "event_pressure": (0.0, None), "event_count_nearby": (0.0, None), "weather_precip_mm": (0.0, None),
    "weather_wind_kmh": (0.0, None), "temporal_hour_local": (-1.0, 24.0), "context_stale_sources": (0.0, None),
    "fuel_price_usd_gallon": (0.5, None), "vehicle_mpg": (1.0, None), "platform_fee_pct": (0.0, 60.0),
    "other_costs_eur": (0.0, None), "target_hourly_net_eur": (0.0, None),
}
YES_NO = ["is_peak_hour", "is_weekend", "is_holiday", "context_fallback_applied"]
FEATURES = [*RAW_DEFAULTS, "weather_intensity", "temporal_pressure", "total_distance_km", "total_duration_min",
            "fuel_cost_usd", "platform_fee_eur", "estimated_net_eur", "pressure_ratio", "estimated_net_eur_h",
            "target_gap_eur_h"]


def normalised(weights: dict[str, float] | None, defaults: dict[str, float]) -> dict[str, float]:
    """Weights scaled to sum 1; negative ones count as 0, an all-zero set falls back to the defaults."""
    merged = {key: max(0.0, float((weights or {}).get(key, value))) for key, value in defaults.items()}
    total = sum(merged.values())
    if total <= 0.0:
        merged, total = defaults, sum(defaults.values())
    return {key: value / total for key, value in merged.items()}


def add_features(offers: DataFrame) -> DataFrame:
    """The offers with every feature column; raw columns that are absent take their defaults."""
    have = set(offers.columns)

    def raw(name: str) -> Column:
        default = RAW_DEFAULTS[name]
        value = finite(name, default) if name in have else F.lit(default)
        if name in YES_NO:
            return flag(value >= 0.5)
        low, high = RAW_BOUNDS.get(name, (None, None))
        if low is not None:
            value = F.greatest(value, F.lit(low))
        if high is not None:
            value = F.least(value, F.lit(high))
        return value

    keep = [c for c in offers.columns if c not in FEATURES]
    given = [finite(c).alias(f"__{c}") for c in ("weather_intensity", "temporal_pressure") if c in have]
    base = offers.select(*keep, *given, *[raw(name).alias(name) for name in RAW_DEFAULTS])
    weather = clamp(F.col("weather_precip_mm") / 6.0 * 0.65 + F.col("weather_wind_kmh") / 50.0 * 0.35)
    midday = (F.col("temporal_hour_local") >= 11) & (F.col("temporal_hour_local") < 14) & (F.col("is_peak_hour") < 0.5)
    season = (flag(F.col("is_peak_hour") >= 0.5) * 0.14 + flag(midday) * 0.05
              + F.col("is_weekend") * 0.08 + F.col("is_holiday") * 0.12)
    given_or = lambda name, value: F.coalesce(F.col(f"__{name}"), value) if name in have else value
    km = F.col("estimated_distance_km") + F.col("distance_to_pickup_km")
    totals = base.select(
        *keep, *RAW_DEFAULTS,
        clamp(given_or("weather_intensity", weather)).alias("weather_intensity"),
        F.greatest(given_or("temporal_pressure", season), F.lit(0.0)).alias("temporal_pressure"),
        km.alias("total_distance_km"),
        F.greatest(F.lit(1.0), F.col("estimated_duration_min") + F.col("eta_to_pickup_min")).alias("total_duration_min"),
        fuel_cost_usd(km, "vehicle_mpg", "fuel_price_usd_gallon").alias("fuel_cost_usd"),
        (F.col("estimated_fare_eur") * (F.col("platform_fee_pct") / 100.0)).alias("platform_fee_eur"),
    )
    net = (F.col("estimated_fare_eur") - F.col("fuel_cost_usd") - F.col("platform_fee_eur") - F.col("other_costs_eur"))
    hourly = F.col("estimated_net_eur") / F.col("total_duration_min") * 60.0
    return totals.select("*", net.alias("estimated_net_eur"),
                         (F.col("demand_index") / F.col("supply_index")).alias("pressure_ratio")).select(
        "*", hourly.alias("estimated_net_eur_h"), (hourly - F.col("target_hourly_net_eur")).alias("target_gap_eur_h"))


def fuel_share() -> Column:
    return F.greatest(F.col("fuel_cost_usd"), F.lit(0.0)) / F.greatest(F.col("estimated_fare_eur"), F.lit(0.01))


def _fuel_component() -> Column:
    return 1.0 - clamp((fuel_share() - 0.06) / 0.25)


def _time_component() -> Column:
    return 1.0 - clamp((F.col("total_duration_min") - 14.0) / 32.0)


def score_components() -> dict[str, Column]:
    c = F.col
    event = clamp(c("event_pressure") / 0.8 * 0.72 + F.least(c("event_count_nearby"), F.lit(5.0)) / 5.0 * 0.28)
    season = clamp(c("temporal_pressure") / 0.35 * 0.7
                   + (c("is_peak_hour") * 0.55 + c("is_weekend") * 0.25 + c("is_holiday") * 0.20))
    stale = clamp(c("context_stale_sources") / 4.0) * 0.22 + c("context_fallback_applied") * 0.12
    context = (
        clamp(F.greatest(c("pressure_ratio"), F.lit(0.0)) - 0.75) * 0.47
        + clamp((F.greatest(c("weather_factor"), F.lit(0.0)) - 0.85) / 0.35) * 0.18
        + (1.0 - clamp((F.greatest(c("traffic_factor"), F.lit(0.0)) - 0.9) / 0.7)) * 0.17
        + event * 0.10 + season * 0.08 + c("weather_intensity") * 0.06
    )
    return {
        "net_hourly": clamp((c("estimated_net_eur_h") + 5.0) / 35.0),
        "net_trip": clamp((c("estimated_net_eur") + 1.5) / 18.0),
        "fuel_efficiency": _fuel_component(),
        "time_efficiency": _time_component(),
        "context": clamp(context - stale),
    }


def add_components(featured: DataFrame) -> DataFrame:
    """The five score components as columns `component_<name>`, computed once for all that reads them."""
    return featured.withColumns({f"component_{name}": value for name, value in score_components().items()})


def weighted_offer_score(weights: dict[str, float] | None = None) -> Column:
    """Score of a row with component columns."""
    shares = normalised(weights, SCORE_WEIGHTS)
    total = " + ".join(f"component_{name} * {share!r}D" for name, share in shares.items())
    return F.expr(f"greatest(least(0.06D + 0.88D * ({total}), 0.99D), 0.01D)")


def either(*cases: tuple[Column, str]) -> Column:
    """The word of the first case that holds, else NULL."""
    chain = F.when(cases[0][0], F.lit(cases[0][1]))
    for condition, word in cases[1:]:
        chain = chain.when(condition, F.lit(word))
    return chain


def words(items: list[Column], default: str | None = None) -> Column:
    """The non-NULL items as an array, or the default word when there is none."""
    found = F.array_compact(F.array(*items))
    return found if default is None else F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)


def heuristic_reasons() -> Column:
    c = F.col
    hourly, gap, pressure = c("estimated_net_eur_h"), c("target_gap_eur_h"), c("pressure_ratio")
    detour = F.least(c("distance_to_pickup_km") / F.greatest(c("total_distance_km"), F.lit(0.1)), F.lit(1.0))
    return words([
        either((hourly >= 22, "high_estimated_net_revenue"), (hourly < 14, "low_estimated_net_revenue")),
        either((gap >= 2, "above_target_hourly_goal"), (gap < -2, "below_target_hourly_goal")),
        either((pressure >= 1.25, "strong_demand_pressure"), (pressure < 0.9, "weak_demand_pressure")),
        either((c("weather_factor") < 0.95, "weather_downside")),
        either((c("traffic_factor") > 1.2, "traffic_penalty")),
        either((c("event_pressure") >= 0.12, "event_demand_uplift")),
        either((c("temporal_pressure") >= 0.1, "temporal_demand_uplift")),
        either((c("context_fallback_applied") >= 0.5, "context_fallback_mode")),
        either((c("total_duration_min") >= 35, "long_offer_duration"),
               ((c("total_duration_min") <= 15) & (hourly >= 18), "short_offer_efficiency")),
        either((c("platform_fee_pct") >= 30, "high_platform_fee")),
        either(((c("estimated_fare_eur") > 0)
                & (c("fuel_cost_usd") / F.nullif(c("estimated_fare_eur"), F.lit(0.0)) > 0.2), "fuel_cost_penalty")),
        either((detour > 0.45, "long_pickup_detour")),
    ], "balanced_offer_profile")


def objective_components(score: Column) -> dict[str, Column]:
    c = F.col
    target = clamp((c("target_gap_eur_h") + 8.0) / 16.0)
    pressure = clamp((F.greatest(c("pressure_ratio"), F.lit(0.0)) - 0.8) / 1.2)
    pickup = clamp(1.0 - c("distance_to_pickup_km") / 5.0)
    return {
        "w_gain": clamp(clamp(score) * 0.62 + target * 0.23 + pressure * 0.15),
        "w_time": clamp(pickup * 0.58 + _time_component() * 0.42),
        "w_fuel": _fuel_component(),
    }


def add_axes(scored: DataFrame) -> DataFrame:
    """The gain, time, fuel and risk axes of a row with `accept_score`, as columns `axis_<name>`."""
    score = F.col("accept_score")
    parts = objective_components(score)
    return scored.withColumns({"axis_gain": parts["w_gain"], "axis_time": parts["w_time"], "axis_fuel": parts["w_fuel"],
                               "axis_risk": risk_component(score)})


def objective_score(weights: dict[str, float] | None = None) -> Column:
    """Weighted gain, time and fuel of a row with axes."""
    shares = normalised(weights, OBJECTIVE_WEIGHTS)
    total = " + ".join(f"axis_{key[2:]} * {share!r}D" for key, share in shares.items())
    return F.expr(f"greatest(least({total}, 1.0D), 0.0D)")


def risk_component(score: Column) -> Column:
    c = F.col
    context = clamp(c("context_stale_sources") / 4.0 * 0.65 + c("context_fallback_applied") * 0.35)
    penalty = (
        clamp((F.greatest(c("traffic_factor"), F.lit(0.0)) - 1.0) / 0.8) * 0.28
        + c("weather_intensity") * 0.22 + context * 0.2
        + clamp(F.greatest(-c("target_gap_eur_h"), F.lit(0.0)) / 12.0) * 0.18 + clamp(1.0 - score) * 0.12
    )
    return clamp(1.0 - penalty)


def score_breakdown(weights: dict[str, float] | None = None) -> Column:
    """Struct with the gain, time, fuel and risk dimensions of a row with axes, and their weighted total."""
    values = {axis: F.col(f"axis_{axis}") for axis in EXPLAIN_WEIGHTS}
    shares = normalised(weights, EXPLAIN_WEIGHTS)
    labels = {"gain": "Gain quality", "time": "Time efficiency", "fuel": "Fuel efficiency", "risk": "Risk resilience"}
    dims, total = [], F.lit(0.0)
    for axis, value in values.items():
        total = total + value * F.lit(shares[axis])
        dims.append(F.struct(
            F.lit(labels[axis]).alias("label"), round_half_up(value, 4).alias("score"),
            F.lit(round(shares[axis], 4)).alias("weight"),
            round_half_up(value * F.lit(shares[axis]), 4).alias("contribution"),
            F.when(value >= 0.62, "positive").when(value <= 0.42, "negative").otherwise("neutral").alias("impact"),
        ).alias(axis))
    return F.struct(round_half_up(clamp(total), 4).alias("total_score"), *dims)


def reason_codes(breakdown: Column, score: Column, threshold: Column | None = None) -> Column:
    """Standard codes from the rounded dimension scores of a breakdown."""
    c = F.col
    level = lambda axis, high, low: either((breakdown[axis]["score"] >= 0.65, high), (breakdown[axis]["score"] <= 0.4, low))
    codes = [
        level("gain", "GAIN_STRONG", "GAIN_WEAK"), level("time", "TIME_EFFICIENT", "TIME_HEAVY"),
        level("fuel", "FUEL_EFFICIENT", "FUEL_HEAVY"), level("risk", "RISK_LOW", "RISK_HIGH"),
        either((c("target_gap_eur_h") >= 2, "TARGET_ABOVE"), (c("target_gap_eur_h") <= -2, "TARGET_BELOW")),
        either((c("context_fallback_applied") >= 0.5, "CONTEXT_FALLBACK")),
        either((c("context_stale_sources") >= 2, "CONTEXT_STALE")),
    ]
    if threshold is not None:
        codes.append(either((score >= threshold + 0.1, "DECISION_CONFIDENT"), (score >= threshold, "DECISION_BORDERLINE"),
                            (F.lit(True), "DECISION_BELOW_THRESHOLD")))
    return words(codes, "PROFILE_BALANCED")


def recommendation_action(recommended: Column) -> Column:
    return F.when(recommended >= 0.68, "accept").when(recommended >= 0.45, "consider").otherwise("skip")


def recommendation_signals() -> Column:
    c = F.col
    return words([
        either((c("target_gap_eur_h") >= 2, "above_target_hourly_goal"),
               (c("target_gap_eur_h") < -2, "below_target_hourly_goal")),
        either((c("pressure_ratio") >= 1.3, "zone_high_demand_pressure"),
               (c("pressure_ratio") < 0.95, "zone_low_demand_pressure")),
        either((c("distance_to_pickup_km") > 3, "pickup_far"), (c("distance_to_pickup_km") <= 1, "pickup_near")),
        either((c("axis_time") <= 0.35, "time_efficiency_low")),
        either((c("axis_fuel") <= 0.35, "fuel_efficiency_low")),
    ])


def accept_threshold(risk: Column | float = 0.5) -> Column:
    """Score an offer must reach, shifted by the driver's risk aversion (0 to 1, 0.5 is neutral)."""
    risk, gap = clamp(col_of(risk)), F.col("target_gap_eur_h")
    below = F.when(gap < 0, clamp(F.abs(gap) / 12.0) * (0.12 * (0.85 + risk * 0.5))).otherwise(F.lit(0.0))
    fuel = F.when(fuel_share() > 0.18, clamp((fuel_share() - 0.18) / 0.22) * (0.06 * (0.8 + risk * 0.6))).otherwise(F.lit(0.0))
    bonus = F.when(gap > 3, clamp((gap - 3.0) / 9.0) * (0.04 * (1.1 - risk * 0.6))).otherwise(F.lit(0.0))
    base = clamp(0.5 + (risk - 0.5) * 0.12, 0.35, 0.85)
    return clamp(base + below + fuel - bonus, 0.35, 0.9)


def cost_breakdown() -> Column:
    names = ["estimated_fare_eur", "total_distance_km", "total_duration_min", "fuel_cost_usd", "platform_fee_eur",
             "other_costs_eur", "estimated_net_eur", "estimated_net_eur_h", "target_hourly_net_eur", "target_gap_eur_h"]
    return F.struct(*[round_half_up(name, 3).alias(name) for name in names])


def explanation_details(score: Column, threshold: Column | None = None, route_source: Column | None = None,
                        route_minutes: Column | None = None) -> Column:
    """Array of {code, label, impact, value, unit, source} rows that explain an offer's score."""
    c = F.col
    parts = {name: c(f"component_{name}") for name in ("net_hourly", "fuel_efficiency")}
    good = lambda v, hi, lo: F.when(v >= hi, "positive").when(v <= lo, "negative").otherwise("neutral")
    bad = lambda v, hi, lo: F.when(v >= hi, "negative").when(v >= lo, "neutral").otherwise("positive")
    up = lambda v, hi, lo: F.when(v >= hi, "positive").when(v >= lo, "neutral").otherwise("negative")
    warn = lambda v, hi: F.when(v >= hi, "negative").otherwise("neutral")
    pressure = F.greatest(c("pressure_ratio"), F.lit(0.0))
    traffic = F.greatest(c("traffic_factor"), F.lit(0.0))
    share = fuel_share() * 100.0
    rows = [
        ("net_hourly", "Net hourly yield", c("estimated_net_eur_h"), good(c("estimated_net_eur_h"), 20, 12), 3, "eur_per_hour", "cost"),
        ("net_trip", "Net trip gain", c("estimated_net_eur"), good(c("estimated_net_eur"), 8, 3), 3, "eur", "cost"),
        ("fuel_share_of_fare", "Fuel share of fare", share, bad(share, 22, 12), 3, "pct", "fuel"),
        ("total_time", "Total time to complete", c("total_duration_min"), bad(c("total_duration_min"), 35, 22), 3, "min", "time"),
        ("target_gap", "Target gap", c("target_gap_eur_h"), good(c("target_gap_eur_h"), 1, -1), 3, "eur_per_hour", "target"),
        ("demand_pressure", "Demand pressure ratio", pressure, good(pressure, 1.2, 0.9), 3, "ratio", "context"),
        ("traffic_factor", "Traffic factor", traffic, bad(traffic, 1.2, 1.05), 3, "factor", "context"),
        ("event_pressure", "Local event pressure", c("event_pressure"), up(c("event_pressure"), 0.18, 0.05), 4, "factor", "context"),
        ("temporal_pressure", "Temporal demand pressure", c("temporal_pressure"), up(c("temporal_pressure"), 0.14, 0.06), 4, "factor", "context"),
        ("weather_intensity", "Weather intensity", c("weather_intensity"), up(c("weather_intensity"), 0.22, 0.08), 4, "normalized", "context"),
        ("context_fallback", "Context fallback mode", c("context_fallback_applied"), warn(c("context_fallback_applied"), 0.5), 3, "flag", "context"),
        ("context_stale_sources", "Stale context sources", c("context_stale_sources"), warn(c("context_stale_sources"), 2), 3, "count", "context"),
        ("score_component_net_hourly", "Score component net hourly", parts["net_hourly"], good(parts["net_hourly"], 0.62, 0.42), 3, "normalized", "cost"),
        ("score_component_fuel", "Score component fuel efficiency", parts["fuel_efficiency"], good(parts["fuel_efficiency"], 0.62, 0.42), 3, "normalized", "fuel"),
        ("accept_score", "Acceptance score", score, good(score, 0.65, 0.45), 4, "probability", "context"),
    ]
    if threshold is not None:
        rows.append(("decision_threshold", "Hybrid accept threshold", threshold, F.lit("neutral"), 4, "probability", "target"))
    structs = [
        F.struct(F.lit(code).alias("code"), F.lit(label).alias("label"), impact.alias("impact"),
                 round_half_up(value, digits).alias("value"), F.lit(unit).alias("unit"), F.lit(source).alias("source"))
        for code, label, value, impact, digits, unit, source in rows
    ]
    details = F.array(*structs)
    if route_minutes is not None:
        name = F.lit("Route duration estimate")
        if route_source is not None:
            name = F.when(F.coalesce(route_source, F.lit("")) != "", F.concat(F.lit("Route duration ("), route_source, F.lit(")"))).otherwise(name)
        route = F.struct(F.lit("route_duration").alias("code"), name.alias("label"), bad(route_minutes, 30, 18).alias("impact"),
                         round_half_up(route_minutes, 3).alias("value"), F.lit("min").alias("unit"), F.lit("routing").alias("source"))
        details = F.concat(details, F.when(route_minutes.isNotNull(), F.array(route)).otherwise(F.array().cast(
            "array<struct<code:string,label:string,impact:string,value:double,unit:string,source:string>>")))
    return details
