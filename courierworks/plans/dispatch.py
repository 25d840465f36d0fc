"""Where a driver should go next: zone ranking, shift plan, instant dispatch and the driver's brief.

Distances matter only up to a reference distance in these scores. A driver therefore meets the zones
within it, found with a grid join, and the best few of all other zones, which are the same for every
driver; together they contain every zone that can rank among the first `k`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courierworks.functions import zones as fz
from courierworks.functions.cost import FUEL_PRICE_USD_GALLON, fuel_cost_usd
from courierworks.functions.geo import haversine_km
from courierworks.functions.num import at_least, clamp, round_half_up
from courierworks.functions.scoring import words
from courierworks.operators.keyed import join_checked, top_per_key
from courierworks.operators.spatial import nearest_zone, radius_join
from courierworks.session import stage

REFERENCE_KM = 15.0
REACH_KM = 72.0  # the longest move anyone makes: 1.8 times 60 minutes at the highest speed, 40 km/h
ZONE_COLUMNS = ["zone_id", "zone_lat", "zone_lon", "demand_index", "supply_index", "weather_factor", "traffic_factor",
                "demand_trend_ema", "opportunity_score", "event_pressure", "temporal_pressure", "context_fallback_applied",
                "context_stale_sources"]


def _zones(zone_state: DataFrame) -> DataFrame:
    """Zone rows (from `zone_opportunity`) with the columns the plans read."""
    defaults = {"demand_trend_ema": 0.0, "event_pressure": 0.0, "temporal_pressure": 0.0, "context_fallback_applied": 0,
                "context_stale_sources": 0}
    missing = {c: F.lit(d) for c, d in defaults.items() if c not in zone_state.columns}
    return zone_state.withColumns(missing).withColumnsRenamed({"lat": "zone_lat", "lon": "zone_lon"}).select(*ZONE_COLUMNS)


def _with_few(drivers: DataFrame, few: DataFrame) -> DataFrame:
    """Every driver with every row of `few`, which is small unless very many zones tie; broadcast only if it was counted to be small."""
    return join_checked(drivers.withColumn("__one", F.lit(1)), few.withColumn("__one", F.lit(1)), ["__one"], max_rows=2_000).drop("__one")


def _first(zones: DataFrame, score: Column, k: int) -> DataFrame:
    """The `k` best zones by score, ties to the smaller id."""
    return zones.withColumn("__score", score).orderBy(F.desc("__score"), "zone_id").limit(k).drop("__score")


def _first_with_ties(zones: DataFrame, score: Column, k: int) -> DataFrame:
    """The zones whose score is among the `k` best, ties included."""
    scored = zones.withColumn("__score", score)
    return _from_bound(scored, F.col("__score"), _kth(scored, F.col("__score"), k)).drop("__score")


def _kth(zones: DataFrame, score: Column, k: int) -> DataFrame:
    """One row: the `k`-th largest score, or the smallest if there are fewer."""
    return zones.select(score.alias("__s")).orderBy(F.desc("__s")).limit(k).agg(F.min("__s").alias("__bound"))


def _from_bound(zones: DataFrame, score: Column, bound: DataFrame, slack: float = 0.0) -> DataFrame:
    return zones.join(F.broadcast(bound), score >= F.col("__bound") - slack).drop("__bound")  # the bound is one row


def driver_zone_pairs(drivers: DataFrame, zones: DataFrame, radius_km: float, far: DataFrame | None = None) -> DataFrame:
    """Drivers with the zones within the radius and with the zones `far`, wherever they lie.

    Columns: those of the drivers (with lat, lon), of the zones, and distance_km.
    """
    located = zones.where("zone_lat IS NOT NULL AND zone_lon IS NOT NULL")
    centres = located.withColumnsRenamed({"zone_lat": "lat", "zone_lon": "lon"})
    near = radius_join(centres, drivers, radius_km).withColumnsRenamed({"centre_lat": "zone_lat", "centre_lon": "zone_lon"})
    if far is None:
        return near
    beyond = _with_few(drivers, far).withColumn(
        "distance_km", haversine_km("lat", "lon", "zone_lat", "zone_lon")).where(F.col("distance_km") > radius_km)
    return near.unionByName(beyond)


def next_best_zone(drivers: DataFrame, zone_state: DataFrame, k: int = 5, distance_weight: float = 0.0,
                   max_distance_km: float | None = None, reference_km: float = REFERENCE_KM, with_home: bool = False,
                   fuel_price: float = FUEL_PRICE_USD_GALLON) -> DataFrame:
    """The `k` best zones of every driver by opportunity, less for distance and more on the way home.

    `drivers` has courier_id, lat, lon, vehicle_mpg and with `with_home` also home_lat, home_lon. Zones
    without coordinates and drivers without a position count with the plain opportunity.
    """
    zones = _zones(zone_state)
    columns = ["courier_id", "lat", "lon", "vehicle_mpg"] + (["home_lat", "home_lon"] if with_home else [])
    people = drivers.select(*columns)
    base = at_least(F.col("opportunity_score"), 0.0)
    placed = people.where("lat IS NOT NULL AND lon IS NOT NULL")
    located = zones.where("zone_lat IS NOT NULL AND zone_lon IS NOT NULL")
    if max_distance_km is not None:
        pairs = driver_zone_pairs(placed, zones, max_distance_km)
    elif with_home and distance_weight > 0:
        # A far zone scores between base * (1 - w) and, straight on the way home, base * (1 - 0.4 w): only zones whose upper bound
        # reaches the k-th lower bound can be among the first k.
        bound = _kth(located, base * (1.0 - distance_weight), k)
        pairs = driver_zone_pairs(placed, zones, reference_km, _from_bound(located, base * (1.0 - 0.4 * distance_weight), bound, 0.002))
    else:
        pairs = driver_zone_pairs(placed, zones, reference_km, _first(located, round_half_up(base * (1.0 - distance_weight), 3), k))
    nowhere = _first(zones.where("zone_lat IS NULL OR zone_lon IS NULL"), round_half_up(base, 3), k)
    plain = _with_few(placed, nowhere).unionByName(_with_few(
        people.where("lat IS NULL OR lon IS NULL"), _first(zones, round_half_up(base, 3), k)))
    pairs = pairs.unionByName(plain.withColumn("distance_km", F.lit(None).cast("double")))
    km, known = F.col("distance_km"), F.col("distance_km").isNotNull()
    penalty = F.when(known, F.least(km / max(reference_km, 0.5), F.lit(1.0)) * distance_weight).otherwise(F.lit(0.0))
    homeward = F.lit(None).cast("double")
    if with_home:
        home_km = haversine_km("lat", "lon", "home_lat", "home_lon")
        progress = (home_km - haversine_km("zone_lat", "zone_lon", "home_lat", "home_lon")) / F.nullif(home_km, F.lit(0.0))
        homeward = F.when(known & (home_km > 0.1), F.greatest(F.least(progress, F.lit(1.0)), F.lit(-1.0)))
    pairs = pairs.withColumns({"__penalty": penalty, "__home": homeward})
    gain = F.when(F.col("__home") > 0, F.col("__home") * distance_weight * 0.6).otherwise(F.lit(0.0))
    scored = pairs.select(
        "courier_id", "zone_id", "opportunity_score", round_half_up(km, 3).alias("distance_km"),
        F.when(known, round_half_up(fuel_cost_usd(km, "vehicle_mpg", fuel_price), 3)).alias("reposition_cost_usd"),
        F.when(known, round_half_up(km / fz.BASE_SPEED_KMH * 60.0, 2)).alias("reposition_time_min"),
        round_half_up("__penalty", 4).alias("distance_penalty_pct"), round_half_up("__home", 3).alias("homeward_factor"),
        round_half_up(gain, 4).alias("homeward_gain_pct"),
        round_half_up(at_least(base * (1.0 - F.col("__penalty") + gain), 0.0), 3).alias("adjusted_opportunity_score"))
    return top_per_key(scored, ["courier_id"], [F.desc("adjusted_opportunity_score"), F.asc("zone_id")], k, rank="rank")


def _forecast(horizon: Column) -> dict[str, Column]:
    c = F.col
    return fz.forecast_zone(c("demand_index"), c("supply_index"), c("weather_factor"), c("traffic_factor"), F.lit(0.0),
                            c("demand_trend_ema"), horizon)


def shift_plan(drivers: DataFrame, zone_state: DataFrame, horizon_min: int = 60, k: int = 3, distance_weight: float = 0.3,
               max_distance_km: float | None = None, fuel_price: float = FUEL_PRICE_USD_GALLON) -> DataFrame:
    """The best zones for the next 60 or 90 minutes of every driver (courier_id, lat, lon, target_eur_h, vehicle_mpg)."""
    if horizon_min not in (60, 90):
        raise ValueError("horizon_min must be 60 or 90")
    zones = _zones(zone_state)
    zones = zones.select("*", *[x.alias(n) for n, x in _forecast(F.lit(float(horizon_min))).items()])
    later = 0.56 if horizon_min == 60 else 0.64
    penalty = lambda km: clamp(F.least(km / REFERENCE_KM, F.lit(1.0)) * distance_weight, 0.0, 0.9)
    score = lambda km: round_half_up(at_least(
        at_least(F.col("opportunity_score"), 0.0) * (1.0 - penalty(km)) * (1.0 - later)
        + at_least(F.col("forecast_opportunity_score"), 0.0) * later, 0.0), 9)
    people = drivers.select("courier_id", "lat", "lon", "vehicle_mpg", F.when(F.col("target_eur_h") > 0, F.col("target_eur_h"))
                            .otherwise(F.lit(18.0)).alias("target_eur_h")).where("lat IS NOT NULL")
    k = max(3, int(k))
    if max_distance_km is not None:
        pairs = driver_zone_pairs(people, zones, max_distance_km)
    else:
        far = _first_with_ties(zones.where("zone_lat IS NOT NULL AND zone_lon IS NOT NULL"), round_half_up(score(F.lit(REFERENCE_KM)), 4), k)
        pairs = driver_zone_pairs(people, zones, REFERENCE_KM, far)
    c = F.col
    pairs = pairs.withColumns({"shift_score": score(c("distance_km")), "eta_min": fz.leg_eta_min(c("distance_km"), c("traffic_factor"))})
    cost = fz.reposition_cost(c("distance_km"), c("eta_min"), F.lit(fuel_price), c("vehicle_mpg"), c("target_eur_h"),
                              c("traffic_factor"), c("forecast_volatility"))["reposition_total_cost_eur"]
    gross = at_least(c("target_eur_h") * clamp(0.82 + (c("shift_score") - 1.0) * 0.48, 0.6, 1.85), 0.0)
    pairs = pairs.withColumns({"__cost": cost, "__gross": gross}).withColumn(
        "__net", at_least(c("__gross") - at_least(c("__cost"), 0.0) * (60.0 / horizon_min), 0.0))
    fallback = c("context_fallback_applied") >= 1
    confidence = (0.35 + clamp((c("shift_score") - 0.7) / 1.15) * 0.43 + (1.0 - c("forecast_volatility")) * 0.24
                  - clamp(c("context_stale_sources") / 5.0) * 0.12 - F.when(fallback, 0.08).otherwise(0.0))
    fixed = lambda value, digits: F.format_string(f"%.{digits}f", value)
    pressure, trend = c("forecast_pressure_ratio"), c("demand_trend_ema")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    reasons = F.slice(words([
        F.when(pressure >= 1.25, say("Strong forecast pressure (", fixed(pressure, 2), f") in next {horizon_min} min."))
        .when(pressure >= 1.05, say("Healthy demand/supply outlook (", fixed(pressure, 2), f") over {horizon_min} min.")),
        F.when(c("event_pressure") >= 0.16, say("Nearby events are likely to boost demand now (", fixed(c("event_pressure"), 2), ").")),
        F.when(c("temporal_pressure") >= 0.1, say("Favorable time window signal active (", fixed(c("temporal_pressure"), 2), ").")),
        F.when(trend >= 0.06, say("Demand trend is rising in this zone (", fixed(trend, 2), ").")),
        F.when(c("eta_min") <= 10, say("Quick reposition (", fixed(c("eta_min"), 1), " min) keeps setup friction low."))
        .when(c("eta_min") <= 18, say("Reposition ETA is manageable (", fixed(c("eta_min"), 1), " min).")),
        F.when(fallback, F.lit("Context freshness fallback is active, confidence slightly reduced.")),
    ]), 1, 4)
    items = pairs.select(
        "courier_id", "zone_id", round_half_up("shift_score", 4).alias("shift_score"),
        round_half_up("__net", 2).alias("estimated_net_eur_h"), round_half_up("__gross", 2).alias("estimated_gross_eur_h"),
        round_half_up(c("__net") - c("target_eur_h"), 2).alias("net_gain_vs_target_eur_h"),
        round_half_up(clamp(confidence, 0.08, 0.98), 4).alias("confidence"), round_half_up("distance_km", 3).alias("distance_km"),
        round_half_up("eta_min", 2).alias("eta_min"), round_half_up("__cost", 2).alias("reposition_total_cost_eur"),
        F.when(F.size(reasons) == 0, F.array(say("Balanced context and reachable position for zone ", c("zone_id"), ".")))
        .otherwise(reasons).alias("reasons"))
    order = [F.desc("shift_score"), F.desc("estimated_net_eur_h"), F.desc("confidence"), F.asc("zone_id")]
    return top_per_key(items, ["courier_id"], order, k, rank="rank").withColumn("why_now", F.element_at("reasons", 1))


def reposition_options(drivers: DataFrame, zone_state: DataFrame, zone_k: int = 5, max_eta_min: float = 20.0,
                       horizon_min: float = 30.0, fuel_price: float = FUEL_PRICE_USD_GALLON) -> DataFrame:
    """The `zone_k` best moves of every driver among all zones within reach.

    `drivers` has courier_id, lat, lon, vehicle_mpg, aversion_risque, dispatch_strategy, target_hourly and
    the figures of staying (stay_gap, stay_eur_h).
    """
    zones = _zones(zone_state)
    c = F.col
    setting = lambda name: fz.strategy_value("dispatch_strategy", name)
    rows = driver_zone_pairs(drivers.where("lat IS NOT NULL AND lon IS NOT NULL"), zones, REACH_KM).withColumnRenamed("distance_km", "route_distance_km").withColumns({
        "__max_eta": clamp(max_eta_min * setting("eta_limit_multiplier"), 3.0, 60.0),
        "__horizon": clamp(horizon_min * setting("forecast_horizon_multiplier"), 10.0, 90.0)})
    rows = rows.withColumn("eta_min", fz.leg_eta_min(c("route_distance_km"), c("traffic_factor"))).where(
        c("eta_min") <= c("__max_eta") * 1.8)
    rows = rows.select("*", *[x.alias(n) for n, x in _forecast(c("__horizon")).items()])
    costs = fz.reposition_cost(c("route_distance_km"), c("eta_min"), F.lit(fuel_price), c("vehicle_mpg"), c("target_hourly"),
                               c("traffic_factor"), c("forecast_volatility"))
    now = at_least(c("opportunity_score"), 0.0)
    rows = rows.select("*", *[costs[n].alias(n) for n in ("reposition_total_cost_eur", "reposition_cost_penalty")], at_least(
        now * setting("opportunity_current_weight") + c("forecast_opportunity_score") * setting("opportunity_forecast_weight"), 0.0)
        .alias("__opp"))
    rows = rows.withColumn("__potential", c("target_hourly") * clamp(0.85 + (c("__opp") - 1.0) * 0.45, 0.65, 1.65)).withColumn(
        "__adjusted", at_least(c("__potential") - c("reposition_total_cost_eur") * 0.85, 0.0)).withColumn(
        "__gain", c("__adjusted") - c("stay_eur_h"))
    risk, reward = 0.8 + c("aversion_risque") * 0.8, 1.05 - c("aversion_risque") * 0.35
    score = (
        setting("weight_opportunity") * reward * clamp((c("__opp") - 0.8) / 1.4)
        + setting("weight_eta") * risk * clamp(1.0 - c("eta_min") / c("__max_eta"))
        + setting("weight_pressure") * reward * clamp((c("forecast_pressure_ratio") - 0.85) / 1.2)
        + setting("weight_target_need") * reward * clamp((4.0 - c("stay_gap")) / 12.0)
        + setting("weight_net_gain") * reward * clamp((c("__gain") + 5.0) / 14.0)
        - setting("penalty_cost") * risk * c("reposition_cost_penalty")
        - setting("penalty_volatility") * risk * c("forecast_volatility"))
    options = rows.select(
        "courier_id", "zone_id", round_half_up(clamp(score), 4).alias("dispatch_score"),
        round_half_up("__opp", 3).alias("opportunity_score"), round_half_up("__potential", 2).alias("estimated_potential_eur_h"),
        round_half_up("__adjusted", 2).alias("risk_adjusted_potential_eur_h"), round_half_up("__gain", 2).alias("net_gain_vs_stay_eur_h"),
        round_half_up("route_distance_km", 3).alias("route_distance_km"), round_half_up("eta_min", 2).alias("eta_min"),
        round_half_up("reposition_total_cost_eur", 2).alias("reposition_total_cost_eur"), c("__max_eta").alias("max_eta_min"))
    order = [F.desc("dispatch_score"), F.desc("risk_adjusted_potential_eur_h"), F.asc("eta_min"), F.asc("zone_id")]
    return top_per_key(options, ["courier_id"], order, zone_k, rank="rank")


def with_stay(drivers: DataFrame, best_offers: DataFrame) -> DataFrame:
    """Drivers with the figures of their best local offer (rank 1), or the defaults without one."""
    best = best_offers.where("rank = 1").select(
        "courier_id", F.col("offer_id").alias("stay_offer_id"), F.col("recommendation_score").alias("stay_score"),
        F.col("target_gap_eur_h").alias("stay_gap"), F.col("eur_per_hour_net").alias("stay_eur_h"),
        F.col("target_hourly_net_eur").alias("target_hourly"))
    default = {"stay_score": 0.0, "stay_gap": -6.0, "stay_eur_h": 0.0, "target_hourly": 18.0}
    return drivers.join(best, "courier_id", "left").withColumns({n: F.coalesce(n, F.lit(d)) for n, d in default.items()})


def instant_dispatch(drivers: DataFrame, options: DataFrame) -> DataFrame:
    """Stay, reposition or wait for every driver of `with_stay`, given its reposition options."""
    best = options.where("rank = 1").select(
        "courier_id", F.col("zone_id").alias("move_zone_id"), F.col("dispatch_score").alias("move_score"),
        F.col("eta_min").alias("move_eta"), F.col("risk_adjusted_potential_eur_h").alias("move_potential"),
        F.col("net_gain_vs_stay_eur_h").alias("move_gain"))
    default = {"move_score": 0.0, "move_eta": 999.0, "move_potential": 0.0, "move_gain": 0.0}
    rows = drivers.join(best, "courier_id", "left").withColumns({n: F.coalesce(n, F.lit(d)) for n, d in default.items()})
    c, risk = F.col, F.col("aversion_risque")
    setting = lambda name: fz.strategy_value("dispatch_strategy", name)
    verdict = fz.dispatch_decision(
        c("stay_score"), c("stay_gap"), c("stay_eur_h"), c("move_score"), c("move_eta"), c("move_potential"),
        clamp(c("max_reposition_eta_min") * setting("eta_limit_multiplier"), 3.0, 60.0), c("move_gain"),
        setting("negative_net_gain_guard") + risk * 0.6, setting("delta_threshold") + risk * 0.05,
        setting("min_net_gain_for_reposition") + risk * 0.7)
    return rows.withColumn("__v", verdict).select(
        "courier_id", "dispatch_strategy", F.col("__v.decision").alias("decision"),
        round_half_up("__v.confidence", 4).alias("confidence"), F.col("__v.reasons").alias("reasons"), "stay_offer_id", "move_zone_id")


def market_zones(zone_state: DataFrame, n: int = 5, stations: DataFrame | None = None) -> DataFrame:
    """The hottest and calmest zones by demand over supply: fresh zones if there are any, else all.

    Without any zone the station signals (zone_id, demand_boost, occupancy_ratio) stand in.
    """
    zones = zone_state.where("lat IS NOT NULL AND lon IS NOT NULL")
    fresh = (F.coalesce("context_fallback_applied", F.lit(0)) == 0) & (F.coalesce("context_stale_sources", F.lit(0)) <= 2)
    rows = zones.select("zone_id", (at_least("demand_index", 0.0) / at_least("supply_index", 0.2)).alias("__score"), fresh.alias("__fresh"))
    any_fresh = F.max("__fresh").over(Window.partitionBy())
    # One row per zone, so the windows over all rows below are small.
    pool = rows.withColumn("__any", any_fresh).where(F.col("__fresh") | ~F.col("__any"))

    def side(kind: str, source: DataFrame, order: Column) -> DataFrame:
        ranked = source.orderBy(order, "zone_id").limit(n)
        return ranked.select(
            F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(order, "zone_id")).cast("long").alias("rank"), "zone_id",
            round_half_up("__score", 4).alias("market_score"),
            F.when(F.col("__score") >= 1.2, "Hot right now").otherwise("Calm / low demand").alias("label"),
            (~F.col("__fresh")).alias("stale"))

    if stations is not None and zones.isEmpty():
        boost, full = at_least("demand_boost", 0.0), clamp(F.col("occupancy_ratio"))
        hot = stations.select("zone_id", ((1.0 + boost * 2.6) / at_least(1.35 - boost, 0.2)).alias("__score"), F.lit(True).alias("__fresh"))
        calm = stations.select("zone_id", (at_least(1.15 - boost * 1.8, 0.35) / at_least(1.0 + full, 0.2)).alias("__score"), F.lit(True).alias("__fresh"))
        return side("hot", hot, F.desc("__score")).unionByName(side("calm", calm, F.asc("__score")))
    return side("hot", pool, F.desc("__score")).unionByName(side("calm", pool, F.asc("__score")))


def market_reposition(next_zones: DataFrame, target: Column) -> DataFrame:
    """A move derived from the market for drivers' best zones with a score of at least 1.02."""
    score = F.col("opportunity_score")
    uplift = F.greatest((score - 1.0) * 7.0, F.when(score >= 1.08, 0.5).otherwise(0.0))
    eta = F.coalesce("reposition_time_min", F.lit(0.0))
    dispatch = clamp(0.46 + at_least(score - 1.0, 0.0) * 0.28 + F.when((eta > 0) & (eta <= 12), 0.05).otherwise(0.0), 0.42, 0.94)
    return next_zones.where(score >= 1.02).select(
        "courier_id", "zone_id", "rank", round_half_up(dispatch, 4).alias("dispatch_score"),
        round_half_up(target + at_least(uplift, 0.0), 2).alias("potential_eur_h"),
        F.when(dispatch >= 0.68, "Take").otherwise("Maybe").alias("badge"))


def market_shift_items(next_zones: DataFrame, target: Column, n: int = 3) -> DataFrame:
    """Shift items from the market for drivers without a shift plan."""
    score = F.col("opportunity_score")
    return next_zones.where(F.col("rank") <= n).select(
        "courier_id", "zone_id", "rank", round_half_up(at_least(score, 0.0), 3).alias("shift_score"),
        round_half_up(target + at_least(score - 1.0, 0.0) * 6.5, 2).alias("estimated_net_eur_h"),
        round_half_up(clamp(0.44 + at_least(score - 1.0, 0.0) * 0.24, 0.35, 0.86), 4).alias("confidence"))


def _items(df: DataFrame, kind: str, id_column: str, n: int, name: str) -> DataFrame:
    """Up to `n` ranked rows per driver as an array of {kind, id}; the rank bounds every array."""
    item = F.struct("rank", F.lit(kind).alias("kind"), F.col(id_column).alias("id"))
    arrays = df.where(F.col("rank") <= n).groupBy("courier_id").agg(F.sort_array(F.collect_list(item)).alias("__items"))
    return arrays.select("courier_id", F.transform("__items", lambda x: F.struct(x["kind"].alias("kind"), x["id"].alias("id"))).alias(name))


def driver_brief(drivers: DataFrame, around: DataFrame, listed: DataFrame, options: DataFrame, market_moves: DataFrame,
                 shift: DataFrame, market_shift: DataFrame) -> DataFrame:
    """One row per driver: the main recommendation, up to three alternatives and the shift items.

    The order of preference is a nearby offer, any offer, a reposition option, a market move, hold.
    """
    rows = drivers.select("courier_id")
    for df, kind, key, n, name in [
        (around, "offer", "offer_id", 3, "near"), (listed, "offer", "offer_id", 3, "plain"), (options, "reposition", "zone_id", 3, "moves"),
        (market_moves, "market_reposition", "zone_id", 3, "market"), (shift, "shift", "zone_id", 3, "shifts"),
        (market_shift, "market_shift", "zone_id", 3, "market_shifts"),
    ]:
        rows = rows.join(_items(df, kind, key, n, name), "courier_id", "left")
    some = lambda name: F.size(F.coalesce(name, F.array())) > 0
    hold = F.array(F.struct(F.lit("hold").alias("kind"), F.lit(None).cast("string").alias("id")))
    ranked = F.when(some("near"), F.col("near")).when(some("plain"), F.col("plain")).when(some("moves"), F.col("moves")).when(
        some("market"), F.col("market")).otherwise(hold)
    move = F.coalesce(F.try_element_at("moves", F.lit(1)), F.try_element_at("market", F.lit(1)))
    rows = rows.withColumns({"__ranked": ranked, "__move": move})
    offers_first = F.element_at("__ranked", 1)["kind"] == "offer"
    rest = F.slice("__ranked", 2, 2)
    others = F.when(offers_first & F.col("__move").isNotNull(), F.concat(rest, F.array("__move"))).otherwise(rest)
    return rows.select(
        "courier_id", F.element_at("__ranked", 1)["kind"].alias("primary_kind"), F.element_at("__ranked", 1)["id"].alias("primary_id"),
        F.slice(others, 1, 3).alias("alternatives"),
        F.when(some("shifts"), F.col("shifts")).otherwise(F.coalesce("market_shifts", F.array())).alias("shift_items"))


def rank_live_drivers(latest: DataFrame, offer_counts: DataFrame, opportunity: DataFrame, n: int | None = None) -> DataFrame:
    """Live drivers by offers at hand, opportunity and status."""
    from courierworks.functions.status import tidy

    status = tidy("status")
    bonus = (F.when(status.isin("available", "idle"), 8.0).when(status.isin("pickup", "pickup_en_route", "pickup_assigned", "pickup_arrived"), 6.0)
             .when(status == "repositioning", 5.0).when(status == "delivering", 4.0).otherwise(0.0))
    rows = latest.join(offer_counts, "courier_id", "left").join(opportunity, "courier_id", "left").select(
        "courier_id", "status", F.coalesce("offer_count", F.lit(0)).alias("offer_count"),
        F.coalesce("driver_opportunity", F.lit(0.0)).alias("opportunity"), bonus.alias("__bonus"))
    count = F.col("offer_count")
    ranked = rows.withColumn("rank_score", F.when(count > 0, 100.0).otherwise(0.0) + count * 12.0 + F.col("opportunity") * 10.0 + F.col("__bonus"))
    ordered = ranked.drop("__bonus").orderBy(F.desc("rank_score"), "courier_id")
    return ordered if n is None else ordered.limit(n)


def driver_opportunity(latest: DataFrame, zone_state: DataFrame, zones: DataFrame) -> DataFrame:
    """Live drivers with the context of their nearest zone, opportunity and best action."""
    placed = nearest_zone(stage(latest.select("courier_id", "lat", "lon", "status", "ts")), zones, "courier_id")
    context = zone_state.select("zone_id", "demand_index", "supply_index", "weather_factor", "traffic_factor")
    rows = placed.join(context, "zone_id", "left").withColumns({
        "demand_index": F.coalesce("demand_index", F.lit(0.0)), "supply_index": F.coalesce("supply_index", F.lit(0.5))})
    pressure = F.col("demand_index") / at_least("supply_index", 0.01)
    rows = rows.withColumn("pressure_ratio", round_half_up(pressure, 4)).withColumn(
        "driver_opportunity", round_half_up(clamp(pressure / 5.0 * 0.6 + F.col("demand_index") * 0.4), 3))
    action = F.when(F.col("driver_opportunity") >= 0.7, "accept_next").when(F.col("driver_opportunity") >= 0.45, "reposition").otherwise("hold")
    return rows.withColumn("best_action", action)


def fleet_overview(opportunity: DataFrame) -> DataFrame:
    """One row: drivers, mean demand and pressure, the five busiest zones, statuses and the best opportunities.

    The drivers with their zones are made once and written; the four figures read the few columns they need.
    """
    opportunity = stage(opportunity.select("courier_id", "zone_id", "status", "ts", "demand_index", "pressure_ratio", "driver_opportunity"))
    one = F.lit(1).alias("__one")
    totals = opportunity.agg(F.count("*").alias("active_drivers"), round_half_up(F.avg("demand_index"), 4).alias("avg_demand_index"),
                             round_half_up(F.avg("pressure_ratio"), 4).alias("avg_pressure_ratio")).select(one, "*")
    busiest = opportunity.groupBy("zone_id").count().orderBy(F.desc("count"), "zone_id").limit(5)
    zones = busiest.agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "zone_id"))).alias("z")).select(
        one, F.transform("z", lambda x: x["zone_id"]).alias("top_zones"))
    statuses = opportunity.groupBy("status").count().agg(F.sort_array(F.collect_list(F.struct("status", "count"))).alias("s")).select(
        one, F.map_from_entries("s").alias("status_distribution"))
    first = opportunity.orderBy(F.desc("driver_opportunity"), F.desc("ts"), F.desc("courier_id")).limit(10).where("driver_opportunity >= 0.6")
    best = first.agg(F.collect_list(F.struct((-F.col("driver_opportunity")).alias("o"), "courier_id")).alias("b")).select(
        one, F.transform(F.sort_array("b"), lambda x: x["courier_id"]).alias("top_opportunities"))
    return totals.join(zones, "__one").join(statuses, "__one").join(best, "__one").drop("__one")
