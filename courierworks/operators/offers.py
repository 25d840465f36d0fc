"""Scoring and ranking of delivery offers for whole tables at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courierworks.functions import scoring
from courierworks.functions.geo import haversine_km
from courierworks.functions.num import round_half_up
from courierworks.operators.keyed import join_checked, order_statistics, top_per_key
from courierworks.operators.profiles import with_profile

REJECT_FLOOR, TOP_PICK_MIN, TOP_PICK_EDGE, TARGET_SLACK = 9.0, 14.0, 1.0, 0.75

# Sort columns of every ranking metric, all descending; the offer id decides full ties.
METRICS = {
    "eur_per_hour_net": ["eur_per_hour_net", "estimated_net_eur", "accept_score"],
    "estimated_net_eur": ["estimated_net_eur", "eur_per_hour_net", "accept_score"],
    "accept_score": ["accept_score", "eur_per_hour_net", "estimated_net_eur"],
    "objective_score": ["objective_score", "accept_score", "eur_per_hour_net", "estimated_net_eur"],
}


def score_offers(offers: DataFrame, profiles: DataFrame | None = None, fuel_price_usd_gallon: float | None = None,
                 model_score: Column | None = None, objective_weights: dict[str, float] | None = None,
                 details: bool = False) -> DataFrame:
    """Offers with features, score, decision, objective, reasons and codes.

    Missing cost inputs come from the driver's profile and the fuel price. `model_score` replaces the
    heuristic score where it is a finite number.
    """
    rows = offers
    risk: Column | float = 0.5
    if profiles is not None:
        rows = with_profile(rows, profiles)
        risk = F.col("aversion_risque")
        target = F.col("target_eur_h")
        if "target_hourly_net_eur" in rows.columns:
            target = F.coalesce("target_hourly_net_eur", target)
        rows = rows.withColumn("target_hourly_net_eur", target)
    if fuel_price_usd_gallon is not None and "fuel_price_usd_gallon" not in rows.columns:
        rows = rows.withColumn("fuel_price_usd_gallon", F.lit(float(fuel_price_usd_gallon)))
    featured = scoring.add_components(scoring.add_features(rows))
    heuristic = scoring.weighted_offer_score()
    score, used = heuristic, F.lit("heuristic")
    if model_score is not None:
        good = model_score.isNotNull() & ~F.isnan(model_score)
        score = F.when(good, F.least(F.greatest(model_score, F.lit(0.01)), F.lit(0.99))).otherwise(heuristic)
        used = F.when(good, "ml").otherwise("heuristic")
    scored = featured.withColumns({"accept_score": score, "model_used": used, "decision_threshold": scoring.accept_threshold(risk)})
    scored = scoring.add_axes(scored)
    s, t = F.col("accept_score"), F.col("decision_threshold")
    scored = scored.withColumns({
        "decision": F.when(s >= t, "accept").otherwise("reject"), "eur_per_hour_net": F.col("estimated_net_eur_h"),
        "objective_score": round_half_up(scoring.objective_score(objective_weights), 4),
        "reasons": scoring.heuristic_reasons(), "signals": scoring.recommendation_signals(), "breakdown": scoring.score_breakdown()})
    scored = scored.withColumns({
        "recommendation_score": F.col("objective_score"),
        "recommendation_action": scoring.recommendation_action(F.col("objective_score")),
        "reason_codes": scoring.reason_codes(F.col("breakdown"), s, t)})
    if details:
        scored = scored.withColumns({"details": scoring.explanation_details(s, t), "costs": scoring.cost_breakdown()})
    return scored


def _order(metric: str, reverse: bool = False) -> list[Column]:
    columns = METRICS.get(metric, METRICS["eur_per_hour_net"])
    if reverse:
        return [F.asc(c) for c in columns] + [F.desc("offer_id")]
    return [F.desc(c) for c in columns] + [F.asc("offer_id")]


def _ranked_by_window(rows: DataFrame, set_id: str, metric: str) -> DataFrame:
    w = Window.partitionBy(set_id).orderBy(*_order(metric))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hourly = Window.partitionBy(set_id).orderBy("eur_per_hour_net", "offer_id")
    every = hourly.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    eur = F.col("eur_per_hour_net")
    rows = rows.withColumns({
        "rank": F.row_number().over(w).cast("long"), "set_size": F.count("*").over(whole),
        "best_eur_h": F.first(eur).over(whole), "worst_eur_h": F.last(eur).over(whole),
        "second_eur_h": F.coalesce(F.nth_value(eur, 2).over(whole), F.first(eur).over(whole)),
        "__place": F.row_number().over(hourly)})
    middle = F.when(F.col("__place") == F.floor(F.col("set_size") / 2) + 1, eur)
    return rows.withColumn("median_eur_h", F.max(middle).over(every)).drop("__place")


def _ranked_spread(rows: DataFrame, set_id: str, metric: str, bins: int = 512) -> DataFrame:
    """The same for very large sets: rank = rows in better bins of the metric + place inside the bin. Missing values are a last bin."""
    lead = METRICS.get(metric, METRICS["eur_per_hour_net"])[0]
    slim = rows.select(set_id, "offer_id", *[c for c in METRICS["objective_score"] if c in rows.columns])
    two = top_per_key(slim, [set_id], _order(metric), 2, rank="__r")
    tops = two.groupBy(set_id).agg(
        F.max(F.when(F.col("__r") == 1, F.col("eur_per_hour_net"))).alias("best_eur_h"),
        F.max(F.when(F.col("__r") == 2, F.col("eur_per_hour_net"))).alias("__second"))
    worst = top_per_key(slim, [set_id], _order(metric, reverse=True), 1).select(
        set_id, F.col("eur_per_hour_net").alias("worst_eur_h"))
    middle = order_statistics(rows, [set_id], "eur_per_hour_net", {"median_eur_h": lambda n: F.floor(n / 2)}, nulls_first=True)
    edges = rows.groupBy(set_id).agg(F.min(lead).alias("__lo"), F.max(lead).alias("__hi"))
    stats = tops.join(worst, set_id).join(middle.withColumnRenamed("n", "set_size"), set_id).join(edges, set_id)
    stats = stats.withColumn("second_eur_h", F.coalesce("__second", "best_eur_h")).drop("__second")
    width = F.col("__hi") - F.col("__lo")
    place = (F.when(F.col(lead).isNull(), F.lit(bins + 1)).when(width > 0, F.floor((F.col("__hi") - F.col(lead)) / width * F.lit(float(bins))))
             .otherwise(F.lit(0)))
    binned = join_checked(rows, stats, [set_id]).withColumn("__bin", place.cast("int"))
    counts = binned.groupBy(set_id, "__bin").count()
    offsets = counts.withColumn(
        "__before", F.sum("count").over(Window.partitionBy(set_id).orderBy("__bin")) - F.col("count")).drop("count")
    inside = Window.partitionBy(set_id, "__bin").orderBy(*_order(metric))
    return join_checked(binned, offsets, [set_id, "__bin"]).withColumn(
        "rank", F.col("__before") + F.row_number().over(inside)).drop("__bin", "__before", "__lo", "__hi")


def rank_offers(scored: DataFrame, set_id: str = "set_id", by: str = "eur_per_hour_net",
                floor: float = REJECT_FLOOR, hot_rows: int = 1_000_000) -> DataFrame:
    """Scored offers with rank, recommendation and distances to the best and median of their set.

    Sets over `hot_rows` offers are ranked in parallel bins instead of one window; both ways give the same rows, also for missing
    scores (last in rank, first in the order of the median) and for offers without a set, which form one set.
    """
    keyed = scored.withColumn("__set", F.coalesce(F.concat(F.lit("="), F.col(set_id).cast("string")), F.lit("")))
    hot = keyed.groupBy("__set").count().where(F.col("count") > hot_rows).select("__set")
    if hot.isEmpty():
        ranked = _ranked_by_window(keyed, "__set", by)
    else:
        small = _ranked_by_window(join_checked(keyed, hot, ["__set"], "left_anti"), "__set", by)
        ranked = small.unionByName(_ranked_spread(join_checked(keyed, hot, ["__set"], "left_semi"), "__set", by))
    ranked = ranked.drop("__set")
    eur, target = F.col("eur_per_hour_net"), F.coalesce("target_hourly_net_eur", F.lit(0.0))
    top = (F.col("rank") == 1) & (eur >= TOP_PICK_MIN) & (
        (F.col("set_size") <= 1) | (eur - F.col("second_eur_h") >= TOP_PICK_EDGE))
    label = (F.when(eur < floor, "reject").when(top, "top_pick")
             .when((target > 0) & (eur < target - TARGET_SLACK), "below_target").otherwise("viable"))
    return ranked.withColumns({
        "recommendation": label,
        "delta_vs_top_eur_h": round_half_up(eur - F.col("best_eur_h"), 2),
        "delta_vs_median_eur_h": round_half_up(eur - F.col("median_eur_h"), 2)})


def offer_set_summary(ranked: DataFrame, set_id: str = "set_id") -> DataFrame:
    """One row per set: size, top pick, best, worst, median and the gain of the best over the worst."""
    constant = lambda name: F.first(name).alias(name)
    sums = ranked.groupBy(set_id).agg(
        F.count("*").alias("offers"),
        F.max(F.when(F.col("recommendation") == "top_pick", F.col("offer_id"))).alias("top_pick_offer_id"),
        constant("best_eur_h"), constant("worst_eur_h"), constant("median_eur_h"))
    return sums.select(
        set_id, "offers", "top_pick_offer_id", round_half_up("best_eur_h", 2).alias("best_eur_h"),
        round_half_up("worst_eur_h", 2).alias("worst_eur_h"), round_half_up("median_eur_h", 2).alias("median_eur_h"),
        round_half_up(F.col("best_eur_h") - F.col("worst_eur_h"), 2).alias("gain_vs_worst_eur_h"))


LIST_ORDERS = {
    "score": ["accept_score", "eur_per_hour_net"], "net": ["eur_per_hour_net", "accept_score"],
    "objective": ["objective_score", "accept_score", "eur_per_hour_net"], "recent": ["ts"],
}


def driver_offer_list(scored: DataFrame, sort_by: str = "score", n: int = 20, min_score: float = 0.0) -> DataFrame:
    """The first `n` offers of every driver in the chosen order, with the driver's counts over all offers."""
    # Sorting the low scores last keeps the limit exact and leaves no filter for Catalyst to push through,
    # and so to repeat in, the long score expressions.
    rows = scored.withColumn("__good", F.col("accept_score") >= min_score)
    order = [F.desc("__good")] + [F.desc(c) for c in LIST_ORDERS[sort_by]] + [F.asc("offer_id")]
    listed = top_per_key(rows, ["courier_id"], order, n, rank="rank").where("__good").drop("__good")
    counts = rows.groupBy("courier_id").agg(
        F.count_if("__good").alias("offers"),
        F.count_if(F.col("__good") & (F.col("decision") == "accept")).alias("accepted"))
    return listed.join(counts, "courier_id").withColumn(
        "accept_rate_pct", round_half_up(F.col("accepted") * 100.0 / F.col("offers"), 1))


def best_offers_around(offers: DataFrame, drivers: DataFrame, profiles: DataFrame, radius_km: float = 4.0, k: int = 5,
                       scan_limit: int | None = None, min_score: float = 0.0, rank_by: str = "recommendation",
                       fuel_price_usd_gallon: float | None = None) -> DataFrame:
    """The best `k` of a driver's offers whose pickup lies within the radius; with `scan_limit` only of the newest so many.

    `drivers` has courier_id, lat, lon.
    """
    recent = offers if scan_limit is None else top_per_key(offers, ["courier_id"], [F.desc("ts"), F.asc("offer_id")], scan_limit)
    at = drivers.select("courier_id", F.col("lat").alias("driver_lat"), F.col("lon").alias("driver_lon"))
    km = haversine_km("driver_lat", "driver_lon", "pickup_lat", "pickup_lon")
    near = recent.join(at, "courier_id").withColumn("__km", km).where(F.col("__km") <= radius_km)
    near = near.withColumn("distance_to_pickup_km", round_half_up("__km", 3)).drop("__km")
    scored = score_offers(near, profiles, fuel_price_usd_gallon).withColumn("__good", F.col("accept_score") >= min_score)
    first = "objective_score" if rank_by == "objective" else "recommendation_score"
    order = [F.desc("__good"), F.desc(first), F.desc("accept_score"), F.desc("eur_per_hour_net"), F.asc("offer_id")]
    return top_per_key(scored, ["courier_id"], order, k, rank="rank").where("__good").drop("__good")


def action_counts(best: DataFrame) -> DataFrame:
    count = lambda word: F.count_if(F.col("recommendation_action") == word).alias(word)
    return best.groupBy("courier_id").agg(count("accept"), count("consider"), count("skip"))


def offer_quality(scored: DataFrame) -> DataFrame:
    """One row: decision counts, rates, means and the best offer of a scored table."""
    n = F.count("*").cast("double")
    pct = lambda word: round_half_up(F.count_if(F.col("decision") == word) * 100.0 / n, 2)
    best = F.struct("accept_score", "eur_per_hour_net", "offer_id")
    return scored.agg(
        F.count("*").alias("offers"), F.count_if(F.col("decision") == "accept").alias("accepted"),
        F.count_if(F.col("decision") == "reject").alias("rejected"),
        F.count_if(~F.col("decision").isin("accept", "reject")).alias("unknown"),
        pct("accept").alias("accept_rate_pct"), pct("reject").alias("reject_rate_pct"),
        round_half_up(F.avg("accept_score"), 4).alias("avg_accept_score"),
        round_half_up(F.avg("eur_per_hour_net"), 4).alias("avg_eur_per_hour_net"),
        F.max_by("offer_id", best).alias("top_offer_id"))


# The sentences for reason codes.
REASON_TEXTS = {
    "GAIN_STRONG": "Strong earnings upside right now.",
    "TIME_EFFICIENT": "Time efficiency is favorable on this route.",
    "FUEL_EFFICIENT": "Fuel spend stays under control.",
    "FUEL_HEAVY": "Fuel spend is meaningful on this run.",
    "RISK_LOW": "Operational risk looks low.",
    "RISK_HIGH": "Operational risk is elevated.",
    "DECISION_CONFIDENT": "The copilot is confident in this recommendation.",
    "PROFILE_BALANCED": "This option matches your current driving profile.",
}


def traffic_level(traffic: Column) -> Column:
    t = F.greatest(F.coalesce(traffic, F.lit(1.0)), F.lit(0.2))
    return F.when(t >= 1.22, "Heavy").when(t >= 1.08, "Moderate").otherwise("Light")


def decision_badge(action: Column, score: Column) -> Column:
    word = F.lower(F.trim(F.coalesce(action, F.lit(""))))
    return (F.when(word.isin("accept", "top_pick", "take"), "Take").when(word.isin("consider", "viable", "maybe"), "Maybe")
            .when(score >= 0.7, "Take").when(score >= 0.45, "Maybe").otherwise("Skip"))


def _short(value: Column, digits: int) -> Column:
    """A number as text, rounded, with at least one decimal."""
    text = F.regexp_replace(F.format_string(f"%.{digits}f", round_half_up(value, digits)), r"(\.\d+?)0+$", "$1")
    return text


def coach_reasons(route_minutes: Column | None = None) -> Column:
    """The first three distinct sentences in favour of a scored offer with `details`."""
    c = F.col
    say = lambda condition, *parts: F.when(condition, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    minutes = route_minutes if route_minutes is not None else F.lit(0.0)
    numbers = F.array(
        say(c("accept_score") >= 0.75, "High copilot confidence (", F.format_string("%.0f", round_half_up(c("accept_score") * 100.0, 0)), "%)."),
        say(c("target_gap_eur_h") >= 0.5, "Above your target by $", _short(c("target_gap_eur_h"), 1), "/h."),
        say(c("fuel_cost_usd").between(0.0, 1.8), "Estimated fuel cost stays low at $", _short(c("fuel_cost_usd"), 2), "."),
        say((minutes > 0) & (minutes <= 18), "Fast full route (", _short(minutes, 1), " min total)."),
        say((c("distance_to_pickup_km") > 0) & (c("distance_to_pickup_km") <= 1.5), "Restaurant is close (", _short(c("distance_to_pickup_km"), 1), " km away)."),
        say(F.greatest(c("traffic_factor"), F.lit(0.2)) <= 1.08, "Traffic is still manageable on this route."),
    )
    texts = F.create_map(*[F.lit(x) for pair in REASON_TEXTS.items() for x in pair])
    codes = F.transform(c("reason_codes"), lambda code: F.try_element_at(texts, code))
    sentence = lambda text: F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))
    labels = F.transform(F.filter(c("details"), lambda d: d["impact"] == "positive"),
                         lambda d: F.concat(sentence(d["label"]), F.lit(" supports taking it.")))
    free = F.transform(c("reasons"), lambda w: F.concat(
        F.upper(F.substring(F.replace(w, F.lit("_"), F.lit(" ")), 1, 1)),
        F.substr(F.replace(w, F.lit("_"), F.lit(" ")), F.lit(2)), F.lit(".")))
    found = F.array_distinct(F.array_compact(F.concat(numbers, codes, labels, free)))
    fallback = F.array(F.lit("Balanced earnings, ETA, and fuel profile."))
    return F.slice(F.when(F.size(found) == 0, fallback).otherwise(found), 1, 3)


def coach_warning(route: Column | None = None) -> Column:
    c = F.col
    chain = (F.when(F.greatest(c("traffic_factor"), F.lit(0.2)) >= 1.22, "Heavy traffic may stretch the ETA.")
             .when(c("fuel_cost_usd") >= 2.8, "Fuel burn is noticeable on this run.")
             .when(c("target_gap_eur_h") < -1, "This delivery sits below your current hourly target."))
    source = F.coalesce(route, F.lit("estimated")) if route is not None else F.lit("estimated")
    return chain.when(~source.isin("osrm", "hold"), "Routing is estimated rather than OSRM-verified.")
