"""Mission outcomes and the statistics of a driver's journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierworks.functions.num import clamp, round_half_up
from courierworks.functions.zones import strategy_name
from courierworks.operators.keyed import top_per_key


def mission_outcomes(reports: DataFrame) -> DataFrame:
    """Reports with predicted and realised gain, success and how well the two agree."""
    gain = lambda name: round_half_up(F.col(name) - F.col("baseline_eur_h"), 3)
    rows = reports.withColumns({
        "dispatch_strategy": strategy_name(F.coalesce("dispatch_strategy", F.lit("balanced"))),
        "predicted_delta_eur_h": gain("predicted_potential_eur_h"), "realized_delta_eur_h": gain("realized_best_offer_eur_h")})
    given = F.col("success") if "success" in reports.columns else F.lit(None).cast("boolean")
    success = F.coalesce(given, F.when(F.col("realized_delta_eur_h").isNotNull(), F.col("realized_delta_eur_h") >= 0)
                         .otherwise(F.col("final_distance_km") <= 0.25))
    apart = F.abs(F.col("realized_delta_eur_h") - F.col("predicted_delta_eur_h"))
    return rows.withColumns({
        "success": success, "alignment_score": F.when(apart.isNotNull(), round_half_up(clamp(1.0 - apart / 8.0), 4))})


def journal(outcomes: DataFrame, limit: int | None = None) -> DataFrame:
    """The entries of every driver, or only the newest `limit` of each."""
    if limit is None:
        return outcomes
    return top_per_key(outcomes, ["courier_id"], [F.desc("completed_at"), F.asc("mission_id")], limit)


def _stats() -> dict[str, Column]:
    pct = lambda top, bottom: round_half_up(top * 100.0 / F.nullif(bottom, F.lit(0)), 2)
    realised = F.col("realized_delta_eur_h")
    return {
        "missions": F.count("*"), "successes": F.count_if("success"),
        "success_rate_pct": pct(F.count_if("success"), F.count("*")),
        "avg_elapsed_min": round_half_up(F.avg("elapsed_min"), 3),
        "avg_predicted_delta_eur_h": round_half_up(F.avg("predicted_delta_eur_h"), 3),
        "avg_realized_delta_eur_h": round_half_up(F.avg(realised), 3),
        "realized_win_rate_pct": pct(F.count_if(realised >= 0), F.count(realised)),
        "avg_alignment_score": round_half_up(F.avg("alignment_score"), 4),
    }


def mission_stats(entries: DataFrame) -> DataFrame:
    """Per driver: counts, rates, means, missions per strategy and the newest completion."""
    strategies = ["conservative", "balanced", "aggressive"]
    return entries.groupBy("courier_id").agg(
        *[x.alias(n) for n, x in _stats().items()],
        *[F.count_if(F.col("dispatch_strategy") == s).alias(f"{s}_missions") for s in strategies],
        F.max("completed_at").alias("latest_completed_at"))


def session_report(entries: DataFrame, n_zones: int = 5) -> DataFrame:
    """Per driver the key figures and the zones with most missions."""
    figures = entries.groupBy("courier_id").agg(*[x.alias(n) for n, x in _stats().items()])
    counts = entries.groupBy("courier_id", F.coalesce("zone_id", F.lit("unknown")).alias("zone_id")).agg(F.count("*").alias("n"))
    top = top_per_key(counts, ["courier_id"], [F.desc("n"), F.asc("zone_id")], n_zones)
    zones = top.groupBy("courier_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "zone_id"))).alias("__z"))
    return figures.join(zones, "courier_id").withColumn("top_zones", F.transform("__z", lambda x: x["zone_id"])).drop("__z")
