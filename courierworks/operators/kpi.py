"""Key figures of the mart. Every function takes mart tables and returns a small DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierworks.functions.num import ratio, round_half_up
from courierworks.operators.keyed import latest_by


def _pct(top: Column, bottom: Column, digits: int = 2) -> Column:
    return round_half_up(ratio(top * 100.0, bottom.cast("double")), digits)


def signal_volume(signals: DataFrame) -> DataFrame:
    return signals.agg(F.count("*").alias("total_signals"))


def surge_rate(signals: DataFrame) -> DataFrame:
    return signals.agg(_pct(F.count_if("surge_candidate"), F.count("*")).alias("surge_rate_pct"))


def mean_pressure(signals: DataFrame) -> DataFrame:
    return signals.agg(round_half_up(F.avg("pressure_ratio"), 4).alias("avg_pressure_ratio"))


def top_zones(signals: DataFrame, n: int = 5) -> DataFrame:
    return signals.groupBy("zone_id").agg(F.count("*").alias("signals")).orderBy(F.desc("signals"), "zone_id").limit(n)


def accept_rate(order_events: DataFrame) -> DataFrame:
    """Share of accepted offers; the newest accepted or rejected event of an offer decides."""
    status = F.coalesce(F.nullif(F.lower(F.trim("status")), F.lit("")), F.lit("unknown"))
    decided = order_events.where(F.col("offer_id") != "").withColumn("status", status).where(
        F.col("status").isin("accepted", "rejected"))
    final = latest_by(decided.select("offer_id", "event_id", "status", "ts"), ["offer_id"], "ts", "event_id")
    accepted = F.count_if(F.col("status") == "accepted")
    return final.agg(
        F.count("*").alias("decided_offers"), accepted.alias("accepted_offers"),
        F.count_if(F.col("status") == "rejected").alias("rejected_offers"),
        _pct(accepted, F.count("*")).alias("accept_rate_pct"))


def offer_net(offers: DataFrame) -> DataFrame:
    return offers.agg(round_half_up(F.avg("net_eur_h"), 2).alias("avg_net_eur_h"),
                      round_half_up(F.avg("net_eur"), 2).alias("avg_net_eur"))


def by_platform(signals: DataFrame, n: int = 10) -> DataFrame:
    tag = F.coalesce(F.nullif(F.split_part("source_platform", F.lit(";"), F.lit(1)), F.lit("")), F.lit("unknown"))
    return signals.groupBy(tag.alias("source_platform")).agg(F.count("*").alias("cnt")).orderBy(
        F.desc("cnt"), "source_platform").limit(n)


def hour_profile(signals: DataFrame, n: int = 5) -> DataFrame:
    return signals.groupBy("hour").agg(
        round_half_up(F.avg("demand_index"), 4).alias("avg_demand"),
        round_half_up(F.avg("pressure_ratio"), 4).alias("avg_pressure"),
    ).orderBy(F.desc("avg_demand"), "hour").limit(n)


def weather_profile(signals: DataFrame) -> DataFrame:
    return signals.groupBy(round_half_up("weather_factor", 1).alias("weather_bucket")).agg(
        round_half_up(F.avg("demand_index"), 4).alias("avg_demand"), F.count("*").alias("n")).orderBy("weather_bucket")


def realised_missions(missions: DataFrame) -> DataFrame:
    return missions.where(F.col("realized_net_eur_h").isNotNull()).agg(
        F.count("*").alias("missions"), round_half_up(F.avg("realized_net_eur_h"), 2).alias("avg_realized_net_eur_h"))


def signal_count_and_demand(signals: DataFrame) -> DataFrame:
    return signals.agg(F.count("*").alias("signals"), round_half_up(F.avg("demand_index"), 6).alias("avg_demand"))


def pressure_by_zone(signals: DataFrame, n: int = 10) -> DataFrame:
    return signals.groupBy("zone_id").agg(round_half_up(F.avg("pressure_ratio"), 6).alias("avg_pressure")).orderBy(
        F.desc("avg_pressure"), "zone_id").limit(n)
