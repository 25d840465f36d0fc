"""Driver profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierworks.functions.cost import VEHICLE_MPG
from courierworks.functions.num import clamp, finite, round_half_up

# Default, lower and upper bound of every field.
FIELDS = {"target_eur_h": (18.0, 0.0, 150.0), "vehicle_mpg": (VEHICLE_MPG, 1.0, 120.0),
          "aversion_risque": (0.5, 0.0, 1.0), "max_eta": (20.0, 3.0, 60.0)}


def normalize_driver_profile(profiles: DataFrame) -> DataFrame:
    """Fields with defaults and bounds, and the dispatch strategy that follows from risk aversion."""
    clean = profiles.select("courier_id", *[
        round_half_up(clamp(finite(name, default), low, high), 3).alias(name)
        for name, (default, low, high) in FIELDS.items()])
    risk = F.col("aversion_risque")
    return clean.withColumn("dispatch_strategy", F.when(risk >= 0.67, "conservative").when(risk <= 0.33, "aggressive")
                            .otherwise("balanced"))


def upsert_profiles(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Profiles after partial updates (columns of FIELDS, NULL keeps the old value, and `updated_at`).

    The newest given value of every field wins, found with one aggregation per courier that combines
    before the shuffle.
    """
    fields = list(FIELDS)
    stacked = base.select("courier_id", *fields, F.lit(None).cast("timestamp").alias("updated_at")).unionByName(
        updates.select("courier_id", *fields, "updated_at"))
    time = F.coalesce("updated_at", F.timestamp_micros(F.lit(0).cast("long")))
    merged = stacked.groupBy("courier_id").agg(*[
        F.max_by(name, F.when(F.col(name).isNotNull(), time)).alias(name) for name in fields])
    return normalize_driver_profile(merged)


def with_profile(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rows with the profile fields of their courier; couriers without a profile get the defaults."""
    from courierworks.operators.keyed import join_checked

    joined = join_checked(rows, normalize_driver_profile(profiles), ["courier_id"], "left")
    return joined.withColumns({
        **{name: F.coalesce(name, F.lit(default)) for name, (default, _, _) in FIELDS.items()},
        "dispatch_strategy": F.coalesce("dispatch_strategy", F.lit("balanced"))})
