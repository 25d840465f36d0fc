"""Reports over courier positions: density, trajectories, productivity, coverage, demand and surge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courierworks.functions.geo import cell_centre, cell_index, haversine_km
from courierworks.functions.num import clamp, flag, ratio, round_half_up
from courierworks.functions.status import canonical_status, status_bucket
from courierworks.operators.keyed import latest_by, time_bucket, top_per_key, with_previous
from courierworks.operators.spatial import radius_join

SPEED_ALERT_KMH = 65.0


def between(start: Column, end: Column, ts: str = "ts") -> Column:
    return (F.col(ts) >= start) & (F.col(ts) <= end)


def minutes_before(ref: Column, minutes: float) -> Column:
    return F.timestamp_micros((F.unix_micros(ref) - F.lit(int(minutes * 60_000_000))).cast("long"))


def by_cell(df: DataFrame, resolution: float) -> DataFrame:
    return df.withColumn("__i", cell_index("lat", resolution)).withColumn("__j", cell_index("lon", resolution))


def heatmap(positions: DataFrame, resolution: float = 0.01, top: int | None = 500) -> DataFrame:
    """Passages and mean speed per grid cell; the busiest `top` cells."""
    cells = (
        by_cell(positions, resolution)
        .groupBy("__i", "__j")
        .agg(F.count("*").alias("passages"), F.avg("speed_kmh").alias("avg_speed"))
        .select(
            cell_centre("__i", resolution, 4).alias("lat_cell"), cell_centre("__j", resolution, 4).alias("lon_cell"),
            "passages", round_half_up(F.coalesce("avg_speed", F.lit(0.0)), 1).alias("avg_speed_kmh"),
        )
    )
    if top is None:
        return cells
    return cells.orderBy(F.desc("passages"), "lat_cell", "lon_cell").limit(top)


def step_km(positions: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Every position with the distance from the previous one of its courier (NULL for the first)."""
    rows = with_previous(positions, "courier_id", "ts", "event_id", ["lat", "lon"], bucket_seconds=bucket_seconds)
    return rows.withColumn("step_km", haversine_km("prev_lat", "prev_lon", "lat", "lon"))


def _track_parts(positions: DataFrame, extra: list[Column], bucket_seconds: int) -> DataFrame:
    """One row per (courier, time bucket): counts, sums, ends and the distance inside the bucket."""
    rows = positions.withColumn("__bucket", time_bucket("ts", bucket_seconds))
    inside = Window.partitionBy("courier_id", "__bucket").orderBy("ts", "event_id")
    rows = rows.withColumn("__plat", F.lag("lat").over(inside)).withColumn("__plon", F.lag("lon").over(inside))
    rows = rows.withColumn("__step", haversine_km("__plat", "__plon", "lat", "lon"))
    point = F.struct("lat", "lon", "ts")
    order = F.struct("ts", "event_id")
    return rows.groupBy("courier_id", "__bucket").agg(
        F.count("*").alias("points"),
        F.coalesce(F.sum("__step"), F.lit(0.0)).alias("km"),
        F.count("speed_kmh").alias("speeds"), F.sum("speed_kmh").alias("speed_sum"),
        F.max("speed_kmh").alias("speed_max"),
        F.min_by(point, order).alias("first"), F.max_by(point, order).alias("last"),
        *extra,
    )


def _with_seams(parts: DataFrame) -> DataFrame:
    """Adds the distance between the last point of a bucket and the first of the next one."""
    w = Window.partitionBy("courier_id").orderBy("__bucket")
    before = parts.withColumn("__before", F.lag("last").over(w))
    return before.withColumn(
        "km",
        F.col("km") + F.coalesce(
            haversine_km(F.col("__before.lat"), F.col("__before.lon"), F.col("first.lat"), F.col("first.lon")),
            F.lit(0.0)),
    )


def trajectory_summary(positions: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Per courier: points, distance, mean and top speed, dominant status, first and last position.

    Of equally frequent statuses the first in alphabetical order is dominant.
    """
    parts = _with_seams(_track_parts(positions, [], bucket_seconds))
    order = F.col("__bucket")
    summary = parts.groupBy("courier_id").agg(
        F.sum("points").alias("points"), round_half_up(F.sum("km"), 2).alias("distance_km"),
        round_half_up(F.coalesce(F.sum("speed_sum") / F.nullif(F.sum("speeds"), F.lit(0)), F.lit(0.0)), 1)
        .alias("avg_speed_kmh"),
        round_half_up(F.coalesce(F.max("speed_max"), F.lit(0.0)), 1).alias("max_speed_kmh"),
        F.min_by("first", order).alias("first"), F.max_by("last", order).alias("last"),
    )
    counts = positions.where(F.col("status") != "").groupBy("courier_id", "status").agg(F.count("*").alias("__n"))
    dominant = top_per_key(counts, ["courier_id"], [F.desc("__n"), F.asc("status")], 1).select(
        "courier_id", F.col("status").alias("dominant_status"))
    return summary.join(dominant, "courier_id", "left").select(
        "courier_id", "points", "distance_km", "avg_speed_kmh", "max_speed_kmh",
        F.coalesce("dominant_status", F.lit("unknown")).alias("dominant_status"),
        F.col("first.lat").alias("first_lat"), F.col("first.lon").alias("first_lon"),
        F.unix_micros("first.ts").alias("first_ts_us"),
        F.col("last.lat").alias("last_lat"), F.col("last.lon").alias("last_lon"),
        F.unix_micros("last.ts").alias("last_ts_us"),
    )


def fleet_productivity(positions: DataFrame, speed_alert_kmh: float = SPEED_ALERT_KMH) -> DataFrame:
    """One row: couriers seen, mean speed, share of delivering points, speeding points, suspicious stops."""
    return positions.agg(
        F.countDistinct("courier_id").alias("couriers"),
        round_half_up(F.avg("speed_kmh"), 1).alias("avg_speed_kmh"),
        round_half_up(F.avg(flag(F.col("status") == "delivering")) * 100.0, 1).alias("delivering_pct"),
        F.count_if(F.col("speed_kmh") > speed_alert_kmh).alias("speed_alerts"),
        F.count_if((F.col("speed_kmh") < 1.0) & (F.col("status") == "delivering")).alias("suspicious_stops"),
    )


def driver_scores(positions: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Per courier: productivity (40), safety (30), reliability (20) and activity (10) points, total and grade."""
    status = lambda word: F.count_if(F.col("status") == word)
    moment = (F.var_pop("speed_kmh") * F.count("speed_kmh")).alias("speed_m2")  # squared distances from the mean of the bucket
    parts = _with_seams(_track_parts(positions, [
        moment, status("delivering").alias("delivering"), status("available").alias("available"),
        status("idle").alias("idle"), F.count_if(F.col("speed_kmh") > 50.0).alias("speeding"),
        F.count_if((F.col("speed_kmh") < 1.0) & (F.col("status") == "delivering")).alias("stops"),
    ], bucket_seconds))
    courier = Window.partitionBy("courier_id")
    away = F.col("speed_sum") / F.col("speeds") - F.sum("speed_sum").over(courier) / F.sum("speeds").over(courier)
    parts = parts.withColumn("speed_m2", F.when(F.col("speeds") > 0, F.col("speed_m2") + F.col("speeds") * away * away))
    total = lambda name: F.sum(name).alias(name)
    sums = parts.groupBy("courier_id").agg(
        total("points"), total("km"), total("speeds"), total("speed_sum"), total("speed_m2"),
        F.max("speed_max").alias("speed_max"), total("delivering"), total("available"), total("idle"),
        total("speeding"), total("stops"),
    )
    pct = lambda name, digits: round_half_up(F.col(name) / F.greatest(F.col("points"), F.lit(1)) * 100.0, digits)
    share = lambda name, factor: F.col(name) / F.greatest(F.col("points"), F.lit(1)) * 100.0 * F.lit(factor)
    n = F.col("speeds").cast("double")
    variance = F.col("speed_m2") / (n - 1.0)
    rated = sums.select(
        "*",
        pct("delivering", 1).alias("delivering_pct"), pct("available", 1).alias("available_pct"),
        pct("idle", 1).alias("idle_pct"),
        F.when(n > 1.0, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(F.lit(0.0)).alias("speed_stddev"),
    ).select(
        "*",
        F.least(F.lit(40.0), round_half_up(F.col("delivering_pct") * 0.4, 1)).alias("productivity"),
        round_half_up(30.0 - F.least(F.lit(30.0), round_half_up(share("speeding", 1.5), 1)), 1).alias("safety"),
        round_half_up(20.0 - F.least(F.lit(20.0), round_half_up(share("stops", 2.0), 1)), 1).alias("reliability"),
        round_half_up(F.greatest(F.lit(0.0), 10.0 - F.col("idle_pct") * 0.15), 1).alias("activity"),
    )
    score = F.col("productivity") + F.col("safety") + F.col("reliability") + F.col("activity")
    graded = rated.withColumn("score", round_half_up(F.greatest(F.lit(0.0), score), 1))
    return graded.select(
        "courier_id", "points", "score",
        F.when(F.col("score") >= 85, "A").when(F.col("score") >= 70, "B").when(F.col("score") >= 55, "C")
        .when(F.col("score") >= 40, "D").otherwise("E").alias("grade"),
        "productivity", "safety", "reliability", "activity",
        round_half_up("km", 2).alias("distance_km"),
        round_half_up(F.col("speed_sum") / n, 1).alias("avg_speed_kmh"),
        round_half_up("speed_max", 1).alias("max_speed_kmh"),
        round_half_up("speed_stddev", 2).alias("speed_stddev"),
        "delivering_pct", "available_pct", "idle_pct", "speeding", "stops",
    )


def fleet_status(latest: DataFrame) -> DataFrame:
    """One row: couriers per status group and the utilisation rates, from the latest row of each courier."""
    groups = ["available", "delivering", "pickup", "repositioning", "idle", "unknown"]
    counted = latest.select(status_bucket("status").alias("b"), canonical_status("status").alias("s")).agg(
        F.count("*").alias("couriers"),
        *[F.count_if(F.col("b") == g).alias(g) for g in groups],
        *[F.count_if(F.col("s") == s).alias(s) for s in ["pickup_assigned", "pickup_en_route", "pickup_arrived"]],
    )
    share = lambda top: round_half_up(F.coalesce(ratio(top * 100.0, F.col("couriers").cast("double")), F.lit(0.0)), 1)
    working = F.col("delivering") + F.col("pickup") + F.col("repositioning")
    return counted.select(
        "*",
        share(F.col("delivering")).alias("utilisation_pct"), share(working).alias("engagement_pct"),
        share(F.col("pickup")).alias("pickup_pct"), share(F.col("repositioning")).alias("repositioning_pct"),
        share(F.col("available")).alias("availability_pct"), share(F.col("idle")).alias("idle_pct"),
    )


def fleet_health(status: DataFrame, productivity: DataFrame, idle_suspects: DataFrame,
                 low_battery: DataFrame) -> DataFrame:
    """One row: health score of the fleet, its level and the recommended actions.

    The four inputs are single-row or counted here, so the joins below see one row each.
    """
    one = lambda df, *cols: df.select(F.lit(1).alias("__one"), *cols)
    joined = (
        one(status, "utilisation_pct", "idle_pct")
        .join(one(productivity, "speed_alerts"), "__one")
        .join(one(idle_suspects.agg(F.count("*").alias("blocked")), "blocked"), "__one")
        .join(one(low_battery.agg(F.count("*").alias("low_battery")), "low_battery"), "__one")
    )
    loss = lambda condition, points: F.when(condition, F.lit(points)).otherwise(F.lit(0))
    score = F.greatest(
        F.lit(0),
        F.lit(100) - loss(F.col("utilisation_pct") < 50, 20) - loss(F.col("idle_pct") > 20, 15)
        - loss(F.col("blocked") > 5, 15) - loss(F.col("speed_alerts") > 10, 10) - loss(F.col("low_battery") > 10, 10),
    ).cast("long")
    actions = F.array_compact(F.array(
        F.when(F.col("utilisation_pct") < 50, "raise_utilisation"),
        F.when(F.col("idle_pct") > 20, "redeploy_idle"),
        F.when(F.col("blocked") > 3, "contact_blocked"),
        F.when(F.col("speed_alerts") > 5, "review_speeding"),
        F.when(F.col("low_battery") > 5, "plan_charging"),
    ))
    return joined.select(
        score.alias("score"), "utilisation_pct", "idle_pct", "blocked", "speed_alerts", "low_battery",
        F.when(F.size(actions) == 0, F.array(F.lit("all_normal"))).otherwise(actions).alias("actions"),
    ).withColumn("level", F.when(F.col("score") >= 85, "excellent").when(F.col("score") >= 65, "good")
                 .when(F.col("score") >= 45, "attention").otherwise("critical"))


def low_battery(latest: DataFrame, threshold: float = 20.0, top: int | None = 5) -> DataFrame:
    found = latest.where((F.col("battery_pct") > 0) & (F.col("battery_pct") < threshold)).select(
        "courier_id", round_half_up("battery_pct", 1).alias("battery_pct"), canonical_status("status").alias("status"))
    return found if top is None else found.orderBy("battery_pct", "courier_id").limit(top)


def _coverage(demand: DataFrame, supply: DataFrame, resolution: float) -> DataFrame:
    """Demand and supply per cell, each divided by its maximum, and their gap."""
    cells = demand.join(supply, ["__i", "__j"], "left").withColumn("drivers", F.coalesce("drivers", F.lit(0)))
    top = F.broadcast(demand.agg(F.max("demand").alias("__dmax")).withColumn("__one", F.lit(1)))
    most = F.broadcast(supply.agg(F.max("drivers").alias("__smax")).withColumn("__one", F.lit(1)))
    scaled = cells.withColumn("__one", F.lit(1)).join(top, "__one").join(most, "__one").select(
        cell_centre("__i", resolution, 4).alias("lat_cell"), cell_centre("__j", resolution, 4).alias("lon_cell"),
        "demand", "drivers",
        (F.col("demand") / F.coalesce(F.nullif(F.col("__dmax").cast("double"), F.lit(0.0)), F.lit(1.0)))
        .alias("demand_share"),
        (F.col("drivers") / F.greatest(F.coalesce("__smax", F.lit(1)), F.lit(1)).cast("double")).alias("supply_share"),
    )
    gap = round_half_up(F.col("demand_share") - F.col("supply_share"), 3)
    return scaled.where(F.col("demand_share") >= 0.1).select(
        "lat_cell", "lon_cell", "demand", "drivers", gap.alias("coverage_gap")
    ).withColumn("state", F.when(F.col("coverage_gap") < -0.15, "over").when(F.col("coverage_gap") > 0.20, "under")
                 .otherwise("balanced"))


def supply_cells(latest: DataFrame, resolution: float, centre: tuple[float, float] | None = None,
                 radius_km: float | None = None) -> DataFrame:
    """Couriers per cell; with a centre and a radius only those within it."""
    near = latest
    if centre is not None and radius_km is not None:
        near = latest.where(haversine_km(F.lit(centre[0]), F.lit(centre[1]), "lat", "lon") <= radius_km)
    return by_cell(near, resolution).groupBy("__i", "__j").agg(F.count("*").alias("drivers"))


def zone_coverage(history: DataFrame, latest: DataFrame, resolution: float = 0.02,
                  centre: tuple[float, float] | None = None, radius_km: float | None = None) -> DataFrame:
    """Cells that are short of couriers or have too many, from past passages and current positions."""
    demand = by_cell(history, resolution).groupBy("__i", "__j").agg(F.count("*").alias("demand"))
    return _coverage(demand, supply_cells(latest, resolution, centre, radius_km), resolution)


def zone_coverage_from_context(zone_state: DataFrame, latest: DataFrame, resolution: float = 0.02) -> DataFrame:
    """The same with the demand signal of the zones; needs lat, lon, demand_index, forecast_demand_index_15m.

    Both zone keyings work here because the coordinates come with the row.
    """
    demand = by_cell(zone_state, resolution).groupBy("__i", "__j").agg(
        F.max(F.greatest("demand_index", "forecast_demand_index_15m")).alias("demand"))
    return _coverage(demand, supply_cells(latest, resolution), resolution)


def _trend_labels(trend: Column) -> tuple[Column, Column]:
    signal = F.when(trend > 15, "rising").when(trend < -15, "falling").otherwise("stable")
    action = F.when(trend > 15, "send_courier").when(trend < -15, "redeploy").otherwise("keep_coverage")
    return signal, action


def demand_trend(positions: DataFrame, ref: Column, resolution: float = 0.02, top: int | None = 30) -> DataFrame:
    """Activity of the last 15 minutes against the mean 15 minutes of the 45 before, per cell, in one pass."""
    recent_start, base_start = minutes_before(ref, 15), minutes_before(ref, 60)
    recent = F.col("ts") >= recent_start
    rows = positions.where(between(base_start, ref))
    cells = by_cell(rows, resolution).groupBy("__i", "__j").agg(
        F.count_if(recent).alias("recent_count"),
        round_half_up(F.avg(F.when(recent, F.col("speed_kmh"))), 1).alias("recent_speed_kmh"),
        F.count_if(~recent).alias("__base"),
    ).where(F.col("recent_count") >= 5)
    base = F.when(F.col("__base") > 0, F.col("__base") / 3.0).otherwise(F.col("recent_count").cast("double"))
    trend = round_half_up((F.col("recent_count") - F.col("__b")) / F.col("__b") * 100.0, 1)
    signal, action = _trend_labels(F.col("trend_pct"))
    out = cells.withColumn("__b", base).select(
        cell_centre("__i", resolution, 4).alias("lat_cell"), cell_centre("__j", resolution, 4).alias("lon_cell"),
        "recent_count", "recent_speed_kmh", round_half_up("__b", 1).alias("baseline_count"), trend.alias("trend_pct"),
    ).withColumn("signal", signal).withColumn("action", action)
    return out if top is None else out.orderBy(F.desc("trend_pct"), "lat_cell", "lon_cell").limit(top)


def demand_trend_from_context(zone_state: DataFrame) -> DataFrame:
    """The same outlook from the zone signals instead of positions."""
    demand = F.greatest(F.col("demand_index"), F.lit(0.1))
    forecast = F.greatest(F.col("forecast_demand_index_15m"), F.lit(0.0))
    signal, action = _trend_labels(F.col("trend_pct"))
    return zone_state.select(
        "zone_id", F.greatest(F.lit(1.0), round_half_up(demand * 12.0, 0)).cast("long").alias("recent_count"),
        round_half_up(demand, 1).alias("baseline_count"),
        round_half_up(F.greatest(F.lit(8.0), 18.0 / F.greatest(F.col("traffic_factor"), F.lit(0.2))), 1)
        .alias("recent_speed_kmh"),
        round_half_up((forecast - demand) / demand * 100.0, 1).alias("trend_pct"),
    ).withColumn("signal", signal).withColumn("action", action)


def surge(positions: DataFrame, latest: DataFrame, centres: DataFrame, ref: Column, radius_km: float = 2.0,
          base_price_eur: float = 5.0) -> DataFrame:
    """Price multiplier per centre (centre_id, lat, lon) from demand in a box and couriers in a circle.

    The box is the radius in degrees on both axes; its baseline is the 45 minutes before, divided by four.
    """
    recent_start, base_start = minutes_before(ref, 15), minutes_before(ref, 60)
    rows = positions.where(between(base_start, ref)).select("lat", "lon", "ts")
    hits = radius_join(centres, rows, radius_km, box=True)
    demand = hits.groupBy("centre_id").agg(
        F.count_if(F.col("ts") >= recent_start).alias("recent"), F.count_if(F.col("ts") < recent_start).alias("earlier"))
    near = radius_join(centres, latest.select("lat", "lon", status_bucket("status").alias("bucket")), radius_km)
    supply = near.groupBy("centre_id").agg(
        F.count("*").alias("couriers"), F.count_if(F.col("bucket") == "available").alias("available"))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    base = F.col("earlier") / 4.0
    pressure = F.when(base >= 1.0, round_half_up(clamp(F.col("recent") / base - 1.0, 0.0, 2.0) / 2.0, 3)).when(
        F.col("recent") > 5, F.lit(0.3)).otherwise(F.lit(0.0))
    free = F.col("available") / F.col("couriers")
    scarcity = F.when(F.col("couriers") == 0, F.lit(1.0)).otherwise(round_half_up(1.0 - free, 3))
    rated = (
        centres.join(demand, "centre_id", "left").join(supply, "centre_id", "left")
        .select("centre_id", zero("recent"), zero("earlier"), zero("couriers"), zero("available"))
        .select("*", pressure.alias("demand_pressure"), scarcity.alias("supply_scarcity"),
                F.when(F.col("couriers") == 0, "desert").when(free >= 0.5, "plenty").when(free >= 0.25, "moderate")
                .when(free > 0, "tight").otherwise("saturated").alias("supply_label"))
    )
    multiplier = round_half_up(
        clamp(1.0 + F.col("demand_pressure") + 0.8 * F.col("supply_scarcity"), 1.0, 3.0), 2)
    return rated.withColumn("multiplier", multiplier).select(
        "*", round_half_up(F.lit(base_price_eur) * F.col("multiplier"), 2).alias("price_eur"),
        F.when(F.col("multiplier") >= 2.0, "extreme").when(F.col("multiplier") >= 1.5, "high")
        .when(F.col("multiplier") >= 1.2, "moderate").otherwise("normal").alias("level"),
    )


def speed_baselines(positions: DataFrame, ref: Column, hours: float = 2.0, min_points: int = 20) -> DataFrame:
    """Usual speed per cell before the reference time, for cells with enough points."""
    rows = positions.where(between(minutes_before(ref, hours * 60), ref))
    return by_cell(rows, 0.02).groupBy("__i", "__j").agg(
        round_half_up(F.avg("speed_kmh"), 1).alias("avg_speed_kmh"),
        round_half_up(F.stddev_samp("speed_kmh"), 1).alias("std_speed_kmh"),
        F.count("*").alias("points"),
    ).where(F.col("points") >= min_points).select(
        cell_centre("__i", 0.02, 3).alias("lat_cell"), cell_centre("__j", 0.02, 3).alias("lon_cell"),
        "avg_speed_kmh", "std_speed_kmh", "points")


def zone_hour_profile(positions: DataFrame, resolution: float = 0.01) -> DataFrame:
    """Points, mean speed and delivering points per cell, hour and weekday (0 = Sunday)."""
    return by_cell(positions, resolution).groupBy(
        "__i", "__j", F.hour("ts").cast("long").alias("hour"), (F.dayofweek("ts") - 1).cast("long").alias("weekday")
    ).agg(
        F.count("*").alias("points"), round_half_up(F.avg("speed_kmh"), 1).alias("avg_speed_kmh"),
        F.count_if(F.col("status") == "delivering").alias("delivering"),
    ).select(
        cell_centre("__i", resolution, 3).alias("lat_cell"), cell_centre("__j", resolution, 3).alias("lon_cell"),
        "hour", "weekday", "points", "avg_speed_kmh", "delivering")


def latest_positions(positions: DataFrame) -> DataFrame:
    """The newest position of every courier; at equal times the one with the smaller event id."""
    return latest_by(positions, ["courier_id"], "ts", "event_id")


def max_normalise(df: DataFrame, value: str, name: str) -> DataFrame:
    """`value` divided by its maximum over all rows."""
    top = F.broadcast(df.agg(F.max(value).alias("__max")).withColumn("__one", F.lit(1)))
    return df.withColumn("__one", F.lit(1)).join(top, "__one").withColumn(
        name, F.col(value) / F.nullif(F.col("__max").cast("double"), F.lit(0.0))).drop("__one", "__max")
