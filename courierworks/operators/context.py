"""Zone context: pressure from events, closures and speeds, demand, supply, traffic, and the zone state."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courierworks.functions import context as fx
from courierworks.functions.geo import grid_zone_id
from courierworks.functions.num import at_least, clamp, finite, flag, ratio, round_half_up
from courierworks.functions.status import (build_metadata, metadata_count, metadata_flag, metadata_map,
                                           metadata_number, metadata_tag)
from courierworks.operators.fold import Rule, array_fold, let
from courierworks.operators.keyed import dedupe_keep_first, latest_by
from courierworks.operators.spatial import radius_join

# The oldest age in seconds at which a source still counts.
MAX_AGE_S = {"gbfs": 180.0, "weather": 1500.0, "nyc311": 750.0, "events": 1500.0, "dot_closure": 3600.0, "dot_speeds": 750.0}


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / 1e6


def normalize_city_events(rows: DataFrame) -> DataFrame:
    """City events with UTC times and borough coordinates.

    Times are text; without a zone they are New York time. Events that end before they start or have
    no known borough go; of repeated ids (or name, start and borough without an id) one stays.
    """
    def parsed(name: str) -> Column:
        text = F.trim(F.col(name).cast("string"))
        zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.contains("T")
        plain = text.try_cast("timestamp_ntz").cast("timestamp")
        return F.when(zoned, text.try_cast("timestamp")).otherwise(F.to_utc_timestamp(plain, fx.NEW_YORK))

    borough = fx.normalize_borough("event_borough")
    lat, lon = fx.borough_centre("borough")
    text = lambda name: F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))
    events = rows.select(
        text("event_id").alias("event_id"), text("event_name").alias("event_name"), text("event_type").alias("event_type"),
        text("event_borough").alias("event_borough"), borough.alias("borough"),
        parsed("start_date_time").alias("start_ts"), parsed("end_date_time").alias("end_ts"),
    ).where("end_ts > start_ts AND borough IS NOT NULL").select(
        "*", lat.alias("lat"), lon.alias("lon"), fx.event_intensity("event_type", "event_name").alias("intensity"))
    key = F.when(F.col("event_id") != "", F.col("event_id")).otherwise(
        F.concat_ws("|", "event_name", F.col("start_ts").cast("string"), "event_borough"))
    return dedupe_keep_first(events.withColumn("__key", key), ["__key"], [F.asc("start_ts"), F.asc("event_name")]).drop("__key")


def event_pressure(zones: DataFrame, events: DataFrame, now: Column, radius_km: float = 4.5, lookahead_hours: float = 6.0,
                   post_minutes: float = 60.0, scale: float = 0.55, cap: float = 0.75) -> DataFrame:
    """Per zone the demand pressure of nearby events and their number; zones without events have 0."""
    weight = fx.event_time_weight(seconds(now), seconds(F.col("start_ts")), seconds(F.col("end_ts")), lookahead_hours, post_minutes)
    active = events.select("lat", "lon", "intensity", weight.alias("weight")).where("weight > 0")
    hits = radius_join(zones.select("zone_id", "lat", "lon"), active, radius_km)
    share = F.pow(at_least(1.0 - F.col("distance_km") / radius_km, 0.0), F.lit(2.0))
    sums = hits.groupBy("zone_id").agg(
        F.sum(F.col("intensity") * F.col("weight") * share).alias("score"), F.count("*").alias("event_count_nearby"))
    return _all_zones(zones, sums).select(
        "zone_id", round_half_up(clamp(F.coalesce("score", F.lit(0.0)) * scale, 0.0, cap), 4).alias("event_pressure"),
        F.coalesce("event_count_nearby", F.lit(0)).alias("event_count_nearby"))


def _all_zones(zones: DataFrame, sums: DataFrame) -> DataFrame:
    return zones.select("zone_id").join(sums, "zone_id", "left")


def closure_pressure(zones: DataFrame, closures: DataFrame, now: Column, radius_km: float = 4.5, lookahead_hours: float = 72.0,
                     post_minutes: float = 240.0, scale: float = 0.32, cap: float = 0.55) -> DataFrame:
    weight = fx.event_time_weight(seconds(now), seconds(F.col("start_ts")), seconds(F.col("end_ts")), lookahead_hours, post_minutes)
    severity = F.coalesce(F.nullif(finite("severity"), F.lit(0.0)), F.lit(0.3))
    active = closures.select("lat", "lon", at_least(severity, 0.05).alias("severity"), weight.alias("weight")).where("weight > 0")
    hits = radius_join(zones.select("zone_id", "lat", "lon"), active, radius_km)
    share = F.pow(at_least(1.0 - F.col("distance_km") / radius_km, 0.0), F.lit(2.0))
    sums = hits.groupBy("zone_id").agg(F.sum(F.col("severity") * F.col("weight") * share).alias("score"))
    return _all_zones(zones, sums).select(
        "zone_id", round_half_up(clamp(F.coalesce("score", F.lit(0.0)) * scale, 0.0, cap), 4).alias("closure_pressure"))


def speed_pressure(zones: DataFrame, samples: DataFrame, radius_km: float = 3.5, scale: float = 0.55,
                   cap: float = 0.45) -> DataFrame:
    """Per zone the distance-weighted mean severity of slow links; `samples` has lat, lon, severity."""
    slow = samples.select("lat", "lon", "severity").where("severity > 0")
    hits = radius_join(zones.select("zone_id", "lat", "lon"), slow, radius_km)
    weight = at_least(1.0 - F.col("distance_km") / radius_km, 0.0)
    sums = hits.groupBy("zone_id").agg(F.sum(F.col("severity") * weight).alias("top"), F.sum(weight).alias("bottom"))
    mean = F.when(F.col("bottom") > 0, F.col("top") / F.col("bottom")).otherwise(F.lit(0.0))
    return _all_zones(zones, sums).select(
        "zone_id", round_half_up(clamp(F.coalesce(mean, F.lit(0.0)) * scale, 0.0, cap), 4).alias("speed_pressure"))


def stations_joined(status: DataFrame, info: DataFrame) -> DataFrame:
    """Station status with coordinates; stations without information or coordinates go."""
    located = info.where("lat IS NOT NULL AND lon IS NOT NULL").select("station_id", "lat", "lon")
    number = lambda name: F.coalesce(F.col(name).try_cast("long"), F.lit(0).cast("long"))
    return status.join(located, "station_id").select(
        "station_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"),
        number("num_bikes_available").alias("bikes"), number("num_docks_available").alias("docks"))


def station_zone_signal(stations: DataFrame) -> DataFrame:
    """Per grid zone: stations, bikes, docks, occupancy and demand boost."""
    occupancy = F.col("bikes_available") / at_least((F.col("bikes_available") + F.col("docks_available")).cast("double"), 1.0)
    sums = stations.groupBy(grid_zone_id("lat", "lon").alias("zone_id")).agg(
        F.count("*").alias("stations_count"), F.sum("bikes").alias("bikes_available"), F.sum("docks").alias("docks_available"))
    return sums.select("*", round_half_up(occupancy, 3).alias("occupancy_ratio"),
                       round_half_up(at_least(1.0 - occupancy, 0.0) * 0.5, 3).alias("demand_boost"))


def _near_counts(zones: DataFrame, points: DataFrame, radius_km: float, name: str) -> DataFrame:
    """Points within both the circle and its box in degrees (111.32 km each), which is slightly smaller."""
    hits = radius_join(zones.select("zone_id", "lat", "lon"), points.select("lat", "lon"), radius_km)
    half_lon = F.lit(radius_km) / at_least(F.cos(F.radians("centre_lat")) * 111.32, 1e-6)
    box = (F.abs(F.col("lat") - F.col("centre_lat")) <= radius_km / 111.32) & (F.abs(F.col("lon") - F.col("centre_lon")) <= half_lon)
    counts = hits.where(box).groupBy("zone_id").agg(F.count("*").alias(name))
    return _all_zones(zones, counts).select("zone_id", F.coalesce(name, F.lit(0)).alias(name))


def zone_demand(zones: DataFrame, stations: DataFrame, event: DataFrame | None = None, temporal: Column | float = 0.0,
                radius_km: float = 0.8, cap: float = 3.2) -> DataFrame:
    """Demand index: stations that run empty nearby, plus event and time pressure."""
    box = radius_join(zones.select("zone_id", "lat", "lon"), stations.select("lat", "lon", "bikes"), radius_km)
    inside = (F.abs(F.col("lat") - F.col("centre_lat")) < 0.02) & (F.abs(F.col("lon") - F.col("centre_lon")) < 0.025)
    low = box.where(inside & (F.col("bikes") < 3)).groupBy("zone_id").agg(F.count("*").alias("low"))
    rows = _all_zones(zones, low)
    boost = F.lit(0.0)
    if event is not None:
        rows = rows.join(event, "zone_id", "left")
        boost = at_least(F.coalesce("event_pressure", F.lit(0.0)), 0.0)
    boost = boost + (temporal if isinstance(temporal, Column) else F.lit(float(temporal)))
    base = 1.0 + F.least(F.coalesce("low", F.lit(0)) / 5.0, F.lit(1.5))
    return rows.select("zone_id", round_half_up(F.least(base + boost, F.lit(cap)), 3).alias("demand_index"))


def zone_supply(zones: DataFrame, couriers: DataFrame, radius_km: float = 1.0) -> DataFrame:
    hits = radius_join(zones.select("zone_id", "lat", "lon"), couriers.select("lat", "lon"), radius_km)
    counts = hits.groupBy("zone_id").agg(F.count("*").alias("n"))
    return _all_zones(zones, counts).select(
        "zone_id", round_half_up(clamp(F.coalesce("n", F.lit(0)) / 4.0, 0.2, 5.0), 3).alias("supply_index"))


def zone_traffic(zones: DataFrame, incidents: DataFrame, closure: DataFrame, speed: DataFrame, precip_mm: Column,
                 now: Column, radius_km: float = 1.5, cap: float = 2.4) -> DataFrame:
    rows = _near_counts(zones, incidents, radius_km, "incidents").join(closure, "zone_id").join(speed, "zone_id")
    total = (1.0 + F.least(F.col("incidents") / 12.0, F.lit(0.45)) + F.least(at_least(precip_mm, 0.0) / 6.0, F.lit(0.2))
             + fx.rush_hour_factor(now) + F.col("closure_pressure") + F.col("speed_pressure"))
    return rows.select("zone_id", round_half_up(F.least(total, F.lit(cap)), 3).alias("traffic_factor"))


def source_freshness(sources: DataFrame, now: Column) -> DataFrame:
    """Age and staleness per source (name, last_updated)."""
    limits = F.create_map(*[x for name, age in MAX_AGE_S.items() for x in (F.lit(name), F.lit(age))])
    age = F.when(F.col("last_updated").isNull(), F.lit(-1.0)).otherwise(
        at_least(seconds(now) - seconds(F.col("last_updated")), 0.0))
    rows = sources.select("name", age.alias("age_s"), F.try_element_at(limits, F.col("name")).alias("max_age_s"))
    return rows.withColumn("stale", (F.col("age_s") < 0) | (F.col("age_s") > at_least("max_age_s", 1.0)))


def freshness_row(freshness: DataFrame) -> DataFrame:
    """One row: `age_<source>_s` and `stale_<source>` of the known sources, their count and the fallback flag."""
    pick = lambda name, column: F.max(F.when(F.col("name") == name, F.col(column)))
    return freshness.agg(
        *[F.coalesce(pick(n, "age_s"), F.lit(-1.0)).alias(f"age_{n}_s") for n in MAX_AGE_S],
        *[F.coalesce(pick(n, "stale"), F.lit(True)).alias(f"stale_{n}") for n in MAX_AGE_S],
    ).withColumn("stale_count", sum((F.col(f"stale_{n}").cast("long") for n in MAX_AGE_S), F.lit(0).cast("long"))
                 ).withColumn("fallback_applied", F.col("stale_count") > 0)


def build_context_signals(zones: DataFrame, stations: DataFrame, events: DataFrame, closures: DataFrame, speeds: DataFrame,
                          incidents: DataFrame, couriers: DataFrame, precip_mm: float, wind_kmh: float,
                          sources: DataFrame, now: Column, tag: str = "gbfs+open-meteo") -> DataFrame:
    """The signal of every zone at one time. Stale sources count as empty, stale weather as calm."""
    row = freshness_row(source_freshness(sources, now)).first().asDict()  # one row
    fresh = lambda df, name: df.where(F.lit(not row[f"stale_{name}"]))
    calm = row["stale_weather"]
    precip, wind = F.lit(0.0 if calm else float(precip_mm)), F.lit(0.0 if calm else float(wind_kmh))
    when = fx.temporal_context(now)
    event = event_pressure(zones, fresh(events, "events"), now)
    closure = closure_pressure(zones, fresh(closures, "dot_closure"), now)
    speed = speed_pressure(zones, fresh(speeds, "dot_speeds"))
    demand = zone_demand(zones, fresh(stations, "gbfs"), event, when["temporal_pressure"])
    traffic = zone_traffic(zones, fresh(incidents, "nyc311"), closure, speed, precip, now)
    joined = demand.join(zone_supply(zones, couriers), "zone_id").join(traffic, "zone_id").join(event, "zone_id").join(
        closure, "zone_id").join(speed, "zone_id")
    values = {
        "event_pressure": F.col("event_pressure"), "event_count_nearby": F.col("event_count_nearby"),
        "weather_precip_mm": precip, "weather_wind_kmh": wind, "weather_intensity": fx.weather_intensity(precip, wind),
        "temporal_hour_local": when["hour_local"], "temporal_is_peak": when["is_peak_hour"],
        "temporal_is_weekend": when["is_weekend"], "temporal_is_holiday": when["is_holiday"],
        "temporal_pressure": when["temporal_pressure"], "freshness_policy": F.lit("stale_neutral_v1"),
        "freshness_fallback_applied": F.lit(row["fallback_applied"]), "freshness_stale_sources": F.lit(row["stale_count"]),
        **{f"age_{n}_s": F.lit(row[f"age_{n}_s"]) for n in MAX_AGE_S},
        **{f"stale_{n}": F.lit(row[f"stale_{n}"]) for n in MAX_AGE_S},
    }
    kinds = {key: "decimal" for key in values} | {
        "event_count_nearby": "text", "freshness_policy": "text", "freshness_stale_sources": "text",
        "temporal_is_peak": "flag", "temporal_is_weekend": "flag", "temporal_is_holiday": "flag",
        "freshness_fallback_applied": "flag", **{f"stale_{n}": "flag" for n in MAX_AGE_S}}
    return joined.select(
        "zone_id", now.alias("ts"), "demand_index", "supply_index", fx.weather_factor(precip, wind).alias("weather_factor"),
        "traffic_factor", "event_pressure", "closure_pressure", "speed_pressure", "event_count_nearby",
        build_metadata(F.lit(tag), values, kinds).alias("source"))


def context_quality(signals: DataFrame, window: int = 10, min_ticks: int = 6, epsilon: float = 0.03) -> DataFrame:
    """Quality figures per tick (`ts`) and the alert for a supply that no longer changes."""
    # The indices have three digits, the pressure four: sums of whole numbers do not depend on the order of the rows.
    whole = lambda name, scale: F.round(F.col(name) * scale).cast("long")
    mean = lambda name, scale=1000: F.sum(whole(name, scale)) / F.lit(float(scale)) / F.count(name)
    square = F.sum(whole("supply_index", 1000) * whole("supply_index", 1000)) * F.count("supply_index") - F.pow(F.sum(whole("supply_index", 1000)), F.lit(2)).cast("long")
    variance = square / F.pow(F.count("supply_index").cast("double"), F.lit(2.0)) / F.lit(1e6)
    per_tick = signals.groupBy("ts").agg(
        F.count("*").alias("zones"), F.min("supply_index").alias("supply_min"), F.max("supply_index").alias("supply_max"),
        mean("supply_index").alias("supply_mean"), variance.alias("supply_variance"),
        F.avg(flag(F.col("traffic_factor") > 1.01)).alias("traffic_nonzero_rate"), mean("traffic_factor").alias("traffic_mean"),
        mean("event_pressure", 10_000).alias("event_pressure_mean"), F.max("event_pressure").alias("event_pressure_max"),
        F.avg(flag(F.col("event_pressure") > 0.001)).alias("event_pressure_nonzero_rate"))
    rows = rolling_span(per_tick.withColumn("__mean4", round_half_up("supply_mean", 4)), "__mean4", "ts", window)
    return rows.select(
        "ts", "zones", *[round_half_up(c, 3).alias(c) for c in ["supply_min", "supply_max", "supply_mean"]],
        round_half_up(F.sqrt("supply_variance"), 3).alias("supply_std"), round_half_up("supply_variance", 5).alias("supply_variance"),
        round_half_up("span", 5).alias("supply_window_span"), "cycles",
        ((F.col("cycles") >= min_ticks) & (F.col("span") <= epsilon)).alias("supply_flat_alert"),
        round_half_up("traffic_nonzero_rate", 3).alias("traffic_nonzero_rate"), round_half_up("traffic_mean", 3).alias("traffic_mean"),
        *[round_half_up(c, 4).alias(c) for c in ["event_pressure_mean", "event_pressure_max", "event_pressure_nonzero_rate"]])


def rolling_span(ticks: DataFrame, value: str, order: str, n: int = 10) -> DataFrame:
    """Largest minus smallest of the last `n` rows, and how many there were.

    `ticks` is one series of ticks. It is cut into days; a day also sees the last n - 1 rows of each of the n - 1 days with rows before it,
    which hold the n - 1 rows before its first one, however short those days are. No task holds more than a day and those few rows.
    """
    rows = ticks.withColumn("__day", F.floor(F.unix_micros(order) / F.lit(86_400_000_000)))
    numbered = rows.select("__day").distinct().withColumn("__number", F.row_number().over(Window.orderBy("__day")))  # one row per day
    tails = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__day").orderBy(F.desc(order)))).where(F.col("__r") < n).drop("__r")
    ahead = tails.join(numbered, "__day").withColumn("__number", F.explode(F.sequence(F.col("__number") + 1, F.col("__number") + n - 1))).drop("__day")
    carried = ahead.join(numbered, "__number").drop("__number").withColumn("__carried", F.lit(True))
    both = rows.withColumn("__carried", F.lit(False)).unionByName(carried)
    w = Window.partitionBy("__day").orderBy(order).rowsBetween(-(n - 1), 0)
    spans = both.withColumns({"span": F.max(value).over(w) - F.min(value).over(w), "cycles": F.count("*").over(w)})
    return spans.where(~F.col("__carried")).drop("__carried", "__day")


ZONE_TREND = T.StructType([
    T.StructField("demand_trend", T.DoubleType()), T.StructField("demand_trend_ema", T.DoubleType()),
    T.StructField("forecast_demand_index_15m", T.DoubleType()), T.StructField("context_tick_s", T.DoubleType())])


def _round3(x: float) -> float:
    return math.floor(x * 1000.0 + 0.5) / 1000.0


def zone_trend_step(state, row):
    """Trend and its moving average. State: demand, moving average and time of the signal before."""
    demand, us = row
    before, ema, seen = state if state is not None else (demand, 0.0, None)
    trend = demand - before
    ema = 0.65 * trend + 0.35 * ema
    forecast = max(0.3, demand + ema * 1.4)
    tick = None if seen is None else _round3(max(0.0, (us - seen) / 1e6))
    return (_round3(trend), _round3(ema), _round3(forecast), tick), [demand, _round3(ema), us]


TREND_STATE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("demand", "ema", "seen")])


def _trend_update(state: Column, row: Column) -> Column:
    demand, us = row["__demand"], row["__us"]
    trend = demand - F.coalesce(state["demand"], demand)
    both = F.struct(trend.alias("trend"), (F.lit(0.65) * trend + F.lit(0.35) * F.coalesce(state["ema"], F.lit(0.0))).alias("ema"))
    tick = F.when(state["seen"].isNotNull(), round_half_up(F.greatest((us - state["seen"]) / 1e6, F.lit(0.0)), 3))
    return let(both, lambda b: F.struct(
        F.struct(demand.alias("demand"), round_half_up(b["ema"], 3).alias("ema"), us.alias("seen")).alias("state"),
        F.struct(round_half_up(b["trend"], 3).alias("demand_trend"), round_half_up(b["ema"], 3).alias("demand_trend_ema"),
                 round_half_up(F.greatest(demand + b["ema"] * 1.4, F.lit(0.3)), 3).alias("forecast_demand_index_15m"), tick.alias("context_tick_s")).alias("out")))


ZONE_RULE = Rule(TREND_STATE, _trend_update)


def zone_trend_ema(signals: DataFrame, **fold) -> DataFrame:
    """Trend, smoothed trend and 15-minute forecast of every signal; the rounded average feeds the next one."""
    rows = signals.withColumns({"__demand": round_half_up("demand_index", 3), "__us": F.unix_micros("ts").cast("double")})
    return array_fold(rows, "zone_id", "ts", "event_id", ["__demand", "__us"], ["event_id"], zone_trend_step, ZONE_RULE, ZONE_TREND, **fold)


def parse_signal(signals: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Context signals with their metadata as typed columns, and the columns `keep` as they are."""
    meta = F.col("__meta")
    number = lambda key, digits, default=0.0, low=None, high=None: round_half_up(metadata_number(meta, key, default, low, high), digits)
    rows = signals.withColumn("__meta", metadata_map("source"))
    return rows.select(
        "event_id", "zone_id", "ts", *keep, *[round_half_up(c, 3).alias(c) for c in
                                              ["demand_index", "supply_index", "weather_factor", "traffic_factor"]],
        number("event_pressure", 4, 0.0, 0.0, 2.0).alias("event_pressure"),
        metadata_count(meta, "event_count_nearby", 0, 0, 5000).alias("event_count_nearby"),
        number("weather_precip_mm", 3, 0.0, 0.0, 200.0).alias("weather_precip_mm"),
        number("weather_wind_kmh", 3, 0.0, 0.0, 250.0).alias("weather_wind_kmh"),
        number("weather_intensity", 4, 0.0, 0.0, 1.0).alias("weather_intensity"),
        number("temporal_hour_local", 3, -1.0, -1.0, 24.0).alias("temporal_hour_local"),
        metadata_flag(meta, "temporal_is_peak").alias("is_peak_hour"),
        metadata_flag(meta, "temporal_is_weekend").alias("is_weekend"),
        metadata_flag(meta, "temporal_is_holiday").alias("is_holiday"),
        number("temporal_pressure", 4, 0.0, 0.0, 2.0).alias("temporal_pressure"),
        metadata_flag(meta, "freshness_fallback_applied").alias("context_fallback_applied"),
        metadata_count(meta, "freshness_stale_sources", 0, 0, 12).alias("context_stale_sources"),
        F.coalesce(meta["freshness_policy"], F.lit("")).alias("freshness_policy"),
        *[number(f"age_{n}_s", 3, -1.0).alias(f"age_{n}_s") for n in MAX_AGE_S],
        *[metadata_flag(meta, f"stale_{n}").alias(f"stale_{n}") for n in MAX_AGE_S],
        F.coalesce(F.nullif(metadata_tag("source"), F.lit("")), "source").alias("source"))


TREND_COLUMNS = tuple(field.name for field in ZONE_TREND.fields)
SIGNAL_COLUMNS = ["event_id", "ts", "demand_index", "supply_index", "weather_factor", "traffic_factor", "source"]


def _with_trend(signals: DataFrame, **fold) -> DataFrame:
    """Every signal with its trend columns, carried through the fold, so that nothing is joined back."""
    rows = signals.withColumns({"__demand": round_half_up("demand_index", 3), "__us": F.unix_micros("ts").cast("double")})
    return array_fold(rows, "zone_id", "ts", "event_id", ["__demand", "__us"], SIGNAL_COLUMNS, zone_trend_step, ZONE_RULE, ZONE_TREND, **fold)


def zone_context_history(signals: DataFrame, **fold) -> DataFrame:
    """Every parsed signal with its trend columns."""
    return parse_signal(_with_trend(signals, **fold), TREND_COLUMNS)


def zone_context_state(signals: DataFrame, **fold) -> DataFrame:
    """The newest signal of every zone, parsed, with its trend columns; only the newest is parsed."""
    return parse_signal(latest_by(_with_trend(signals, **fold), ["zone_id"], "ts", "event_id"), TREND_COLUMNS)


def zone_opportunity(state: DataFrame, zones: DataFrame) -> DataFrame:
    """Zone state with defaults, coordinates (centroid by id, else from a `lat_lon` id) and opportunity score."""
    supply = at_least(F.coalesce("supply_index", F.lit(1.0)), 0.2)
    traffic = at_least(F.coalesce("traffic_factor", F.lit(1.0)), 0.2)
    demand, weather = F.coalesce("demand_index", F.lit(1.0)), F.coalesce("weather_factor", F.lit(1.0))
    rows = state.withColumns({"demand_index": demand, "supply_index": supply, "weather_factor": weather, "traffic_factor": traffic})
    return resolve_zone_coords(rows, zones).withColumn(
        "opportunity_score", round_half_up(F.col("demand_index") / F.col("supply_index") * F.col("weather_factor") / F.col("traffic_factor"), 4))


def resolve_zone_coords(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """Adds lat and lon of `zone_id`: the centroid with that id (with or without `nyc_`), else a `lat_lon` id."""
    from courierworks.operators.keyed import join_checked

    bare = lambda c: F.regexp_replace(F.trim(c), r"^nyc_", "")
    known = zones.select(bare(F.col("zone_id")).alias("__bare"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    parts = F.split(F.trim("zone_id"), "_", 2)
    grid_lat, grid_lon = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    is_grid = grid_lat.between(-90, 90) & grid_lon.between(-180, 180) & ~F.trim("zone_id").startswith("nyc_")
    joined = join_checked(rows.withColumn("__bare", bare(F.col("zone_id"))), known, ["__bare"], "left")
    return joined.withColumns({
        "lat": round_half_up(F.coalesce("__lat", F.when(is_grid, grid_lat)), 6),
        "lon": round_half_up(F.coalesce("__lon", F.when(is_grid, grid_lon)), 6)}).drop("__bare", "__lat", "__lon")


def routing_rates(status: DataFrame) -> DataFrame:
    """Success and hold rates of a replay; NULL without requests or positions."""
    return status.select("*", ratio(F.col("routing_successes").cast("double"), F.col("routing_requests").cast("double")).alias("routing_success_rate"),
                         ratio(F.col("hold_ticks").cast("double"), F.col("positions_emitted").cast("double")).alias("hold_rate"))
