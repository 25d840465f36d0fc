"""Plausibility rules for GPS points; a rejected point leaves the courier's state untouched."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courierworks.functions.geo import haversine_km
from courierworks.functions.status import MOVING_STATUSES, route_source
from courierworks.operators.fold import Rule, array_fold, let, ordered_fold
from courierworks.operators.keyed import is_small, time_bucket


@dataclass(frozen=True)
class Limits:
    max_jump_km: float = 4.0
    max_speed_kmh: float = 120.0
    backtrack_km: float = 0.8
    backtrack_window_s: float = 90.0
    backtrack_return_km: float = 0.05
    frozen_m: float = 8.0
    frozen_streak: int = 4
    frozen_min_speed_kmh: float = 2.0
    ttl_s: float | None = None


VERDICT = T.StructType([
    T.StructField("reason", T.StringType()), T.StructField("delta_s", T.DoubleType()),
    T.StructField("distance_km", T.DoubleType()), T.StructField("implied_speed_kmh", T.DoubleType()),
    T.StructField("frozen_count", T.LongType()),
])
INPUTS = ["__us", "lat", "lon", "speed_kmh", "__moving"]


_RADIAN = math.pi / 180.0


def _km(lat1: float, lon1: float, lat2: float, lon2: float, unknown: float = 0.0) -> float:
    """Great-circle distance; `unknown` is the chord when a coordinate is no number."""
    a, b = math.sin((lat2 - lat1) * _RADIAN / 2), math.sin((lon2 - lon1) * _RADIAN / 2)
    chord = a * a + math.cos(lat1 * _RADIAN) * math.cos(lat2 * _RADIAN) * b * b
    return 12742.0 * math.asin(math.sqrt(chord if chord <= 1.0 else 1.0 if chord > 1.0 else unknown))


def _known_km(lat1: float | None, lon1: float | None, lat2: float | None, lon2: float | None) -> float | None:
    """Great-circle distance as expressions give it: None without a coordinate, half a turn when one is NaN or infinite."""
    try:
        return _km(lat1, lon1, lat2, lon2, 1.0)
    except TypeError:
        return None
    except ValueError:
        return 12742.0 * math.asin(1.0)


def guard_step(limits: Limits, known: bool = False):
    """The rule set as a fold step.

    State: time, latitude and longitude of the last accepted point, the same of the one before it
    (NaN when there is none), the count of frozen points, and the time of the last point seen.
    With `known` a missing value is None and NaN is larger than all numbers, as in `guard_rule`; else NaN is a missing value.
    """
    way = _known_km if known else _km

    def step(state, row):
        us, lat, lon, speed, moving = row
        if us is None or us != us:
            return ("invalid_ts", 0.0, 0.0, 0.0, 0), state
        if state is not None and limits.ttl_s is not None and us - state[7] > limits.ttl_s * 1e6:
            state = None
        if state is None:
            return (None, 0.0, 0.0, 0.0, 0), [us, lat, lon, math.nan, math.nan, math.nan, 0.0, us]
        at, at_lat, at_lon, before, before_lat, before_lon, frozen, _ = state
        seen = state[:7] + [max(us, state[7])]
        seconds = (us - at) / 1e6
        if seconds <= 0:
            return ("non_monotonic_ts", seconds, 0.0, 0.0, 0), seen
        km = way(at_lat, at_lon, lat, lon)
        if km is None:
            return (None, seconds, None, None, 0), [us, lat, lon, at, at_lat, at_lon, 0.0, us]
        if km > limits.max_jump_km:
            return ("jump_too_large", seconds, km, 0.0, 0), seen
        kmh = km / (seconds / 3600.0)
        if kmh > limits.max_speed_kmh:
            return ("implied_speed_too_high", seconds, km, kmh, 0), seen
        if before == before and (us - before) / 1e6 <= limits.backtrack_window_s:
            out = way(before_lat, before_lon, at_lat, at_lon)
            if out is not None and out >= limits.backtrack_km and way(before_lat, before_lon, lat, lon) <= limits.backtrack_return_km:
                return ("implausible_backtrack", seconds, km, kmh, 0), seen
        fast = speed is not None and (speed >= limits.frozen_min_speed_kmh or known and speed != speed)
        still = km * 1000.0 <= limits.frozen_m and moving and fast
        frozen = frozen + 1 if still else 0
        if frozen >= limits.frozen_streak:
            return ("gps_frozen", seconds, km, kmh, int(frozen)), seen
        return (None, seconds, km, kmh, int(frozen)), [us, lat, lon, at, at_lat, at_lon, float(frozen), us]

    return step


GUARD_STATE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("at", "at_lat", "at_lon", "before", "before_lat", "before_lon", "frozen", "seen", "step_km")])


def guard_rule(limits: Limits) -> Rule:
    """The same rule set as expressions.

    `before` is NULL when there is no point before the last accepted one; `step_km` is the way between these two, so that the distance back
    is needed only after a long step.
    """

    def update(state: Column, row: Column) -> Column:
        us, lat, lon = row["__us"], row["lat"], row["lon"]
        expired = us - state["seen"] > limits.ttl_s * 1e6 if limits.ttl_s is not None else F.lit(False)
        far_out = ((us - state["before"]) / 1e6 <= limits.backtrack_window_s) & (state["step_km"] >= limits.backtrack_km)
        facts = F.struct(
            (state.isNull() | expired).alias("fresh"), ((us - state["at"]) / 1e6).alias("seconds"), haversine_km(state["at_lat"], state["at_lon"], lat, lon).alias("km"),
            F.when(far_out, haversine_km(state["before_lat"], state["before_lon"], lat, lon)).alias("back"))

        def judged(f: Column) -> Column:
            kmh = F.when(f["seconds"] > 0, f["km"] / (f["seconds"] / 3600.0))
            still = (f["km"] * 1000.0 <= limits.frozen_m) & (row["__moving"] == 1) & (row["speed_kmh"] >= limits.frozen_min_speed_kmh)
            return F.struct(f["fresh"].alias("fresh"), f["seconds"].alias("seconds"), f["km"].alias("km"), kmh.alias("kmh"),
                            (f["back"] <= limits.backtrack_return_km).alias("returned"),
                            F.when(still, state["frozen"] + 1.0).otherwise(0.0).alias("frozen"))

        def settled(j: Column) -> Column:
            lost = us.isNull() | F.isnan(us)
            reason = (F.when(lost, "invalid_ts").when(j["fresh"], F.lit(None)).when(j["seconds"] <= 0, "non_monotonic_ts").when(j["km"] > limits.max_jump_km, "jump_too_large")
                      .when(j["kmh"] > limits.max_speed_kmh, "implied_speed_too_high").when(j["returned"], "implausible_backtrack").when(j["frozen"] >= limits.frozen_streak, "gps_frozen"))
            return let(F.struct(j.alias("j"), reason.alias("reason"), (lost | j["fresh"]).alias("first")), lambda v: F.struct(
                _next_state(v, state, us, lat, lon, lost).alias("state"), _verdict(v).alias("out")))

        return let(facts, lambda f: let(judged(f), settled))

    return Rule(GUARD_STATE, update)


def _next_state(v: Column, state: Column, us: Column, lat: Column, lon: Column, lost: Column) -> Column:
    point = [us, lat, lon]
    none = F.lit(None).cast("double")
    build = lambda *values: F.struct(*[value.alias(field.name) for value, field in zip(values, GUARD_STATE.fields)])
    same = [state[n] for n in ("at", "at_lat", "at_lon", "before", "before_lat", "before_lon", "frozen")]
    return (F.when(lost, state).when(v["j"]["fresh"], build(*point, none, none, none, F.lit(0.0), us, none))
            .when(v["reason"].isNotNull(), build(*same, F.greatest(us, state["seen"]), state["step_km"]))
            .otherwise(build(*point, state["at"], state["at_lat"], state["at_lon"], v["j"]["frozen"], us, v["j"]["km"])))


def _verdict(v: Column) -> Column:
    j, reason = v["j"], v["reason"]
    moved = ~v["first"] & F.coalesce(reason != "non_monotonic_ts", F.lit(True))
    sped = moved & F.coalesce(reason != "jump_too_large", F.lit(True))
    counted = sped & F.coalesce(reason.isin("gps_frozen"), F.lit(True))
    return F.struct(reason.alias("reason"), F.when(v["first"], 0.0).otherwise(j["seconds"]).alias("delta_s"), F.when(moved, j["km"]).otherwise(0.0).alias("distance_km"),
                    F.when(sped, j["kmh"]).otherwise(0.0).alias("implied_speed_kmh"), F.when(counted, j["frozen"]).otherwise(0.0).cast("long").alias("frozen_count"))


def with_inputs(positions: DataFrame) -> DataFrame:
    return positions.withColumns({
        "__us": F.unix_micros("ts").cast("double"), "__moving": F.col("status").isin(MOVING_STATUSES).cast("int")})


def _judged(positions: DataFrame, carried: list[str], limits: Limits, max_rows: int = 50_000, max_segment: int = 20_000, **fold) -> DataFrame:
    """Courier, `carried` and verdict of every position.

    Expressions judge tables of up to `max_rows` rows without starting Python. They take about 80 microseconds a row, and more where a
    courier has thousands of rows, the step a few; so larger tables are folded row by row.
    """
    rows, keys = with_inputs(positions), ("courier_id", "ts", "event_id")
    if is_small(rows.select("event_id"), max_rows):
        return array_fold(rows, *keys, INPUTS, carried, guard_step(limits), guard_rule(limits), VERDICT, max_segment=max_segment, **fold)
    if not rows.where("courier_id IS NULL").isEmpty():
        segments = rows.select("courier_id", time_bucket("ts", fold.get("segment_seconds", 3600)).alias("segment")).distinct()
        if not segments.groupBy("courier_id").count().where("count > 1").isEmpty():
            rows = rows.where("courier_id IS NOT NULL")  # `array_fold` joins segments by courier
    return ordered_fold(rows, *keys, INPUTS, carried, guard_step(limits, known=True), VERDICT, missing=None, **fold)


def gps_guardrails(positions: DataFrame, limits: Limits = Limits(), **fold) -> DataFrame:
    """Courier, event id and verdict of every position: `reason` is NULL for accepted points."""
    return _judged(positions, ["event_id"], limits, **fold)


def checked_positions(positions: DataFrame, limits: Limits = Limits(), **fold) -> DataFrame:
    """The positions with their verdict columns; repeated messages keep their number of rows."""
    return _judged(positions, [c for c in positions.columns if c != "courier_id"], limits, **fold)


def live_state(checked: DataFrame) -> DataFrame:
    """Latest accepted point per courier, with the anomaly of any later rejected point.

    `stale_reason` is the last reject reason, else 'routing_hold' when the route is on hold. Reads `checked` once.
    """
    point = ["event_id", "ts", "lat", "lon", "speed_kmh", "heading_deg", "status", "accuracy_m", "battery_pct", "source_platform", "frozen_count"]
    accepted = F.col("reason").isNull()
    newest = F.struct(F.col("ts").isNull().alias("none"), (-F.unix_micros("ts")).alias("ago"), F.col("event_id").alias("tie"))
    rows = checked.groupBy("courier_id").agg(
        F.min_by(F.when(accepted, F.struct(*point)), F.when(accepted, newest)).alias("good"),
        F.max_by(F.when(~accepted, F.struct("ts", "reason")), F.when(~accepted, F.struct("ts", "event_id"))).alias("bad")).where("good IS NOT NULL")
    rows = rows.select("courier_id", "good.*", F.when(F.col("courier_id").isNotNull(), F.col("bad")).alias("anomaly"))
    later = F.col("anomaly.ts") >= F.col("ts")
    route = route_source("source_platform")
    return rows.select(
        "courier_id", "event_id", "ts", "lat", "lon", "speed_kmh", "heading_deg", "status", "accuracy_m", "battery_pct",
        "source_platform", route.alias("route_source"),
        F.when(later, "anomalous").otherwise("ok").alias("anomaly_state"),
        F.when(later, F.col("anomaly.reason")).when(route == "hold", "routing_hold").otherwise("").alias("stale_reason"),
        "frozen_count",
    )


def purge_ghosts(latest: DataFrame, now, ttl_s: float = 30.0) -> DataFrame:
    """Only couriers seen within the time to live."""
    return latest.where(F.unix_micros("ts") >= F.unix_micros(now) - F.lit(int(ttl_s * 1e6)))
