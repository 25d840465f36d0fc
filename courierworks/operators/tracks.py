"""Analytics over the recent track of every courier.

A recent track has a bounded number of points per courier by definition, so windows per courier are
small here whatever the courier's whole history holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courierworks.functions.num import round_half_up
from courierworks.functions.status import MOVING_STATUSES, canonical_status, route_source
from courierworks.operators.fleet import SPEED_ALERT_KMH, minutes_before
from courierworks.operators.keyed import top_per_key

TRACK_POINTS = 64
ORDER = ["ts", "event_id"]


def recent_track(positions: DataFrame, n: int = TRACK_POINTS) -> DataFrame:
    """The last `n` points of every courier, with canonical status and route source."""
    state = F.col("anomaly_state") if "anomaly_state" in positions.columns else F.lit("ok")
    rows = positions.select(
        "courier_id", "event_id", "ts", "lat", "lon", "speed_kmh", canonical_status("status").alias("status"),
        route_source("source_platform").alias("route_source"), state.alias("anomaly_state"))
    return top_per_key(rows, ["courier_id"], [F.desc("ts"), F.desc("event_id")], n)


def track_arrays(track: DataFrame) -> DataFrame:
    """One row per courier with its track as an array in time order."""
    point = F.struct("ts", "event_id", "lat", "lon", "speed_kmh", "status", "route_source", "anomaly_state")
    return track.groupBy("courier_id").agg(F.sort_array(F.collect_list(point)).alias("track"))


def focus_trail(positions: DataFrame, courier_id: str, n: int = 60, ref: Column | None = None,
                lookback_max_min: int = 90) -> DataFrame:
    """The last `n` points of one courier; with a reference time only a look-back that grows with `n`."""
    rows = positions.where(F.col("courier_id") == courier_id)
    if ref is not None:
        minutes = max(10, min(lookback_max_min, -(-n // 3)))
        rows = rows.where((F.col("ts") >= minutes_before(ref, minutes)) & (F.col("ts") <= ref))
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(n).orderBy("ts", "event_id")


def _degraded() -> Column:
    return (F.col("route_source") == "hold") | ~F.lower(F.trim("anomaly_state")).isin("", "ok")


def frozen_streaks(track: DataFrame, min_points: int = 12, min_seconds: float = 180.0) -> DataFrame:
    """Per courier the longest run of identical coordinates (5 decimals) while delivering or repositioning."""
    w = Window.partitionBy("courier_id").orderBy(*ORDER)
    rows = track.select(
        "courier_id", *ORDER, F.col("status").isin("delivering", "repositioning").alias("busy"),
        round_half_up("lat", 5).alias("lat5"), round_half_up("lon", 5).alias("lon5"))
    same = F.lag("busy").over(w) & (F.lag("lat5").over(w) == F.col("lat5")) & (F.lag("lon5").over(w) == F.col("lon5"))
    marked = rows.withColumn("__new", F.when(F.col("busy") & F.coalesce(same, F.lit(False)), 0).otherwise(1))
    runs = marked.withColumn("__run", F.sum("__new").over(w)).where("busy").groupBy("courier_id", "__run").agg(
        F.first("lat5").alias("lat"), F.first("lon5").alias("lon"), F.count("*").alias("repetitions"),
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    seconds = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1e6
    long_runs = runs.withColumn("__s", seconds).where(
        (F.col("repetitions") >= min_points) & (F.col("__s") >= min_seconds)
    ).withColumn("duration_s", round_half_up("__s", 0).cast("long"))
    best = top_per_key(long_runs, ["courier_id"], [F.desc("repetitions"), F.desc("duration_s"), F.asc("start_ts")], 1)
    return best.select("courier_id", "lat", "lon", "repetitions", "duration_s", "start_ts", "end_ts")


def frozen_report(streaks: DataFrame) -> DataFrame:
    return streaks.orderBy(F.desc("repetitions"), F.desc("duration_s"), "courier_id")


def in_window(track: DataFrame, ref: Column, minutes: float) -> DataFrame:
    return track.where((F.col("ts") >= minutes_before(ref, minutes)) & (F.col("ts") <= ref))


def gps_frozen(track: DataFrame, ref: Column, minutes: float) -> DataFrame:
    return frozen_report(frozen_streaks(in_window(track, ref, minutes)))


def trailing_stationary(track: DataFrame, speed_kmh: float = 1.5) -> DataFrame:
    """Per courier the seconds and points of the final run of slow delivering points (0 when it is moving)."""
    slow = (F.col("status") == "delivering") & (F.col("speed_kmh") <= speed_kmh)
    whole = Window.partitionBy("courier_id")
    order = F.struct(*ORDER)
    rows = track.select("courier_id", *ORDER, order.alias("__o"),
                        F.max(F.when(~slow, order)).over(whole).alias("__stop"))
    tail = F.col("__stop").isNull() | (F.col("__o") > F.col("__stop"))
    return rows.groupBy("courier_id").agg(
        F.coalesce((F.unix_micros(F.max(F.when(tail, F.col("ts")))) - F.unix_micros(F.min(F.when(tail, F.col("ts"))))) / 1e6,
                   F.lit(0.0)).alias("stationary_s"),
        F.count_if(tail).alias("samples"))


def stationary_issues(track: DataFrame, speed_kmh: float, min_seconds: float = 120.0) -> DataFrame:
    """Couriers stationary for long enough whose GPS is frozen or whose last point is degraded."""
    last = top_per_key(track, ["courier_id"], [F.desc("ts"), F.desc("event_id")], 1).select(
        "courier_id", F.col("status").alias("last_status"), F.col("speed_kmh").alias("last_speed_kmh"),
        F.col("ts").alias("last_ts"), _degraded().alias("degraded"))
    frozen = frozen_streaks(track).select("courier_id", F.lit(True).alias("frozen"))
    joined = trailing_stationary(track, speed_kmh).join(last, "courier_id").join(frozen, "courier_id", "left")
    return joined.withColumn("frozen", F.coalesce("frozen", F.lit(False))).where(
        (F.col("stationary_s") >= min_seconds) & (F.col("frozen") | F.col("degraded")))


def idle_suspects(track: DataFrame, speed_kmh: float = 1.5, min_seconds: float = 120.0) -> DataFrame:
    """Delivering couriers that do not move, longest first."""
    return stationary_issues(track, speed_kmh, min_seconds).where(F.col("last_status") == "delivering").select(
        "courier_id", round_half_up("last_speed_kmh", 1).alias("speed_kmh"),
        round_half_up("stationary_s", 0).cast("long").alias("stationary_s"),
        round_half_up(F.col("stationary_s") / 60.0, 1).alias("stationary_min"), "samples",
        F.when(F.col("frozen"), "gps_frozen").otherwise("routing_hold").alias("reason"),
    ).orderBy(F.desc("stationary_s"), "courier_id")


def detect_anomalies(track: DataFrame, ref: Column, minutes: float = 10, speed_limit: float = SPEED_ALERT_KMH,
                     still_kmh: float = 2.0, min_exceed: int = 3, z_limit: float = 3.0, trusted_kmh: float = 90.0,
                     min_still_s: float = 120.0) -> DataFrame:
    """Couriers with speeding, suspicious standstill or unusual speed against their own recent past.

    Speeds count only from trusted points: moving status, route not on hold, no anomaly, plausible speed.
    """
    split = minutes_before(ref, minutes)
    both = in_window(track, ref, 2 * minutes)
    now = both.where(F.col("ts") >= split)
    trusted = F.col("status").isin(MOVING_STATUSES) & ~_degraded() & F.col("speed_kmh").between(0.0, trusted_kmh)
    recent = trusted & (F.col("ts") >= split)
    before = trusted & (F.col("ts") < split)
    pick = lambda condition: F.when(condition, F.col("speed_kmh"))
    stats = both.groupBy("courier_id").agg(
        F.count_if(F.col("ts") >= split).alias("points"), F.max(F.when(F.col("ts") >= split, F.col("ts"))).alias("last_ts"),
        F.coalesce(F.max(pick(recent)), F.lit(0.0)).alias("speed_max"),
        F.coalesce(F.avg(pick(recent)), F.lit(0.0)).alias("speed_mean"),
        F.count_if(recent & (F.col("speed_kmh") > speed_limit)).alias("exceed"),
        F.count_if(recent).alias("n_recent"), F.count_if(before).alias("n_before"),
        F.avg(pick(before)).alias("mean_before"), F.stddev_pop(pick(before)).alias("std_before"),
    ).where(F.col("points") > 0)
    still = stationary_issues(now, still_kmh, min_still_s).select("courier_id", "stationary_s", "samples", "frozen")
    joined = stats.join(still, "courier_id", "left").withColumns({
        "stationary_s": F.coalesce("stationary_s", F.lit(0.0)),
        "z": F.when((F.col("n_before") >= 4) & (F.col("n_recent") >= 2) & (F.col("std_before") >= 2.0),
                    F.abs(F.col("speed_mean") - F.col("mean_before")) / F.col("std_before")).otherwise(F.lit(0.0))})
    speeding, halted, odd = F.col("exceed") >= min_exceed, F.col("stationary_s") >= min_still_s, F.col("z") > z_limit
    kinds = F.array_compact(F.array(F.when(speeding, "speeding"), F.when(halted, "suspicious_standstill"),
                                    F.when(odd, "behaviour_deviation")))
    critical = halted | (speeding & (F.col("speed_max") > max(speed_limit + 10.0, 80.0)))
    return joined.withColumn("kinds", kinds).where(F.size("kinds") > 0).select(
        "courier_id", F.when(critical, "critical").otherwise("warning").alias("level"), "kinds",
        round_half_up("speed_max", 1).alias("speed_max_kmh"), round_half_up("speed_mean", 1).alias("speed_mean_kmh"),
        round_half_up("z", 2).alias("z_score"), round_half_up("stationary_s", 0).cast("long").alias("stationary_s"),
        F.coalesce("frozen", F.lit(False)).alias("frozen"), "last_ts")


def merge_trails(parts: list[DataFrame], n: int = 60) -> DataFrame:
    """One trail per courier from several sources in the given order (history, live track, latest point).

    Points older than an earlier one are dropped; neighbours with the same place or time become one,
    the later one. Every part must already be bounded per courier.
    """
    columns = ["courier_id", "event_id", "ts", "lat", "lon", "speed_kmh", "status"]
    stacked = None
    for rank, part in enumerate(parts):
        rows = part.select(*columns).withColumn("__part", F.lit(rank))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    w = Window.partitionBy("courier_id").orderBy("__part", "ts", "event_id")
    newest = F.max("ts").over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = stacked.withColumn("__newest", newest).where(F.col("__newest").isNull() | (F.col("ts") >= F.col("__newest")))
    following = lambda c: F.lead(c).over(w)
    same = ((F.abs(following("lat") - F.col("lat")) < 1e-6) & (F.abs(following("lon") - F.col("lon")) < 1e-6)) | (
        following("ts") == F.col("ts"))
    ends = kept.withColumn("__same", F.coalesce(same, F.lit(False))).where(~F.col("__same")).drop("__same", "__newest")
    return top_per_key(ends, ["courier_id"], [F.desc("ts"), F.desc("__part"), F.desc("event_id")], n).drop("__part")


def focus_positions(latest: DataFrame, ref: Column, stale_after_s: float = 30.0) -> DataFrame:
    """Latest position of every courier with its age and whether it is stale."""
    age = F.greatest((F.unix_micros(ref) - F.unix_micros("ts")) / 1e6, F.lit(0.0))
    return latest.withColumn("age_s", age).withColumn("stale", F.coalesce(F.col("age_s") > stale_after_s, F.lit(True)))


def stale_or_live(history: DataFrame, live: DataFrame, key: str = "courier_id") -> DataFrame:
    """Per courier the historical answer where there is one, else the live one marked degraded."""
    columns = [c for c in history.columns if c != key]
    h = history.select(key, F.struct(*columns).alias("__h"))
    l = live.select(key, F.struct(*[F.col(c).cast(history.schema[c].dataType).alias(c) for c in columns]).alias("__l"))
    both = h.join(l, key, "full")
    pick = F.coalesce("__h", "__l")
    return both.select(key, *[pick[c].alias(c) for c in columns],
                       F.when(F.col("__h").isNotNull(), "history").otherwise("live").alias("source"),
                       F.col("__h").isNull().alias("degraded"))


def reference_time(explicit: Column | None, clock: Column | None, lake: DataFrame, track: DataFrame) -> DataFrame:
    """One row: the explicit time, else the replay clock, else the newest lake time, else the newest track time."""
    given = [c for c in (explicit, clock) if c is not None]
    if explicit is not None:  # nothing to look for
        return lake.sparkSession.range(1).select(explicit.alias("ref_ts"))
    newest = lake.agg(F.max("ts").alias("a")).withColumn("__one", F.lit(1)).join(
        track.agg(F.max("ts").alias("b")).withColumn("__one", F.lit(1)), "__one")
    return newest.select(F.coalesce(*given, "a", "b").alias("ref_ts"))


def resample_track(track: DataFrame, max_step_km: float) -> DataFrame:
    """Extra points on every leg so that no step is longer than `max_step_km`, with the distance so far."""
    from courierworks.functions.geo import haversine_km

    w = Window.partitionBy("courier_id").orderBy(*ORDER)
    nxt = lambda c: F.lead(c).over(w)
    legs = track.select(
        "courier_id", *ORDER, "lat", "lon", nxt("lat").alias("lat2"), nxt("lon").alias("lon2"),
        F.unix_micros("ts").alias("us"), nxt(F.unix_micros("ts")).alias("us2"))
    leg_km = F.coalesce(haversine_km("lat", "lon", "lat2", "lon2"), F.lit(0.0))
    legs = legs.withColumn("leg_km", leg_km).withColumn(
        "before_km", F.coalesce(F.sum("leg_km").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ).withColumn("parts", F.greatest(F.ceil(F.col("leg_km") / F.lit(max_step_km)), F.lit(1)).cast("int"))
    share = F.when(F.col("lat2").isNull(), F.lit(0.0)).otherwise(F.col("i") / F.col("parts"))
    mix = lambda a, b: F.when(F.col("lat2").isNull(), F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * F.col("share"))
    return legs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("share", share).select(
        "courier_id", "event_id", "i", mix("lat", "lat2").alias("lat"), mix("lon", "lon2").alias("lon"),
        (F.col("before_km") + F.col("leg_km") * F.col("share")).alias("km"),
        mix("us", "us2").cast("long").alias("ts_us"))
