"""Ride records as offers, order events and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierworks.functions.cost import MILES_TO_KM
from courierworks.functions.geo import bearing_deg, haversine_km, project_point
from courierworks.functions.num import at_least, clamp, round_half_up
from courierworks.operators.keyed import join_checked, top_per_key
from courierworks.operators.spatial import pairs_compared, radius_join
from courierworks.session import stage

COLUMNS = ["hvfhs_license_num", "dispatching_base_num", "request_datetime", "pickup_datetime", "dropoff_datetime", "PULocationID",
           "DOLocationID", "trip_miles", "trip_time", "base_passenger_fare", "tolls", "bcf", "sales_tax", "congestion_surcharge",
           "airport_fee", "tips", "driver_pay"]
FARE_PARTS = ["base_passenger_fare", "tolls", "bcf", "sales_tax", "congestion_surcharge", "airport_fee"]
PLATFORM = "tlc_hvfhv_historical|route=linear"
CENTRE = (40.7580, -73.9855)  # where a trip starts when neither of its zones is known


def hex_number(text: Column, seed_length: int = 8) -> Column:
    """The first hex digits of the SHA-1 of a text as a number."""
    return F.conv(F.substring(F.sha1(text), 1, seed_length), 16, 10).cast("long")


def prepare_trips(raw: DataFrame, license_number: str = "HV0003", extra: list[str] | None = None) -> DataFrame:
    """Complete trips of one licence, 17 columns. Sort by request time only when writing."""
    return raw.where(F.col("hvfhs_license_num") == license_number).dropna(
        subset=["request_datetime", "pickup_datetime", "dropoff_datetime", "PULocationID", "DOLocationID"]).select(*COLUMNS, *(extra or []))


def write_trips(trips: DataFrame, root: str) -> None:
    """Globally sorted by request time, which Spark does with a range partitioning, and Zstandard-compressed."""
    trips.orderBy("request_datetime").write.mode("overwrite").option("compression", "zstd").parquet(root)


def _epoch(name: str) -> Column:
    return F.unix_seconds(name).cast("string")


def assign_courier_id(mode: str = "trip", pool: int = 250) -> Column:
    """Courier id of a trip row: one per trip, per base, zone and day ('legacy_zone_day'), or a pool slot ('fleet_pool')."""
    base = F.coalesce(F.nullif(F.trim("dispatching_base_num"), F.lit("")), F.lit("B00000"))
    zones = [F.col("PULocationID").cast("string"), F.col("DOLocationID").cast("string")]
    if mode == "legacy_zone_day":
        seed = F.concat_ws("|", F.lit("legacy"), base, zones[0], F.date_format("request_datetime", "yyyy-MM-dd"))
    elif mode == "fleet_pool":
        seed = F.concat_ws("|", F.lit("fleet"), base, *zones, F.date_format("request_datetime", "yyyy-MM-dd'T'HH"))
        width = max(3, len(str(pool)))
        return F.format_string(f"drv_demo_%0{width}d", F.pmod(hex_number(seed), F.lit(pool)) + 1)
    else:
        seed = F.concat_ws("|", F.lit("trip"), base, *zones, _epoch("request_datetime"), _epoch("pickup_datetime"), _epoch("dropoff_datetime"))
    return F.concat(F.lit("tlc_drv_"), F.substring(F.sha1(seed), 1, 12))


def usable_trips(trips: DataFrame, mode: str = "trip", pool: int = 250) -> DataFrame:
    """Trips with positive length, duration and zones, and their derived columns."""
    km, minutes = round_half_up(F.col("trip_miles") * MILES_TO_KM, 3), round_half_up(F.col("trip_time") / 60.0, 2)
    fare = at_least(sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FARE_PARTS), F.lit(0.0)), 0.0)
    rows = trips.withColumns({"trip_km": km, "trip_min": minutes, "fare": round_half_up(fare, 2)}).where(
        (F.col("dropoff_datetime") > F.col("pickup_datetime")) & (F.col("PULocationID") > 0) & (F.col("DOLocationID") > 0)
        & (F.col("trip_km") > 0) & (F.col("trip_min") > 0))
    key = F.concat_ws("_", _epoch("request_datetime"), F.col("PULocationID").cast("string"), F.col("DOLocationID").cast("string"),
                      F.col("trip_time").cast("long").cast("string"))
    return rows.withColumns({
        "trip_key": key, "courier_id": assign_courier_id(mode, pool), "offer_id": F.concat(F.lit("tlc_offer_"), key),
        "order_id": F.concat(F.lit("tlc_"), key),
        "avg_speed_kmh": clamp(F.col("trip_km") / at_least(F.col("trip_min") / 60.0, 0.01), 5.0, 90.0)})


def sample_trips(trips: DataFrame, rate: float) -> DataFrame:
    """A share of the trips chosen by the hash of their key: the same ones on every run."""
    if rate >= 1.0:
        return trips
    return trips.where(F.pmod(hex_number(F.col("trip_key")), F.lit(10000)) / 10000.0 < rate)


def impute_zone_points(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """Pickup and drop-off points from the zone centroids (location_id, lat, lon).

    An unknown zone is placed by distance and a bearing that follows from the trip, seen from the known
    end, or from the city centre when both are unknown.
    """
    at = lambda end: zones.select(F.col("location_id").alias(f"{end}LocationID"), F.col("lat").alias(f"{end}_lat"), F.col("lon").alias(f"{end}_lon"))
    rows = join_checked(join_checked(trips, at("PU"), ["PULocationID"], "left"), at("DO"), ["DOLocationID"], "left")
    seed = F.concat_ws("|", F.coalesce("dispatching_base_num", F.lit("")), F.col("PULocationID").cast("string"), F.col("DOLocationID").cast("string"),
                       _epoch("request_datetime"), _epoch("pickup_datetime"), _epoch("dropoff_datetime"))
    rows = rows.withColumns({"__b": F.pmod(hex_number(seed), F.lit(360)).cast("double"), "__km": clamp(F.col("trip_km"), 0.8, 8.0)})
    no_pu, no_do = F.col("PU_lat").isNull(), F.col("DO_lat").isNull()
    free = project_point(F.lit(CENTRE[0]), F.lit(CENTRE[1]), "__b", 1.2)
    back = project_point("DO_lat", "DO_lon", F.pmod(F.col("__b") + 180.0, F.lit(360.0)), clamp(F.col("__km") * 0.8, 0.6, 5.0))
    pickup = [F.when(no_pu & no_do, a).when(no_pu, b).otherwise(F.col(f"PU_{n}")) for a, b, n in zip(free, back, ("lat", "lon"))]
    rows = rows.withColumns({"pickup_lat": pickup[0], "pickup_lon": pickup[1]})
    turn = F.when(no_pu, F.pmod(F.col("__b") + 120.0, F.lit(360.0))).otherwise(F.col("__b"))
    on = project_point("pickup_lat", "pickup_lon", turn, "__km")
    rows = rows.withColumns({"dropoff_lat": F.when(no_do, on[0]).otherwise(F.col("DO_lat")), "dropoff_lon": F.when(no_do, on[1]).otherwise(F.col("DO_lon"))})
    return rows.withColumn("bearing", bearing_deg("pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon")).drop(
        "__b", "__km", "PU_lat", "PU_lon", "DO_lat", "DO_lon")


def _id(prefix: str, seed: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(seed), 1, 20))


def trip_offers(trips: DataFrame) -> DataFrame:
    one = F.lit(1.0)
    return trips.select(
        _id("offer", F.col("trip_key")).alias("event_id"), F.lit("order.offer.v1").alias("event_type"), F.col("request_datetime").alias("ts"),
        "offer_id", "courier_id", "pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon", F.col("fare").alias("estimated_fare_eur"),
        F.col("trip_km").alias("estimated_distance_km"), F.col("trip_min").alias("estimated_duration_min"), one.alias("demand_index"),
        one.alias("weather_factor"), one.alias("traffic_factor"), F.concat(F.lit("nyc_"), F.col("PULocationID").cast("string")).alias("zone_id"),
        F.lit(PLATFORM).alias("source_platform"))


def trip_order_events(trips: DataFrame) -> DataFrame:
    """An accepted event at the request and a dropped_off event with the actual figures, from one pass."""
    steps = F.array(F.struct(F.lit("accepted").alias("status"), F.col("request_datetime").alias("ts"), F.lit(0.0).alias("share")),
                    F.struct(F.lit("dropped_off").alias("status"), F.col("dropoff_datetime").alias("ts"), F.lit(1.0).alias("share")))
    rows = trips.withColumn("__s", F.explode(steps)).select("*", "__s.status", "__s.ts", "__s.share")
    return rows.select(
        F.concat(F.lit("evt_"), F.col("status"), F.lit("_"), F.substring(F.sha1("trip_key"), 1, 20)).alias("event_id"),
        F.lit("order.event.v1").alias("event_type"), "ts", "offer_id", "order_id", "courier_id", "status",
        (F.col("fare") * F.col("share")).alias("actual_fare_eur"), (F.col("trip_km") * F.col("share")).alias("actual_distance_km"),
        (F.col("trip_min") * F.col("share")).alias("actual_duration_min"),
        F.concat(F.lit("nyc_"), F.col("PULocationID").cast("string")).alias("zone_id"), F.lit(PLATFORM).alias("source_platform"))


def trip_positions(trips: DataFrame) -> DataFrame:
    """The courier at the pickup (delivering, moving) and at the drop-off (available, standing)."""
    ends = F.array(
        F.struct(F.lit("delivering").alias("status"), F.col("pickup_datetime").alias("ts"), F.col("pickup_lat").alias("lat"), F.col("pickup_lon").alias("lon"),
                 F.lit(1.0).alias("moving")),
        F.struct(F.lit("available").alias("status"), F.col("dropoff_datetime").alias("ts"), F.col("dropoff_lat").alias("lat"), F.col("dropoff_lon").alias("lon"),
                 F.lit(0.0).alias("moving")))
    rows = trips.withColumn("__e", F.explode(ends)).select("trip_key", "courier_id", "avg_speed_kmh", "bearing", "__e.*")
    seed = F.concat_ws("_", "trip_key", _epoch("ts"))
    return rows.select(
        F.concat(F.lit("pos_"), F.col("status"), F.lit("_"), F.substring(F.sha1(seed), 1, 20)).alias("event_id"), F.lit("courier.position.v1").alias("event_type"),
        "ts", "courier_id", round_half_up("lat", 6).alias("lat"), round_half_up("lon", 6).alias("lon"),
        round_half_up(F.col("avg_speed_kmh") * F.col("moving"), 1).alias("speed_kmh"), round_half_up(F.col("bearing") * F.col("moving"), 1).alias("heading_deg"),
        "status", F.lit(8.0).alias("accuracy_m"), F.lit(100.0).alias("battery_pct"), F.lit(PLATFORM).alias("source_platform"))


SLOT_MIN = 15  # width of the finest time slot of the interval join
SLOT_LEVELS = 6  # each level's slots are four times as wide as those of the one before
FOREVER_US = 1 << 60


def _slot_width(level: Column) -> Column:
    return F.lit(SLOT_MIN * 60_000_000) * F.pow(F.lit(4.0), F.greatest(level, F.lit(0))).cast("long")


def _interval_slots(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with (__level, __slot): an interval lies in at most two slots of the first level that is wide enough for it.

    What is longer than the widest slots, such as an interval without end, is alone on its own level -1.
    """
    length = F.col(end) - F.col(start)
    level = F.lit(-1)
    for k in range(SLOT_LEVELS - 1, -1, -1):
        level = F.when(length <= _slot_width(F.lit(k)), F.lit(k)).otherwise(level)
    placed = rows.withColumn("__level", level)
    first, last = F.floor(F.col(start) / _slot_width(F.col("__level"))), F.floor(F.col(end) / _slot_width(F.col("__level")))
    return placed.withColumn("__slot", F.explode(F.when(F.col("__level") < 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(first, last))))


def _probe_slots(rows: DataFrame, start: str, end: str, levels: list[int]) -> DataFrame:
    """Rows once for every slot of the given levels that their interval touches."""
    placed = rows.withColumn("__level", F.explode(F.array(*map(F.lit, levels)))) if levels else rows.withColumn("__level", F.lit(-2))
    first, last = F.floor(F.col(start) / _slot_width(F.col("__level"))), F.floor(F.col(end) / _slot_width(F.col("__level")))
    return placed.withColumn("__slot", F.explode(F.when(F.col("__level") < 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(first, last))))


def _levels(filed: DataFrame) -> list[int]:
    return sorted(r[0] for r in filed.select("__level").distinct().collect())  # SLOT_LEVELS + 1 at most


def _idle_then(met: DataFrame) -> DataFrame:
    """Pairs that met in a slot, of those idle in the trip's window; a pair that meets in two slots counts once, in the first."""
    width = _slot_width(F.col("__level"))
    first = F.greatest(F.floor(F.col("free") / width), F.floor(F.col("req") / width))
    return met.where((F.col("free") <= F.col("pick")) & (F.col("gone") >= F.col("req")) & ((F.col("__level") < 0) | (F.col("__slot") == first))).drop("__level", "__slot")


def _filed(idle: DataFrame) -> DataFrame:
    return _interval_slots(idle.where("gone >= free AND lat IS NOT NULL AND lon IS NOT NULL"), "free", "gone")


def idle_pairs(trips: DataFrame, idle: DataFrame, radius_km: float, levels: list[int] | None = None) -> DataFrame:
    """Trips with the couriers that are idle at some time of the trip's window and stand within the radius.

    `trips` has req, pick (microseconds), lat, lon; `idle` has free, gone (microseconds), lat, lon. The join key is the grid cell and a
    time slot. An idle interval is filed in one or two slots of the level that fits its length, and a trip looks in the slots its short
    window touches on the levels that occur (`levels`, if known), so couriers that are idle at other times are never compared.
    """
    filed = _filed(idle)
    asked = _probe_slots(trips, "req", "pick", _levels(filed) if levels is None else levels)
    return _idle_then(radius_join(filed, asked, radius_km, on=["__level", "__slot"]))


def trip_candidates(trips: DataFrame, idle: DataFrame, k: int = 3, max_eta_min: float = 30.0, speed_kmh: float = 22.0, grace_min: float = 2.0,
                    max_idle_min: float | None = None) -> DataFrame:
    """The `k` cheapest idle couriers per trip that reach the pickup in time.

    `trips` has trip_key, courier_id (the preferred one), request_datetime, pickup_datetime, pickup_lat, pickup_lon; `idle` has courier_id,
    available_at, lat, lon, and may have busy_at, from which on the courier is no longer idle (NULL: idle without end). A courier counts
    for a trip if it is idle at some time between the request and the pickup plus the grace, and with `max_idle_min` if it has not been waiting for longer
    when the request comes. Who could not arrive within `max_eta_min` is never paired.
    """
    late = F.lit(int(grace_min * 6e7))
    points = trips.select("trip_key", F.col("courier_id").alias("preferred"), F.unix_micros("request_datetime").alias("req"), F.unix_micros("pickup_datetime").alias("pickup"),
                          (F.unix_micros("pickup_datetime") + late).alias("pick"), F.col("pickup_lat").alias("lat"), F.col("pickup_lon").alias("lon")).where("req <= pick")
    free = F.unix_micros("available_at")
    ends = [F.coalesce(F.unix_micros("busy_at") - 1, F.lit(FOREVER_US))] if "busy_at" in idle.columns else []
    ends += [free + F.lit(int(max_idle_min * 6e7))] if max_idle_min is not None else []
    gone = F.least(*ends) if len(ends) > 1 else ends[0] if ends else F.lit(FOREVER_US)
    people = stage(idle.select("courier_id", free.alias("free"), gone.alias("gone"), "lat", "lon"))
    span = people.where("gone >= free").agg(F.min("free"), F.max("gone")).first()
    points = points.where((F.col("pick") >= F.lit(span[0]).cast("long")) & (F.col("req") <= F.lit(span[1]).cast("long")))  # the others meet nobody
    radius = speed_kmh * max_eta_min / 60.0
    # who starts at the request at the earliest and arrives by `pick` is not farther away than this
    reach = F.least(F.lit(radius), (F.col("pick") - F.col("req")) / 3.6e9 * speed_kmh * (1 + 1e-9) + 1e-9)
    points = stage(points.withColumns({"__reach": reach, "__trip": F.monotonically_increasing_id()}))

    def scored(pairs: DataFrame) -> DataFrame:
        # a generator, so that filters on the distance do not compute it anew, each for itself, for all pairs compared
        pairs = pairs.withColumn("distance_km", F.explode(F.array("distance_km")))
        eta = F.col("distance_km") / speed_kmh * 60.0
        start = F.greatest("free", "req")
        arrive = start + eta * 6e7
        rows = pairs.withColumns({"eta_min": eta, "wait_min": (start - F.col("req")) / 6e7, "late_min": at_least((arrive - F.col("pickup")) / 6e7, 0.0)}).where(
            (F.col("eta_min") <= max_eta_min) & (arrive <= F.col("pick")))
        cost = (F.col("distance_km") + F.col("wait_min") * 1.7 + F.col("eta_min") * 0.35 + F.col("late_min") * 4.0
                - F.when(F.col("preferred") == F.col("courier_id"), 0.35).otherwise(0.0) + 0.15)
        return rows.select("__trip", "trip_key", "courier_id", "distance_km", "eta_min", "wait_min", "late_min", cost.alias("cost"))

    order = [F.asc("cost"), F.asc("courier_id")]
    best = _cheapest(points, people, scored, order, k, radius, per_km=1.0 + 60.0 / speed_kmh * 0.35, fixed=0.15)
    return top_per_key(best.drop("__trip"), ["trip_key"], order, k, rank="rank")


MOST_PAIRS = 20_000_000  # pairs that are simply compared
PAIRS_A_TRIP = 64  # compared in the first ring, on average
FIRST_KM = 0.1  # least radius of a ring


def _cheapest(points: DataFrame, people: DataFrame, scored, order: list[Column], k: int, radius: float, per_km: float, fixed: float) -> DataFrame:
    """Scored pairs, among them the `k` cheapest of every trip.

    `points` and `people` are written tables. Where all pairs would be too many, trips look in rings: a trip is settled when its `k` cheapest couriers within a ring
    cost less than any courier outside can, who costs at least `fixed` and `per_km` of the ring's radius, or when nobody outside can reach
    it in time; the others go on to the next ring, twice as wide. The preferred courier, who may cost less, is looked up by name.
    """
    filed = _filed(people)
    levels = _levels(filed)
    asked = lambda trips: _probe_slots(trips, "req", "pick", levels)
    count = points.agg(F.count("*"), F.max("__reach")).first()
    top = min(radius, count[1] or 0.0)
    compared = lambda km: pairs_compared(filed, asked(points), km, ["__level", "__slot"])
    if not count[0] or compared(top) <= MOST_PAIRS:
        return scored(idle_pairs(points, people, top, levels))
    rings = [top]
    while rings[0] / 2 >= FIRST_KM and (len(rings) == 1 or compared(rings[0]) > MOST_PAIRS + PAIRS_A_TRIP * count[0]):
        rings.insert(0, rings[0] / 2)
    named = F.coalesce(F.col("preferred") == F.col("courier_id"), F.lit(False))
    known = filed.withColumnsRenamed({"lat": "centre_lat", "lon": "centre_lon"}).withColumn("preferred", F.col("courier_id"))
    met = asked(points.where("preferred IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")).join(known, ["preferred", "__level", "__slot"])
    met = _idle_then(met.withColumn("distance_km", haversine_km("centre_lat", "centre_lon", "lat", "lon")).where(F.col("distance_km") <= F.lit(radius)))
    found = scored(met)
    for km in rings:
        near = top_per_key(scored(idle_pairs(points, people, km, levels).where(~named)), ["__trip"], order, k)
        if km == top:
            return found.unionByName(near)
        near = stage(near)
        sure = near.groupBy("__trip").agg(F.count("*").alias("n"), F.max("cost").alias("most")).where(
            (F.col("n") == k) & (F.col("most") < km * per_km + fixed - 1e-6)).select("__trip")
        points = stage(points.where(F.col("__reach") > km).join(sure, "__trip", "left_anti"))
        found = found.unionByName(near.join(points.select("__trip"), "__trip", "left_anti"))
