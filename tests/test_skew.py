"""The paths for very large keys give the rows of the plain ones."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from courierworks.catalog import offer_reports
from courierworks.operators import context, fleet, guardrails, keyed, offers, spatial


def same(a, b):
    assert a.count() == b.count()
    assert a.exceptAll(b.select(a.columns)).count() == 0


def one_hot(positions):
    """A third of all rows on one courier."""
    return positions.withColumn("courier_id", F.when(F.col("event_id") % 3 == 0, "drv_hot").otherwise(F.col("courier_id")))


def _verdicts(rows, **fold):
    got = guardrails.gps_guardrails(rows, **fold)
    return got.select("courier_id", "event_id", "reason", "frozen_count", *[F.round(c, 6).alias(c) for c in ("delta_s", "distance_km", "implied_speed_kmh")])


def _row_by_row(rows, **fold):
    from courierworks.operators.fold import ordered_fold

    got = ordered_fold(guardrails.with_inputs(rows), "courier_id", "ts", "event_id", guardrails.INPUTS, ["event_id"], guardrails.guard_step(guardrails.Limits()), guardrails.VERDICT, **fold)
    return got.select("courier_id", "event_id", "reason", "frozen_count", *[F.round(c, 6).alias(c) for c in ("delta_s", "distance_km", "implied_speed_kmh")])


def test_guardrails_as_arrays_and_row_by_row(views):
    rows = one_hot(views.positions)
    rows = rows.unionByName(rows.where("event_id % 40 = 0").withColumns({"ts": F.lit(None).cast("timestamp"), "event_id": F.col("event_id") + 10_000_000}))
    plain = _row_by_row(rows).cache()
    same(plain, _row_by_row(rows, hot_rows=3, segment_seconds=120, widen=4))
    same(plain, _verdicts(rows))
    same(plain, _verdicts(rows, segment_seconds=300))
    same(plain, _verdicts(rows, segment_seconds=600, max_segment=5))


def test_clean_tracks_need_no_python(spark):
    rows = spark.range(4000).select(
        (F.col("id") % 4).cast("string").alias("courier_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 5).alias("ts"),
        (40.7 + F.floor(F.col("id") / 4) * 0.0004).alias("lat"), F.lit(-74.0).alias("lon"), F.lit(9.0).alias("speed_kmh"), F.lit("delivering").alias("status"))
    got = guardrails.gps_guardrails(rows, segment_seconds=900)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "InArrow" not in plan and got.where("reason IS NULL").count() == 4000


def test_checked_positions_of_small_and_large_tables(spark, views):
    """Large tables are judged row by row, with the verdicts of the expressions for missing values, NaN and repeated rows."""
    holes = {c: F.when(F.col("event_id") % n == 0, F.lit(None)).otherwise(F.col(c)) for c, n in (("lat", 11), ("lon", 13), ("speed_kmh", 7), ("status", 17), ("ts", 19), ("courier_id", 23))}
    rows = one_hot(views.positions).withColumns(holes).withColumn("lat", F.when(F.col("event_id") % 29 == 0, F.lit(float("nan"))).otherwise(F.col("lat")))
    rows = rows.unionByName(rows.where("event_id % 5 = 0")).unionByName(rows.where("event_id % 15 = 0"))
    for limits in (guardrails.Limits(), guardrails.Limits(ttl_s=20.0, frozen_m=800.0, frozen_streak=2)):
        numbers = ("delta_s", "distance_km", "implied_speed_kmh")
        some, every = (guardrails.checked_positions(rows, limits, max_rows=n) for n in (10**9, 0))
        some, every = (df.select(*(F.round(c, 6).alias(c) if c in numbers else c for c in df.columns)).cache() for df in (some, every))
        same(some, every)
        assert every.select("reason").distinct().count() > 3
        same(every, guardrails.checked_positions(rows, limits, max_rows=0, hot_rows=3, segment_seconds=600, widen=3).select(*(F.round(c, 6).alias(c) if c in numbers else c for c in every.columns)))


def test_live_state_folds_once(spark):
    """Both the newest accepted and the newest rejected point come from one pass: the fold is dear, and a plan that names it twice runs it twice."""
    rows = spark.range(2000).select(
        (F.col("id") % 3).cast("string").alias("courier_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 5).alias("ts"),
        (40.7 + F.when(F.col("id") % 7 == 3, 1.0).otherwise(0.0)).alias("lat"), F.lit(-74.0).alias("lon"), F.lit(9.0).alias("speed_kmh"), F.lit("idle").alias("status"),
        *[F.lit(1.0).alias(c) for c in ("heading_deg", "accuracy_m", "battery_pct")], F.lit("x|route=osrm").alias("source_platform"))
    state = guardrails.live_state(guardrails.checked_positions(rows, segment_seconds=100_000))
    plan = state._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1
    got = {r["courier_id"]: (r["event_id"], r["anomaly_state"], r["stale_reason"]) for r in state.collect()}
    assert got == {str(k): (max(i for i in range(k, 2000, 3) if i % 7 != 3), *(("anomalous", "jump_too_large") if max(range(k, 2000, 3)) % 7 == 3 else ("ok", ""))) for k in range(3)}


def test_zone_trend_as_arrays_and_row_by_row(views):
    from courierworks.operators.fold import ordered_fold
    from courierworks.functions.num import round_half_up

    rows = views.context_signals.withColumns({"__demand": round_half_up("demand_index", 3), "__us": F.unix_micros("ts").cast("double")})
    plain = ordered_fold(rows, "zone_id", "ts", "event_id", ["__demand", "__us"], ["event_id"], context.zone_trend_step, context.ZONE_TREND)
    same(plain, context.zone_trend_ema(views.context_signals))
    same(plain, context.zone_trend_ema(views.context_signals, segment_seconds=300))
    same(plain, context.zone_trend_ema(views.context_signals, max_segment=2, hot_rows=5, widen=3))


def test_previous_row_across_buckets(views):
    rows = one_hot(views.positions).select("courier_id", "event_id", "ts", "lat", "lon")
    got = keyed.with_previous(rows, "courier_id", "ts", "event_id", ["lat", "lon"], bucket_seconds=60)
    w = Window.partitionBy("courier_id").orderBy("ts", "event_id")
    want = rows.withColumns({"prev_lat": F.lag("lat").over(w), "prev_lon": F.lag("lon").over(w)})
    same(got, want)


def test_asof_of_hot_keys_equals_the_plain_window(views):
    right = views.context_signals.select("zone_id", F.col("ts").alias("at"), "event_id", "supply_index")
    third = lambda df, key: df.withColumn("zone_id", F.when(F.pmod(F.xxhash64(key), F.lit(3)) == 0, "hot").otherwise(F.col("zone_id")))
    right = third(right, "event_id").unionByName(third(right, "event_id").where("zone_id = 'hot'").withColumn("event_id", F.concat("event_id", F.lit("x"))))
    right = right.unionByName(right.limit(3).withColumn("at", F.lit(None).cast("timestamp"))).unionByName(right.limit(3).withColumn("zone_id", F.lit(None).cast("string")))
    left = third(views.offers.select("offer_id", "zone_id", "ts"), "offer_id")
    left = left.unionByName(left.limit(4).withColumn("ts", F.lit(None).cast("timestamp"))).unionByName(left.limit(4).withColumn("zone_id", F.lit(None).cast("string")))
    run = lambda n: keyed.asof_left(left, right, "zone_id", "ts", "at", "event_id", ["event_id", "supply_index"], hot_rows=n)
    plain = run(10**9)
    matched = left.alias("l").join(right.alias("r"), (F.col("l.zone_id") == F.col("r.zone_id")) & (F.col("r.at") <= F.col("l.ts")), "left")
    newest = F.max_by("event_id", F.struct("at", "event_id"))
    want = matched.groupBy("offer_id", "l.zone_id", "ts").agg(newest.alias("event_id"))
    same(plain.select("offer_id", "zone_id", "ts", "event_id"), want.select("offer_id", "zone_id", "ts", "event_id"))
    same(plain, run(5))


def test_asof_reads_each_side_once(views):
    right = views.context_signals.select("zone_id", F.col("ts").alias("at"), "event_id", "supply_index")
    df = keyed.asof_left(views.offers.select("offer_id", "zone_id", "ts"), right, "zone_id", "ts", "at", "event_id", ["event_id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(zone_id") == 1


def test_salted_joins(views):
    latest = fleet.latest_positions(views.positions).select("courier_id", "lat", "lon")
    small = spatial.radius_join(views.zones.select("zone_id", "lat", "lon"), latest, 3.0)
    salted = spatial.radius_join(views.zones.select("zone_id", "lat", "lon"), latest, 3.0, max_centres=0)
    same(small.select("zone_id", "courier_id"), salted.select("zone_id", "courier_id"))
    right = views.zones.select("zone_id", "zone_name")
    for how in ("inner", "left", "left_anti", "left_semi"):
        joined = keyed.join_checked(views.offers.select("offer_id", "zone_id"), right.limit(10), ["zone_id"], how, max_rows=0)
        same(joined, views.offers.select("offer_id", "zone_id").join(right.limit(10), "zone_id", how).select(joined.columns))


def test_order_statistics(views):
    values = np.sort(np.array([row[0] for row in views.positions.select("speed_kmh").collect()]))
    got = keyed.order_statistics(views.positions, [], "speed_kmh", {"low": lambda n: F.floor(n * 0.1), "mid": lambda n: F.floor(n / 2), "top": lambda n: n - 1}).first()
    n = len(values)
    assert (got["low"], got["mid"], got["top"], got["n"]) == (values[int(n * 0.1)], values[n // 2], values[-1], n)
    q = keyed.exact_quantile(views.positions, [], "speed_kmh", 0.37, "q").first()["q"]
    assert abs(q - np.quantile(values, 0.37)) < 1e-9


def test_ranking_of_large_sets(views):
    scored = offer_reports.scored(views)
    columns = ["offer_id", "rank", "recommendation", "delta_vs_top_eur_h", "delta_vs_median_eur_h"]
    same(offers.rank_offers(scored, "courier_id").select("courier_id", *columns),
         offers.rank_offers(scored, "courier_id", hot_rows=5).select("courier_id", *columns))


def test_ranking_with_missing_scores_missing_sets_and_ties(spark):
    rows = [("a", "o1", 10.0), ("a", "o2", None), ("a", "o3", 14.5), ("a", "o4", 10.0), (None, "o5", 3.0), (None, "o6", None), ("b", "o7", None), ("c", "o8", 20.0)]
    scored = spark.createDataFrame([(s, o, x, x, x, x, 18.0) for s, o, x in rows],
                                   "set_id string, offer_id string, eur_per_hour_net double, estimated_net_eur double, accept_score double, objective_score double, target_hourly_net_eur double")
    columns = ["set_id", "offer_id", "rank", "set_size", "recommendation", "best_eur_h", "worst_eur_h", "second_eur_h", "median_eur_h", "delta_vs_median_eur_h"]
    plain = {r["offer_id"]: tuple(r) for r in offers.rank_offers(scored).select(*columns).collect()}
    for metric in ("eur_per_hour_net", "objective_score"):
        one, other = (offers.rank_offers(scored, by=metric, hot_rows=n).select(*columns) for n in (1_000_000, 0))
        same(one, other)
    assert plain["o2"][2:4] == (4, 4) and plain["o3"][2] == 1 and plain["o1"][8] == 10.0 and plain["o5"][3] == 2 and plain["o7"][3] == 1


def test_order_statistics_with_missing_values(spark):
    df = spark.createDataFrame([("a", x) for x in (None, None, 5.0, 1.0, 1.0, 3.0)] + [("b", None)], "k string, v double")
    ranks = {"mid": lambda n: F.floor(n / 2)}
    assert {r["k"]: (r["n"], r["mid"]) for r in keyed.order_statistics(df, ["k"], "v", ranks).collect()} == {"a": (4, 3.0)}
    assert {r["k"]: (r["n"], r["mid"]) for r in keyed.order_statistics(df, ["k"], "v", ranks, nulls_first=True).collect()} == {"a": (6, 1.0), "b": (1, None)}


def test_repeated_messages_keep_their_rows(views):
    three = views.positions.unionByName(views.positions).unionByName(views.positions)
    assert guardrails.checked_positions(three).count() == three.count()


def test_rolling_span_over_short_and_missing_days(spark):
    times = [0, 10, 20, 86_400, 3 * 86_400, 3 * 86_400 + 5, 3 * 86_400 + 6, 9 * 86_400] + [9 * 86_400 + k for k in range(1, 15)]
    values = [float((7 * i) % 11) for i in range(len(times))]
    df = spark.createDataFrame(list(zip(times, values)), "s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["s"]: (r["span"], r["cycles"]) for r in context.rolling_span(df, "v", "ts", 5).collect()}
    window = lambda i: values[max(0, i - 4):i + 1]
    assert got == {t: (max(window(i)) - min(window(i)), len(window(i))) for i, t in enumerate(times)}


def test_homeward_moves_meet_few_zones(spark):
    from courierworks.plans import dispatch

    zones = spark.createDataFrame([(f"z{i:02d}", 40.0 + i, -74.0, 1.0, 1.0, 1.0, 1.0, 1.0 if i % 2 else 0.2) for i in range(20)],
                                  "zone_id string, lat double, lon double, demand_index double, supply_index double, weather_factor double, traffic_factor double, opportunity_score double")
    drivers = spark.createDataFrame([("d", 40.0, -74.0, 31.0, 58.0, -74.0)], "courier_id string, lat double, lon double, vehicle_mpg double, home_lat double, home_lon double")
    got = dispatch.next_best_zone(drivers, zones, 3, distance_weight=0.3, with_home=True).orderBy("rank").collect()
    assert [r["zone_id"] for r in got] == ["z17", "z19", "z15"] and got[0]["adjusted_opportunity_score"] > got[2]["adjusted_opportunity_score"]


def test_nearest_zone_far_away(spark):
    zones = spark.createDataFrame([("a", 40.6, -74.0), ("b", 40.7, -73.9), ("c", -33.9, 151.2)], "zone_id string, lat double, lon double")
    points = spark.createDataFrame([(1, 40.61, -74.0), (2, 10.0, 10.0), (3, -40.0, 179.9), (4, 40.66, -73.94), (5, 89.0, 0.0)], "id int, lat double, lon double")
    got = {r["id"]: r["zone_id"] for r in spatial.nearest_zone(points, zones, "id").collect()}
    from courierworks.functions.geo import haversine_km

    pairs = points.crossJoin(zones.withColumnsRenamed({"lat": "y", "lon": "x"})).withColumn("km", haversine_km("lat", "lon", "y", "x"))
    want = {r["id"]: r["zone_id"] for r in pairs.groupBy("id").agg(F.min_by("zone_id", "km").alias("zone_id")).collect()}
    assert got == want


def test_radius_join_over_the_date_line(spark):
    centres = spark.createDataFrame([("p", 0.0, 179.99), ("q", 70.0, -179.95)], "k string, lat double, lon double")
    points = spark.createDataFrame([(i, y, x) for i, (y, x) in enumerate([(0.0, -179.99), (0.0, 179.95), (70.01, 179.99), (0.5, 179.99)])], "id int, lat double, lon double")
    got = sorted((r["k"], r["id"]) for r in spatial.radius_join(centres, points, 10.0).collect())
    assert got == [("p", 0), ("p", 1), ("q", 2)]


def test_nearest_zone_against_all_pairs(spark):
    import math
    import random

    rng = random.Random(4)
    somewhere = lambda: (math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180))
    near = lambda: (40.7 + rng.gauss(0, 0.1), -74 + rng.gauss(0, 0.1))
    places = [near() for _ in range(120)] + [somewhere() for _ in range(40)] + [(90.0, 0.0), (-90.0, 0.0), (0.0, 180.0), (0.0, -180.0)]
    zones = [(f"z{i:03d}", y, x) for i, (y, x) in enumerate(places)] + [("z000b", *places[0]), ("a_same", *places[5]), ("lost", None, 1.0)]
    points = [near() for _ in range(300)] + [somewhere() for _ in range(300)] + places[:20] + [(90.0, 10.0), (-90.0, 7.0), (12.0, 180.0), (12.0, -180.0)]
    rows = [(i, y, x) for i, (y, x) in enumerate(points)] + [(-1, None, None), (-2, 3.0, None)]
    table = spark.createDataFrame(zones, "zone_id string, lat double, lon double")
    asked = spark.createDataFrame(rows, "id int, lat double, lon double")

    def km(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 12742 * math.asin(math.sqrt(min(1, h)))

    best = {i: min((km((y, x), (b, c)), z) for z, b, c in zones if b is not None) for i, y, x in rows if y is not None and x is not None}
    for limits in ({}, {"max_pairs": 1, "max_candidates": 0}):
        got = {r["id"]: (r["zone_km"], r["zone_id"]) for r in spatial.nearest_zone(asked, table, "id", **limits).collect()}
        assert len(got) == len(rows) and got[-1] == got[-2] == (None, None)
        for i, (want, zone) in best.items():
            assert abs(got[i][0] - want) < 1e-6 and (got[i][1] == zone or abs(km(rows[i][1:], next(z[1:] for z in zones if z[0] == got[i][1])) - want) < 1e-9)
        assert got[600][1] in ("z000", "z000b") and got[605][1] == "a_same"
    assert {r["zone_id"] for r in spatial.nearest_zone(asked, table.limit(0), "id").collect()} == {None}


def test_zone_index_holds_few_candidates_and_points_stay_where_they_are(views):
    latest = fleet.latest_positions(views.positions)
    index = spatial.zone_index(latest, views.zones)
    from courierworks.catalog import dispatch_reports
    from courierworks.session import stage

    latest = stage(latest)
    zones = views.zones.count()
    assert index.agg(F.max(F.size("candidates"))).first()[0] < max(8, zones // 3)
    plan = spatial.nearest_zone(latest, views.zones, "courier_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Window" not in plan
    overview = dispatch_reports.fleet_overview(views)._jdf.queryExecution().optimizedPlan().toString()
    assert overview.count("Relation [") <= 6 and overview.count("Join ") <= 4


def test_trip_candidates_compare_only_couriers_idle_then(spark):
    import random

    from courierworks.sources import trips

    rng = random.Random(8)
    hour = 3_600_000_000
    idle = []
    for i in range(300):
        free = rng.randrange(48 * hour)
        idle.append((f"c{i:03d}", free, rng.choice([None, free + rng.randrange(1, 6) * hour // 2, free + rng.randrange(20) * hour, free - 5]), 40.7 + rng.gauss(0, 0.05), -74.0 + rng.gauss(0, 0.05)))
    asked = [(f"t{i:03d}", f"c{rng.randrange(300):03d}", req := rng.randrange(48 * hour), req + rng.randrange(hour // 2), 40.7 + rng.gauss(0, 0.05), -74.0 + rng.gauss(0, 0.05)) for i in range(80)]
    times = lambda df, *names: df.withColumns({n: F.timestamp_micros(n) for n in names})
    people = times(spark.createDataFrame(idle, "courier_id string, available_at long, busy_at long, lat double, lon double"), "available_at", "busy_at")
    rides = times(spark.createDataFrame(asked, "trip_key string, courier_id string, request_datetime long, pickup_datetime long, pickup_lat double, pickup_lon double"), "request_datetime", "pickup_datetime")

    def km(a, b, c, d):
        import math

        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 12742 * math.asin(math.sqrt(h))

    for longest in (None, 90.0):
        want, overlapping = {}, 0
        for key, preferred, req, pick, y, x in asked:
            costs = []
            for courier, free, busy, cy, cx in idle:
                gone = min((1 << 60) if busy is None else busy - 1, (1 << 60) if longest is None else free + int(longest * 6e7))
                d = km(y, x, cy, cx)
                if gone < free or free > pick + 120_000_000 or gone < req or d > 11:
                    continue
                overlapping += 1
                eta, start = d / 22 * 60, max(free, req)
                if eta <= 30 and start + eta * 6e7 <= pick + 120_000_000:
                    costs.append((d + (start - req) / 6e7 * 1.7 + eta * 0.35 + max(0, (start + eta * 6e7 - pick) / 6e7) * 4 - (0.35 if preferred == courier else 0) + 0.15, courier))
            for rank, (cost, courier) in enumerate(sorted(costs)[:3], 1):
                want[key, rank] = (courier, round(cost, 6))
        got = {(r["trip_key"], r["rank"]): (r["courier_id"], round(r["cost"], 6)) for r in trips.trip_candidates(rides, people, max_idle_min=longest).collect()}
        assert got == want and len(want) > 50
        late = F.lit(120_000_000)
        points = rides.select("trip_key", F.unix_micros("request_datetime").alias("req"), (F.unix_micros("pickup_datetime") + late).alias("pick"), F.col("pickup_lat").alias("lat"), F.col("pickup_lon").alias("lon"))
        ends = [F.coalesce(F.unix_micros("busy_at") - 1, F.lit(1 << 60))] + ([F.unix_micros("available_at") + int(longest * 6e7)] if longest else [])
        waiting = people.select("courier_id", F.unix_micros("available_at").alias("free"), (F.least(*ends) if longest else ends[0]).alias("gone"), "lat", "lon")
        assert trips.idle_pairs(points, waiting, 11.0).count() == overlapping


def _crowd(spark, trips_n=250, couriers=900):
    """Trips and idle couriers of one hour in one city, some on one spot; some trips twice, without a courier of their own or far from everybody."""
    import random

    rng, hour = random.Random(21), 3_600_000_000
    people, rides = [], []
    for i in range(couriers):
        free = rng.randrange(hour)
        spot = (40.72, -73.99) if i % 9 == 0 else (40.7 + rng.gauss(0, 0.03), -74.0 + rng.gauss(0, 0.03))
        people.append((f"c{i % (couriers - 40):03d}", free, rng.choice([None, free + rng.randrange(hour)]), *spot))
    people.append((None, 0, None, 40.7, -74.0))
    for i in range(trips_n):
        at = (40.72, -73.99) if i % 10 == 0 else (41.5, -73.0) if i % 25 == 1 else (40.7 + rng.gauss(0, 0.04), -74.0 + rng.gauss(0, 0.04))
        req = rng.randrange(2 * hour)
        rides.append((f"t{i:03d}", rng.choice([None, f"c{rng.randrange(couriers):03d}"]), req, req + rng.randrange(20 * 60_000_000), *at))
    rides += rides[:20] + [("t000", "c001", *r[2:]) for r in rides[30:60]]
    times = lambda df, *names: df.withColumns({n: F.timestamp_micros(n) for n in names})
    idle = times(spark.createDataFrame(people, "courier_id string, available_at long, busy_at long, lat double, lon double"), "available_at", "busy_at")
    asked = times(spark.createDataFrame(rides, "trip_key string, courier_id string, request_datetime long, pickup_datetime long, pickup_lat double, pickup_lon double"), "request_datetime", "pickup_datetime")
    return asked, idle


def test_trip_candidates_in_rings_are_those_of_all_pairs(spark, monkeypatch):
    """Where couriers stand close, a trip is compared with those near it; the rows are those of comparing all."""
    from courierworks.sources import trips

    asked, idle = _crowd(spark)
    met, real = [], trips.idle_pairs

    def counted(*args):
        pairs = real(*args)
        met.append(pairs.count())
        return pairs

    for options in ({"max_idle_min": 90.0}, {"k": 1, "speed_kmh": 12.0}, {"k": 5, "max_idle_min": 20.0, "grace_min": 0.0}):
        monkeypatch.setattr(trips, "MOST_PAIRS", 10**12, raising=False)
        every = trips.trip_candidates(asked, idle, **options).cache()
        assert every.count() > 100
        monkeypatch.setattr(trips, "MOST_PAIRS", 0, raising=False)
        monkeypatch.setattr(trips, "PAIRS_A_TRIP", 0, raising=False)
        rounded = lambda df: df.select("trip_key", "courier_id", "rank", *[F.round(c, 6).alias(c) for c in ("distance_km", "eta_min", "wait_min", "late_min", "cost")])
        same(rounded(every), rounded(trips.trip_candidates(asked, idle, **options)))
    monkeypatch.setattr(trips, "idle_pairs", counted)
    trips.trip_candidates(asked, idle, max_idle_min=90.0).count()
    late = F.lit(120_000_000)
    points = asked.select(F.unix_micros("request_datetime").alias("req"), (F.unix_micros("pickup_datetime") + late).alias("pick"), F.col("pickup_lat").alias("lat"), F.col("pickup_lon").alias("lon"))
    waiting = idle.select("courier_id", F.unix_micros("available_at").alias("free"), F.least(F.coalesce(F.unix_micros("busy_at") - 1, F.lit(1 << 60)), F.unix_micros("available_at") + 5_400_000_000).alias("gone"), "lat", "lon")
    assert sum(met) < real(points, waiting, 11.0).count() / 2


def test_trip_candidates_compute_a_distance_once(spark):
    """A filter that names the distance must not bring its formula along: conditions on all pairs compared were ten times as dear."""
    from courierworks.sources import trips

    plan = trips.trip_candidates(*_crowd(spark, 20, 50), max_idle_min=90.0)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("ASIN(") <= 2
