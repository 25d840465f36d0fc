"""Hand-checkable cases."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from courierworks.functions import context as fx
from courierworks.functions import scoring, status
from courierworks.functions.geo import haversine_km
from courierworks.operators import guardrails, kpi, offers
from courierworks.plans import dispatch, mart, training
from courierworks.sources import conform, ingest, lake


def ts(text):
    return F.lit(text).cast("timestamp")


def positions(spark, rows):
    df = spark.createDataFrame(rows, "courier_id string, event_id long, t string, lat double, lon double, speed_kmh double, status string, source_platform string")
    return df.withColumn("ts", F.col("t").cast("timestamp")).withColumns({"heading_deg": F.lit(0.0), "accuracy_m": F.lit(8.0), "battery_pct": F.lit(50.0)})


def test_guardrail_rules(spark):
    rows = [("a", 1, "2024-01-01 10:00:00", 40.758, -73.9855, 10.0, "delivering", "x|route=osrm"),
            ("a", 2, "2024-01-01 10:00:10", 40.9, -73.7, 10.0, "delivering", "x|route=osrm"),
            ("a", 3, "2024-01-01 10:00:20", 40.7581, -73.9855, 10.0, "delivering", "x|route=hold"),
            ("b", 4, "2024-01-01 10:00:00", 40.0, -73.0, 9.0, "delivering", ""),
            *[("b", 5 + i, f"2024-01-01 10:00:{10 + i}", 40.0, -73.0, 9.0, "delivering", "") for i in range(5)]]
    checked = guardrails.checked_positions(positions(spark, rows))
    verdict = {r["event_id"]: r["reason"] for r in checked.collect()}
    assert verdict[1] is None and verdict[2] == "jump_too_large" and verdict[3] is None
    assert [verdict[4 + i] for i in range(6)] == [None, None, None, None, "gps_frozen", "gps_frozen"]
    state = {r["courier_id"]: r for r in guardrails.live_state(checked).collect()}
    assert state["a"]["route_source"] == "hold" and state["a"]["stale_reason"] == "routing_hold" and state["a"]["anomaly_state"] == "ok"
    assert state["b"]["anomaly_state"] == "anomalous" and state["b"]["stale_reason"] == "gps_frozen"


def test_guardrail_time_does_not_go_back():
    step = guardrails.guard_step(guardrails.Limits())
    _, state = step(None, (60e6, 40.0, -73.0, 5.0, 1))
    result, kept = step(state, (0.0, 40.0, -73.0, 5.0, 1))
    assert result[0] == "non_monotonic_ts" and kept[:3] == state[:3]
    step = guardrails.guard_step(guardrails.Limits(ttl_s=30))
    assert step(state, (200e6, 45.0, -73.0, 5.0, 1))[0][0] is None  # the state had expired


def test_backtrack():
    step, state = guardrails.guard_step(guardrails.Limits()), None
    results = []
    for us, lat in [(0, 40.0), (40e6, 40.009), (80e6, 40.0)]:
        result, state = step(state, (float(us), lat, -73.0, 5.0, 1))
        results.append(result[0])
    assert results == [None, None, "implausible_backtrack"]


def test_latest_decision_counts(spark):
    events = spark.createDataFrame([("e1", "o1", "accepted", "2024-01-01 10:00:00"), ("e2", "o1", " Rejected ", "2024-01-01 10:05:00"),
                                    ("e3", "o2", "accepted", "2024-01-01 10:00:00")], "event_id string, offer_id string, status string, t string")
    row = kpi.accept_rate(mart.fact_order_events(events.withColumn("ts", F.col("t").cast("timestamp")))).first()
    assert (row["decided_offers"], row["accepted_offers"], row["rejected_offers"], row["accept_rate_pct"]) == (2, 1, 1, 50.0)


def test_contract_and_platform(spark):
    signals = spark.createDataFrame([("z", "2024-01-01 10:00:00", "", "tag;a=1")], "zone_id string, ts string, source_platform string, source string")
    assert mart.fact_context_signals(signals).first()["source_platform"] == "tag;a=1"
    assert mart.fact_context_signals(signals.drop("source", "source_platform")).first()["source_platform"] == "unknown"
    with pytest.raises(conform.ContractError):
        mart.fact_offers(signals)
    assert mart.fact_missions(None, spark=spark).first()["mission_id"] == "no_data"


def test_training_window_and_labels(spark):
    t = lambda c: F.col(c).cast("timestamp")
    offers_df = spark.createDataFrame([("off_1", "c1", "zone_a", "2024-01-10 10:00:00", 18.0, 4.0, 20.0), ("off_2", "c1", "zone_a", "2024-01-10 10:05:00", 9.0, 4.0, 20.0)],
        "offer_id string, courier_id string, zone_id string, t string, estimated_fare_eur double, estimated_distance_km double, estimated_duration_min double").withColumns(
        {"ts": t("t"), "demand_index": F.lit(1.1), "weather_factor": F.lit(1.0), "traffic_factor": F.lit(1.0)})
    events = spark.createDataFrame([("off_1", "accepted", None, "2024-01-10 10:00:30"), ("off_1", "dropped_off", 19.0, "2024-01-10 10:20:00"),
        ("off_2", "rejected", None, "2024-01-10 10:05:30")], "offer_id string, status string, actual_fare_eur double, t string").withColumn("ts", t("t"))
    signals = spark.createDataFrame([("s1", "zone_a", 0.9, "2024-01-10 09:58:00"), ("s2", "zone_a", 0.8, "2024-01-10 10:03:00")],
        "event_id string, zone_id string, supply_index double, t string").withColumn("ts", t("t"))
    frame = {r["offer_id"]: r for r in training.training_frame(offers_df, events, signals).collect()}
    assert frame["off_1"]["supply_index"] == 0.9 and frame["off_2"]["supply_index"] == 0.8
    assert frame["off_1"]["context_fallback_applied"] == frame["off_2"]["context_fallback_applied"] == 0.0
    assert frame["off_1"]["label_source"] == "observed_realized" and frame["off_2"]["label_source"] == "observed_rejected" and frame["off_2"]["label"] == 0
    window = training.train_window("2024-03", 1)
    assert window == (datetime(2024, 3, 1, tzinfo=timezone.utc), datetime(2024, 4, 1, tzinfo=timezone.utc))
    assert training.in_window(offers_df, window).count() == 0
    assert training.train_window("2023-11", 3)[1] == datetime(2024, 2, 1, tzinfo=timezone.utc)
    with pytest.raises(ValueError):
        training.train_window("2024", 1)


def test_model_learns(spark):
    rows = spark.range(400).select(
        F.concat(F.lit("o"), F.col("id")).alias("offer_id"), F.timestamp_seconds(F.col("id") * 60 + 1704067200).alias("ts"),
        *[(F.rand(i) if c != "estimated_net_eur_h" else F.rand(99) * 30.0).alias(c) for i, c in enumerate(training.FEATURES)], F.lit("observed_realized").alias("label_source"))
    rows = rows.withColumn("label", (F.col("estimated_net_eur_h") > 15).cast("int"))
    from courierworks.session import stage

    model, metrics = training.train_model(stage(rows), grid=[0.75])
    assert metrics["roc_auc"] > 0.95 and 0.0 <= metrics["ece_10_bins"] <= 1.0 and metrics["rows"] == 80
    assert training.feature_importance(model, spark).first()["feature"] == "estimated_net_eur_h"
    gate = training.quality_gate(spark.createDataFrame([(500, 0.9, 0.8), (10, 0.9, 0.8), (500, 0.5, 0.8)], "rows long, roc_auc double, average_precision double"))
    assert [r["accepted"] for r in gate.collect()] == [True, False, False]
    scored = training.score_with_model(rows.select("offer_id", *training.FEATURES), model)
    assert {r["model_used"] for r in scored.select("model_used").distinct().collect()} == {"ml"}


def test_ranking_ties_and_floor(spark):
    rows = spark.createDataFrame([("s", o, e, 5.0, 0.7, 0.7, 18.0) for o, e in [("b", 20.0), ("a", 20.0), ("c", 8.0)]],
        "set_id string, offer_id string, eur_per_hour_net double, estimated_net_eur double, accept_score double, objective_score double, target_hourly_net_eur double")
    ranked = {r["offer_id"]: r for r in offers.rank_offers(rows).collect()}
    assert [ranked[o]["rank"] for o in "abc"] == [1, 2, 3]
    assert ranked["c"]["recommendation"] == "reject" and ranked["a"]["recommendation"] == "viable"  # no edge over the second
    alone = offers.rank_offers(rows.where("offer_id = 'a'")).first()
    assert alone["recommendation"] == "top_pick"


def test_zone_without_coordinates_is_kept(spark):
    zones = spark.createDataFrame([("nyc_1", 40.7, -74.0, 1.0), ("somewhere", None, None, 2.0)], "zone_id string, lat double, lon double, opportunity_score double").withColumns(
        {c: F.lit(1.0) for c in ["demand_index", "supply_index", "weather_factor", "traffic_factor"]})
    drivers = spark.createDataFrame([("d", 40.7, -74.0, 30.0), ("lost", None, None, 30.0)], "courier_id string, lat double, lon double, vehicle_mpg double")
    got = {(r["courier_id"], r["zone_id"]): r for r in dispatch.next_best_zone(drivers, zones, 5, distance_weight=0.3).collect()}
    assert got["d", "somewhere"]["distance_km"] is None and got["d", "somewhere"]["rank"] == 1
    assert got["d", "nyc_1"]["distance_km"] == 0.0 and len(got) == 4


def test_holidays(spark):
    days = ["2021-12-31 17:00:00", "2024-07-04 17:00:00", "2024-07-05 17:00:00", "2024-11-28 17:00:00", "2023-11-10 17:00:00",
            "2035-12-25 17:00:00", "2017-05-29 17:00:00", "2040-01-16 17:00:00", "2040-12-26 17:00:00", "2017-11-11 17:00:00", "1999-12-31 17:00:00"]
    rows = spark.createDataFrame([(d,) for d in days], "t string").withColumn("h", fx.is_holiday(F.col("t").cast("timestamp")))
    assert [r["h"] for r in rows.collect()] == [True, True, False, True, True, True, True, True, False, False, True]


def test_time_weight_and_severity(spark):
    s = lambda x: F.lit(float(x))
    row = spark.range(1).select(
        fx.event_time_weight(s(100), s(0), s(200), 6, 60).alias("active"), fx.event_time_weight(s(0), s(3 * 3600), s(4 * 3600), 6, 60).alias("ahead"),
        fx.event_time_weight(s(5400), s(0), s(3600), 6, 60).alias("after"), fx.event_time_weight(s(9000), s(0), s(3600), 6, 60).alias("over"),
        fx.speed_severity(F.lit(40.0)).alias("fast"), fx.speed_severity(F.lit(10.0)).alias("slow")).first()
    assert (row["active"], row["ahead"], row["after"], row["over"]) == (1.0, 0.625, 0.175, 0.0)
    assert row["fast"] == 0.0 and abs(row["slow"] - (28 / 38 + 0.2)) < 1e-12


def test_metadata_round_trip(spark):
    rows = spark.createDataFrame([(" gbfs ; A = 1 ;b=x=y; =3;c;a=2",), ("",), (None,)], "s string")
    got = rows.select(status.metadata_tag("s").alias("tag"), status.metadata_map("s").alias("m")).collect()
    assert got[0]["tag"] == "gbfs" and got[0]["m"] == {"a": "2", "b": "x=y"} and got[1]["m"] == {} and got[2]["m"] == {}


def test_validation_reasons(spark):
    raw = spark.createDataFrame([('{"courier_id":"a","lat":91,"lon":0,"ts":"2024-01-01T00:00:00Z"}',), ('{"livreur_id":"a","lat":"1.5","lon":2,"timestamp":"2024-01-01T00:00:00"}',),
                                 ("{",), ('{"lat":1,"lon":2,"status":"flying"}',)], "value string")
    good, bad = ingest.validate_positions(ingest.parse_positions(raw))
    assert [(r["courier_id"], r["lat"]) for r in good.collect()] == [("a", 1.5)]
    assert sorted(",".join(r["reasons"]) for r in bad.collect()) == ["courier_id_length,status_unknown_word,ts_empty", "lat_range", "malformed_json"]


def test_lake_prunes_hours(spark, tmp_path):
    rows = spark.range(48).select(F.lit("c").alias("courier_id"), *[F.lit(1.0).alias(c) for c in ["lat", "lon", "speed_kmh", "heading_deg", "accuracy_m", "battery_pct"]],
        F.lit("idle").alias("status"), F.timestamp_seconds(F.col("id") * 3600 + 1704067200).alias("ts"))
    lake.write_position_lake(rows, str(tmp_path / "lake"))
    read = lake.read_position_lake(spark, str(tmp_path / "lake"), datetime(2024, 1, 1, 5), datetime(2024, 1, 1, 7))
    assert read.count() == 3 and len(read.inputFiles()) == 48
    plan = read._sc._jvm.PythonSQLUtils.explainString(read._jdf.queryExecution(), "formatted")
    assert "PartitionFilters" in plan and "1000000" in plan.split("PartitionFilters")[1].split("\n")[0]
    assert lake.latest_event_time(spark, str(tmp_path / "lake")) == datetime(2024, 1, 2, 23)
    (tmp_path / "lake" / "year=2024" / "bad.parquet").write_bytes(b"no parquet")
    scan = lake.quarantine_scan(spark, str(tmp_path / "lake"))
    assert scan.where("problem IS NOT NULL").count() == 1


def test_compaction_of_five_files(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(5):
        spark.range(100).withColumn("topic", F.lit("t")).coalesce(1).write.mode("append").partitionBy("topic").parquet(source)
    row = lake.compact_partitions(spark, source, str(tmp_path / "out"), ["topic"]).first()
    assert (row["files_before"], row["files_after"], row["files_reduced_pct"], row["row_count_ok"]) == (5, 1, 80.0, True)


def test_scores_stay_in_bounds(spark):
    wild = spark.createDataFrame([(float("nan"), -5.0, None), (1e9, 0.0, 1e9), (3.0, 1.0, 0.0)], "estimated_fare_eur double, estimated_distance_km double, estimated_duration_min double")
    scored = offers.score_offers(wild.withColumn("offer_id", F.lit("x")), details=True)
    for row in scored.collect():
        assert 0.01 <= row["accept_score"] <= 0.99 and 0.35 <= row["decision_threshold"] <= 0.9 and 0 <= row["objective_score"] <= 1
        assert row["reasons"] and len(row["details"]) == 16
    assert abs(sum(scoring.normalised({"net_hourly": -1.0}, scoring.SCORE_WEIGHTS).values()) - 1.0) < 1e-12


def test_distance_of_missing_points_is_null(spark):
    row = spark.range(1).select(haversine_km(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("km")).first()
    assert row["km"] is None
