"""Streams give the rows of their batch twins."""

import tempfile
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from courierworks.operators import context, guardrails
from courierworks.sources import ingest, lake
from courierworks.streaming import pipelines, state


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def ordered_files(df, root, parts=2):
    """Several files in time order, so that every micro-batch is later than the one before."""
    rows = df.withColumn("part", F.ntile(parts).over(Window.orderBy("ts", "event_id")))
    for i in range(1, parts + 1):
        rows.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(root)
    return root


def run(stream, folder, mode="append", name="out"):
    query = (stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-ckpt")
             .outputMode(mode).trigger(availableNow=True).start())
    query.awaitTermination(300)
    return stream.sparkSession.read.parquet(f"{folder}/{name}")


def test_guardrails_stream_equals_batch(spark, views, folder):
    root = ordered_files(views.positions, f"{folder}/in")
    stream = pipelines.file_stream(spark, root, views.positions.schema, 1)
    got = run(state.guardrail_stream(stream), folder).select("courier_id", "event_id", "reason", "frozen_count")
    want = guardrails.gps_guardrails(views.positions).select("courier_id", "event_id", "reason", "frozen_count")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_zone_trend_stream_equals_batch(spark, views, folder):
    root = ordered_files(views.context_signals, f"{folder}/in")
    stream = pipelines.file_stream(spark, root, views.context_signals.schema, 1)
    got = run(state.zone_trend_stream(stream), folder).drop("ts")
    want = context.zone_trend_ema(views.context_signals)
    assert got.select(want.columns).exceptAll(want).count() == 0
    assert got.count() == want.count()


def test_lake_and_dead_letters(spark, views, folder):
    body = F.to_json(F.struct(F.col("courier_id").alias("livreur_id"), "lat", "lon", "speed_kmh", "status",
                              F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp")))
    raw = views.positions.select(F.when(F.col("event_id") % 50 == 0, F.lit("{bad")).otherwise(body).alias("value"))
    raw.coalesce(2).write.parquet(f"{folder}/raw")
    stream = pipelines.file_stream(spark, f"{folder}/raw", "value string", 1)
    good, bad = pipelines.position_streams(stream)
    pipelines.lake_sink(good, f"{folder}/lake", f"{folder}/c1").trigger(availableNow=True).start().awaitTermination(300)
    letters = pipelines.dlq_stream(bad, "livreurs-gps", F.lit("2024-01-01 01:00:00").cast("timestamp"))
    pipelines.dlq_sink(letters, f"{folder}/dlq", f"{folder}/c2").trigger(availableNow=True).start().awaitTermination(300)
    broken = views.positions.where("event_id % 50 = 0").count()
    assert lake.read_position_lake(spark, f"{folder}/lake").count() == views.positions.count() - broken
    stats = ingest.dlq_stats(spark.read.schema("topic string, reason string, raw_hex string, ts_rejected timestamp, day string").json(f"{folder}/dlq"))
    assert [row["rejects"] for row in stats.collect()] == [broken]


def test_live_positions_and_rate_limit(spark, views, folder):
    root = ordered_files(views.positions, f"{folder}/in", 2)
    stream = pipelines.file_stream(spark, root, views.positions.schema, 1)
    live = state.live_position_stream(stream, 3_600_000)
    query = live.writeStream.format("memory").queryName("live").outputMode("update").start()
    want = views.positions.groupBy("courier_id").agg(F.max("ts").alias("ts")).collect()
    # The timeouts keep the query busy with batches without data, so it is stopped once the rows are there.
    for _ in range(120):
        newest = spark.table("live").where("live").groupBy("courier_id").agg(F.max("ts").alias("ts")).collect()
        if set(newest) == set(want):
            break
        time.sleep(0.5)
    query.stop()
    assert set(newest) == set(want)

    limited = pipelines.minute_rate_limit(stream.withColumnRenamed("courier_id", "token"), "token", 1)
    query = limited.writeStream.format("memory").queryName("limited").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = spark.table("limited").groupBy("token", "minute").agg(F.max("rows").alias("n"))
    want = views.positions.groupBy("courier_id", F.date_trunc("minute", "ts").alias("minute")).count().where("count > 1")
    assert got.count() == want.count()


def test_counters(spark, views, folder):
    listener = pipelines.Counters()
    spark.streams.addListener(listener)
    root = ordered_files(views.positions, f"{folder}/in", 2)
    stream = pipelines.file_stream(spark, root, views.positions.schema, 1)
    run(pipelines.with_counters(state.guardrail_stream(stream), "gps"), folder)
    for _ in range(50):
        if listener.totals.get("gps.rows") == views.positions.count():
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert listener.totals["gps.rows"] == views.positions.count()
    assert 0 < listener.totals["gps.rejects"] < listener.totals["gps.rows"]


def test_offer_features(spark, views, folder):
    views.positions.write.parquet(f"{folder}/positions")
    signals = context.parse_signal(views.context_signals)
    signals.write.parquet(f"{folder}/signals")
    views.offers.coalesce(1).write.parquet(f"{folder}/offers")
    stream = pipelines.file_stream(spark, f"{folder}/offers", views.offers.schema, 1)
    pipelines.offer_feature_sink(stream, f"{folder}/positions", f"{folder}/signals", f"{folder}/out", f"{folder}/c", views.positions.schema, signals.schema).trigger(
        availableNow=True).start().awaitTermination(300)
    out = spark.read.parquet(f"{folder}/out")
    assert out.count() == views.offers.count()
    assert out.where("accept_score_heuristic IS NULL").count() == 0
    assert pipelines.latest_offers_per_driver(out, 2).groupBy("courier_id").count().where("count > 2").count() == 0
