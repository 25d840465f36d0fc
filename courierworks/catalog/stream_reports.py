"""Reports that run a streaming query over files of a test table until nothing is left, and return what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierworks.catalog.context_reports import ENRICH_SQL, STATE_SQL
from courierworks.catalog.registry import r, report
from courierworks.catalog.source_reports import raw_messages
from courierworks.catalog.track_reports import GUARD_SQL
from courierworks.functions.num import round_half_up
from courierworks.operators import context
from courierworks.operators.keyed import latest_by
from courierworks.session import new_folder
from courierworks.sources import ingest, lake
from courierworks.sources.adapters import BASE_US, Views, ref_ts
from courierworks.streaming import pipelines, state

PARTS = 3  # files of the source; each is one micro-batch, later than the one before


def arriving(v: Views, rows: DataFrame, name: str) -> DataFrame:
    """A stream of the rows in the order of their times, a third of the hour per file."""
    root = new_folder(v.spark, name)
    third = F.least(F.greatest(F.floor((F.unix_micros("ts") - BASE_US) / (3_600_000_000 // PARTS)), F.lit(0)), F.lit(PARTS - 1))
    for part in range(PARTS):
        rows.where(third == part).coalesce(1).write.mode("append").parquet(root)
    return pipelines.file_stream(v.spark, root, rows.schema, 1)


def finished(writer) -> None:
    """Run a streaming query over all that is there and wait for its end."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def written(v: Views, stream: DataFrame, name: str) -> DataFrame:
    root, checkpoint = new_folder(v.spark, name), new_folder(v.spark, f"{name}-checkpoint")
    finished(stream.writeStream.format("parquet").option("path", root).option("checkpointLocation", checkpoint).outputMode("append"))
    return v.spark.read.schema(stream.schema).parquet(root)


def raw_stream(v: Views) -> DataFrame:
    root = new_folder(v.spark, "raw")
    raw_messages(v).select("value").repartition(PARTS).write.parquet(root)
    return pipelines.file_stream(v.spark, root, "value string", 1)


@report("stream_position_lake", f"""SELECT courier_id, count(*) AS points, {r('max(speed_kmh)', 4)} AS top_speed, min(epoch_us(ts)) AS first_us FROM positions
WHERE event_id % 50 <> 0 AND event_id % 70 <> 0 GROUP BY 1""")
def stream_position_lake(v: Views):
    good, _ = pipelines.position_streams(raw_stream(v))
    root = new_folder(v.spark, "lake")
    finished(pipelines.lake_sink(good, root, new_folder(v.spark, "lake-checkpoint")))
    return lake.read_position_lake(v.spark, root).groupBy("courier_id").agg(
        F.count("*").alias("points"), round_half_up(F.max("speed_kmh"), 4).alias("top_speed"), F.unix_micros(F.min("ts")).alias("first_us"))


@report("stream_dead_letters", """SELECT '2024-01-01' AS day, 'livreurs-gps' AS topic, CASE WHEN event_id % 50 = 0 THEN 'malformed_json' ELSE 'lat_range' END AS reason, count(*) AS rejects
FROM positions WHERE event_id % 50 = 0 OR event_id % 70 = 0 GROUP BY 3""")
def stream_dead_letters(v: Views):
    _, bad = pipelines.position_streams(raw_stream(v))
    root = new_folder(v.spark, "letters")
    finished(pipelines.dlq_sink(pipelines.dlq_stream(bad, "livreurs-gps", ref_ts()), root, new_folder(v.spark, "letters-checkpoint")))
    return ingest.dlq_stats(v.spark.read.schema("topic string, reason string, raw_hex string, ts_rejected timestamp, day string").json(root))


@report("stream_rate_limit", """SELECT courier_id AS token, epoch_us(date_trunc('minute', ts)) AS minute_us, count(*) AS rows FROM positions GROUP BY 1, 2 HAVING count(*) > 1""")
def stream_rate_limit(v: Views):
    limited = pipelines.minute_rate_limit(arriving(v, v.positions.select(F.col("courier_id").alias("token"), "ts"), "tokens"), "token", 1)
    root = new_folder(v.spark, "limited")
    finished(limited.writeStream.outputMode("complete").option("checkpointLocation", new_folder(v.spark, "limited-checkpoint"))
             .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(root)))
    return v.spark.read.parquet(root).select("token", F.unix_micros("minute").alias("minute_us"), "rows")


@report("stream_guardrails", f"WITH RECURSIVE {GUARD_SQL} SELECT courier_id, event_id, reason, fz AS frozen_count, true AS counted FROM g")
def stream_guardrails(v: Views):
    """Verdicts of a stream, with the counters of its micro-batches compared to what it wrote."""
    import time

    counters = pipelines.Counters()
    v.spark.streams.addListener(counters)
    out = written(v, pipelines.with_counters(state.guardrail_stream(arriving(v, v.positions, "positions")), "gps"), "verdicts")
    rows = out.count()
    for _ in range(100):  # progress events arrive a moment after the query's end
        if counters.totals.get("gps.rows") == rows:
            break
        time.sleep(0.1)
    v.spark.streams.removeListener(counters)
    return out.select("courier_id", "event_id", "reason", "frozen_count", F.lit(counters.totals.get("gps.rows") == rows).alias("counted"))


@report("stream_zone_state", f"""WITH RECURSIVE {STATE_SQL} SELECT zone_id, event_id, {r('demand_index', 3)} AS demand_index, {r('supply_index', 3)} AS supply_index, trend AS demand_trend, ema AS demand_trend_ema,
  fc AS forecast_demand_index_15m, {r('event_pressure', 4)} AS event_pressure, context_stale_sources FROM zst""")
def stream_zone_state(v: Views):
    rows = written(v, state.zone_context_stream(arriving(v, v.context_signals, "signals")), "zone-rows")
    return latest_by(rows, ["zone_id"], "ts", "event_id").select(
        "zone_id", "event_id", "demand_index", "supply_index", "demand_trend", "demand_trend_ema", "forecast_demand_index_15m", "event_pressure", "context_stale_sources")


@report("stream_offer_features", ENRICH_SQL)
def stream_offer_features(v: Views):
    positions, signals, out = (new_folder(v.spark, n) for n in ("positions", "signals", "features"))
    parsed = context.parse_signal(v.context_signals)
    lake.with_hour_parts(v.positions).write.partitionBy("year", "month", "day", "hour").parquet(positions)
    parsed.write.parquet(signals)
    finished(pipelines.offer_feature_sink(arriving(v, v.offers, "offers"), positions, signals, out, new_folder(v.spark, "features-checkpoint"),
                                          lake.with_hour_parts(v.positions).schema, parsed.schema))
    return v.spark.read.parquet(out).select("offer_id", "distance_to_pickup_km", "eta_to_pickup_min", "fuel_cost_usd", "eur_per_hour_net", "pressure_ratio",
                                            "accept_score_heuristic", F.array_join("explanation", ",").alias("explanation"))
