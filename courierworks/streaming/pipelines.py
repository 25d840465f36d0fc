"""Streaming reads, sinks and counters around the keyed state."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from courierworks.plans.enrich import enrich_offers
from courierworks.sources.ingest import dead_letters, parse_positions, validate_positions
from courierworks.sources.lake import hours_between, with_hour_parts
from courierworks.sources.schemas import HOUR_PARTS, POSITION_LAKE_COLUMNS


def file_stream(spark: SparkSession, root: str, schema, files_per_trigger: int = 100, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(root)


def kafka_stream(spark: SparkSession, servers: str, topics: list[str], per_trigger: int = 50_000) -> DataFrame:
    """Raw messages of the topics; needs the Kafka package on the cluster's class path."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
            .option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", per_trigger).load())


def position_streams(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Valid positions and rejects of a raw stream; each runs as its own query with its own checkpoint."""
    return validate_positions(parse_positions(raw, value))


def dlq_stream(rejects: DataFrame, topic: str, now: Column) -> DataFrame:
    return dead_letters(rejects, topic, now)


def lake_sink(stream: DataFrame, root: str, checkpoint: str, seconds: int = 60) -> DataStreamWriter:
    """Append to the position lake by hour; the checkpoint makes every row appear once."""
    names = [c for c in POSITION_LAKE_COLUMNS if c in stream.columns]
    return (with_hour_parts(stream.select(*names)).writeStream.format("parquet").partitionBy(*HOUR_PARTS).outputMode("append")
            .option("path", root).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds"))


def dlq_sink(letters: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    return letters.writeStream.format("json").partitionBy("day").outputMode("append").option("path", root).option("checkpointLocation", checkpoint)


def minute_rate_limit(stream: DataFrame, token: str = "token", per_minute: int = 1800, late: str = "2 minutes") -> DataFrame:
    """Tokens and minutes with more rows than allowed; the watermark bounds the state."""
    counts = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), token).agg(F.count("*").alias("rows"))
    return counts.where(F.col("rows") > per_minute).select(token, F.col("window.start").alias("minute"), "rows")


def _up_to(rows: DataFrame, newest: datetime, oldest: datetime | None) -> DataFrame:
    """Rows not after `newest` (and not before `oldest`); comparing `ts` itself and the hour folders lets the scan skip files."""
    rows = rows.where(F.col("ts") <= F.lit(newest))
    if oldest is not None:
        rows = rows.where(F.col("ts") >= F.lit(oldest))
        if all(p in rows.columns for p in HOUR_PARTS):
            rows = rows.where(hours_between(oldest, newest))
    return rows


def offer_feature_sink(offers: DataFrame, positions_root: str, signals_root: str, out: str, checkpoint: str, positions_schema, signals_schema,
                       lookback_minutes: int | None = None) -> DataStreamWriter:
    """Features of every arriving offer, from the position lake and the parsed signals up to its time.

    With `lookback_minutes` what is older has expired and is not read; without, the rows are those of the batch twin.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        span = batch.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
        if span["hi"] is None:
            return
        oldest = None if lookback_minutes is None else span["lo"] - timedelta(minutes=lookback_minutes)
        known = lambda root, schema: _up_to(spark.read.schema(schema).parquet(root), span["hi"], oldest)
        enriched = enrich_offers(batch, known(positions_root, positions_schema), known(signals_root, signals_schema))
        # Keyed by the batch, so a repeated batch replaces its own rows.
        enriched.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return offers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def latest_offers_per_driver(features: DataFrame, n: int = 100) -> DataFrame:
    """The offers a driver can still see: the newest `n`, as the feature says."""
    from courierworks.operators.keyed import top_per_key

    return top_per_key(features, ["courier_id"], [F.desc("ts"), F.asc("offer_id")], n)


def with_counters(stream: DataFrame, name: str) -> DataFrame:
    """Counts rows, rejects and couriers of every micro-batch; read them with `Counters`."""
    rejected = F.count_if(F.col("reason").isNotNull()) if "reason" in stream.columns else F.lit(0)
    return stream.observe(name, F.count("*").alias("rows"), rejected.alias("rejects"))


class Counters(StreamingQueryListener):
    """Running totals of the observed counters of all queries of a session."""

    def __init__(self) -> None:
        self.totals: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            for key, value in row.asDict().items():
                self.totals[f"{name}.{key}"] = self.totals.get(f"{name}.{key}", 0) + int(value)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
