"""From raw messages to checked positions: parsing, validation, dead letters, normalisation, rate limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courierworks.functions.num import finite
from courierworks.functions.status import POSITION_STATUSES

# Numbers arrive as text so that both 1.5 and "1.5" parse.
_WIRE = ("livreur_id string, courier_id string, lat string, lon string, speed_kmh string, heading_deg string, status string, "
         "accuracy_m string, battery_pct string, timestamp string, ts string, source_platform string, __broken string")
# Name, lower and upper bound of the checked numbers.
BOUNDS = {"lat": (-90.0, 90.0), "lon": (-180.0, 180.0), "speed_kmh": (0.0, 300.0), "heading_deg": (0.0, 360.0),
          "accuracy_m": (0.0, 10000.0), "battery_pct": (0.0, 100.0)}
RAW_LIMIT = 8000


def parse_time(text: Column) -> Column:
    """ISO-8601 text as a UTC timestamp: `Z` and offsets are read, text without a zone is UTC, else NULL."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("timestamp")


def parse_positions(raw: DataFrame, value: str = "value") -> DataFrame:
    """JSON position messages as columns; all other columns stay, `broken` marks text that is no JSON object."""
    body = F.col(value).cast("string")
    # Exploding a one-element array keeps the parse in one place: as a plain column Catalyst would copy
    # it into every expression and filter that reads one of its fields.
    message = F.from_json(body, _WIRE, {"columnNameOfCorruptRecord": "__broken"})
    parsed = raw.select("*", F.explode(F.array(message)).alias("__m"))
    m = lambda name: F.col(f"__m.{name}")
    some = lambda *names: F.coalesce(*[F.nullif(m(n), F.lit("")) for n in names])
    number = lambda name, default: finite(F.coalesce(m(name), F.lit(default))) if default is not None else finite(m(name))
    return parsed.select(
        *raw.columns, some("livreur_id", "courier_id").alias("courier_id"), number("lat", None).alias("lat"), number("lon", None).alias("lon"),
        *[number(n, "0.0").alias(n) for n in ("speed_kmh", "heading_deg", "accuracy_m", "battery_pct")],
        F.coalesce(m("status"), F.lit("unknown")).alias("status"), some("timestamp", "ts").alias("ts_text"),
        F.coalesce(m("source_platform"), F.lit("")).alias("source_platform"),
        (m("__broken").isNotNull() | F.col("__m").isNull()).alias("broken"))


def reject_reasons() -> Column:
    """The broken rules of a parsed position, empty for a good one."""
    c = F.col
    bad = lambda name: c(name).isNull() | (c(name) < BOUNDS[name][0]) | (c(name) > BOUNDS[name][1])
    rules = [
        (F.coalesce(~F.length("courier_id").between(1, 64), F.lit(True)), "courier_id_length"),
        *[(bad(name), f"{name}_range") for name in BOUNDS],
        (~c("status").isin(POSITION_STATUSES), "status_unknown_word"), (F.coalesce(c("ts_text"), F.lit("")) == "", "ts_empty"),
        (F.length("source_platform") > 255, "source_platform_length"),
    ]
    found = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for condition, name in rules]))
    return F.when(c("broken"), F.array(F.lit("malformed_json"))).otherwise(found)


def validate_positions(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid positions (with `ts` as a timestamp) and rejects (with `reasons`)."""
    checked = parsed.withColumn("reasons", reject_reasons())
    good = checked.where(F.size("reasons") == 0).withColumn("ts", parse_time(F.col("ts_text"))).drop("reasons", "broken", "ts_text")
    return good, checked.where(F.size("reasons") > 0)


def dead_letters(rejects: DataFrame, topic: str, now: Column, value: str = "value") -> DataFrame:
    """One row per reject: topic, reason, the start of the raw message in hex, time and day of rejection."""
    raw = F.substring(F.lower(F.hex(F.col(value).cast("binary"))), 1, RAW_LIMIT)
    return rejects.select(F.lit(topic).alias("topic"), F.array_join("reasons", ",").alias("reason"), raw.alias("raw_hex"),
                          now.alias("ts_rejected"), F.date_format(now, "yyyy-MM-dd").alias("day"))


def write_dead_letters(letters: DataFrame, root: str) -> None:
    letters.write.mode("append").partitionBy("day").json(root)


def dlq_stats(letters: DataFrame) -> DataFrame:
    """Rejects per day, topic and reason."""
    return letters.groupBy("day", "topic", "reason").agg(F.count("*").alias("rejects"))


def dlq_peek(letters: DataFrame, n: int = 20) -> DataFrame:
    return letters.orderBy(F.desc("ts_rejected"), "topic", "reason", "raw_hex").limit(n)


def normalize_ingest(rows: DataFrame, now: Column) -> DataFrame:
    """Gateway positions with defaults: an unreadable time becomes `now`, accuracy 8, battery 100."""
    have = set(rows.columns)
    default = {"speed_kmh": 0.0, "heading_deg": 0.0, "accuracy_m": 8.0, "battery_pct": 100.0}
    fill = {n: F.coalesce(F.col(n).cast("double"), F.lit(d)) if n in have else F.lit(d) for n, d in default.items()}
    status = F.coalesce("status", F.lit("unknown")) if "status" in have else F.lit("unknown")
    source = F.coalesce("source_platform", F.lit("driver_ingest")) if "source_platform" in have else F.lit("driver_ingest")
    return rows.withColumns({**fill, "status": status, "source_platform": source, "ts": F.coalesce(parse_time(F.col("ts")), now),
                             "event_type": F.lit("courier.position.v1")})


def rate_limit_flag(rows: DataFrame, token: str, ts: str, tie: str, per_minute: int = 1800) -> DataFrame:
    """Adds `refused`: the row is beyond the first `per_minute` of its token and minute.

    Ranks need the rows of one (token, minute) together; a flood in one minute is first cut into
    seconds, whose counts give the offset of every second inside the minute.
    """
    minute, second = F.floor(F.unix_micros(ts) / 60_000_000), F.floor(F.unix_micros(ts) / 1_000_000)
    placed = rows.withColumns({"__m": minute, "__s": second})
    counts = placed.groupBy(token, "__m", "__s").count()
    before = F.sum("count").over(Window.partitionBy(token, "__m").orderBy("__s")) - F.col("count")
    offsets = counts.select(token, "__m", "__s", before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy(token, "__m", "__s").orderBy(ts, tie))
    return placed.join(offsets, [token, "__m", "__s"]).withColumn("refused", F.col("__before") + inside > per_minute).drop("__m", "__s", "__before")
