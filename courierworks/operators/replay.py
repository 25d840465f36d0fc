"""Replay of past events and positions in one timeline."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierworks.sources.conform import platform

REPLAY_COLUMNS = {
    "ts": "timestamp", "topic": "string", "event_type": "string", "event_id": "string", "courier_id": "string",
    "offer_id": "string", "order_id": "string", "status": "string", "zone_id": "string",
    "estimated_fare_eur": "double", "actual_fare_eur": "double", "demand_index": "double", "supply_index": "double",
    "source_platform": "string", "lat": "double", "lon": "double", "speed_kmh": "double", "heading_deg": "double",
    "accuracy_m": "double", "battery_pct": "double",
}


def check_range(start: datetime, end: datetime, courier_id: str | None, max_hours: float | None = None,
                max_hours_without_courier: float | None = None) -> None:
    """Refuse a range that ends before it starts or, where bounds are given, one that is longer."""
    if end < start:
        raise ValueError("the end lies before the start")
    if max_hours is not None and end - start > timedelta(hours=max_hours):
        raise ValueError(f"the range is longer than {max_hours} h")
    if courier_id is None and max_hours_without_courier is not None and end - start > timedelta(hours=max_hours_without_courier):
        raise ValueError(f"ranges over {max_hours_without_courier} h need a courier")


def _aligned(df: DataFrame, fixed: dict[str, str]) -> DataFrame:
    columns = []
    for name, kind in REPLAY_COLUMNS.items():
        value = F.lit(fixed[name]) if name in fixed else F.col(name) if name in df.columns else F.lit(None)
        columns.append(value.cast(kind).alias(name))
    return df.select(*columns)


def replay(events: DataFrame | None, positions: DataFrame | None) -> DataFrame:
    """Events and positions in one schema; a side that is None is left out."""
    parts = []
    if events is not None:
        parts.append(_aligned(events.withColumn("source_platform", platform(events)), {}))
    if positions is not None:
        ready = positions.withColumn("status", F.coalesce("status", F.lit("unknown")))
        parts.append(_aligned(ready, {"topic": "livreurs-gps", "event_type": "courier.position.v1", "event_id": "",
                                      "offer_id": "", "order_id": "", "zone_id": "", "source_platform": "position_lake"}))
    if not parts:
        raise ValueError("nothing to replay")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def replay_tail(events: DataFrame | None, positions: DataFrame | None, start: datetime, end: datetime,
                courier_id: str | None = None, limit: int = 300, max_hours: float | None = None,
                max_hours_without_courier: float | None = None) -> DataFrame:
    """The newest `limit` rows of the range in ascending order.

    Each source is cut to its own newest `limit` rows first, so the union is small whatever the lake holds.
    """
    check_range(start, end, courier_id, max_hours, max_hours_without_courier)
    if limit < 1:
        raise ValueError("limit must be at least 1")

    def newest(df: DataFrame | None) -> DataFrame | None:
        if df is None:
            return None
        rows = df.where((F.col("ts") >= F.lit(start)) & (F.col("ts") <= F.lit(end)))
        if courier_id is not None:
            rows = rows.where(F.col("courier_id") == courier_id)
        return rows.orderBy(F.desc("ts"), "courier_id", "event_id").limit(limit)

    tail = replay(newest(events), newest(positions))
    return tail.orderBy(F.desc("ts"), "courier_id", "event_id").limit(limit).orderBy("ts", "courier_id", "event_id")
