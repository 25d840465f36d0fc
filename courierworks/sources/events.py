"""The three event kinds in one wide schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Topics, event types and source tags of the wide event table.
OFFERS, EVENTS, CONTEXT = "order-offers-v1", "order-events-v1", "context-signals-v1"
WIDE_TEXTS = ["topic", "event_type", "event_id", "offer_id", "order_id", "courier_id", "status", "zone_id", "source",
              "source_platform"]
WIDE_NUMBERS = ["pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon", "estimated_fare_eur", "estimated_distance_km",
                "estimated_duration_min", "actual_fare_eur", "actual_distance_km", "actual_duration_min",
                "demand_index", "supply_index", "weather_factor", "traffic_factor"]
WIDE_COLUMNS = [*WIDE_TEXTS, *WIDE_NUMBERS, "ts"]


def _wide(df: DataFrame, topic: str, event_type: str, fixed: dict[str, str]) -> DataFrame:
    def column(name: str) -> Column:
        if name in fixed:
            return F.lit(fixed[name])
        if name == "topic":
            return F.lit(topic)
        if name == "event_type":
            own = F.nullif(F.col(name), F.lit("")) if name in df.columns else F.lit(None).cast("string")
            return F.coalesce(own, F.lit(event_type))
        if name == "source_platform":
            own = F.nullif(F.trim(name), F.lit("")) if name in df.columns else F.lit(None).cast("string")
            return F.coalesce(own, F.lit("unknown"))
        kind = "string" if name in WIDE_TEXTS else "timestamp" if name == "ts" else "double"
        return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)

    return df.select(*[column(name).alias(name) for name in WIDE_COLUMNS])


def normalize_events(offers: DataFrame | None = None, order_events: DataFrame | None = None,
                     context: DataFrame | None = None) -> DataFrame:
    """The given event tables as one wide table of 25 columns."""
    parts = []
    if offers is not None:
        parts.append(_wide(offers, OFFERS, "order.offer.v1", {"status": "offered", "source": "normalized-order-offer", "order_id": ""}))
    if order_events is not None:
        parts.append(_wide(order_events, EVENTS, "order.event.v1", {"source": "normalized-order-event"}))
    if context is not None:
        parts.append(_wide(context, CONTEXT, "context.signal.v1", {
            "status": "signal", "offer_id": "", "order_id": "", "courier_id": "",
            "source_platform": "context_poller_public"}))
    if not parts:
        raise ValueError("no event table given")
    wide = parts[0]
    for part in parts[1:]:
        wide = wide.unionByName(part)
    return wide
