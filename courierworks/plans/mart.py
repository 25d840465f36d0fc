"""The analytical mart: offers, order events, context signals and missions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierworks.functions.cost import fuel_cost_plain, net_eur, net_eur_h
from courierworks.functions.num import ratio
from courierworks.operators.keyed import latest_by
from courierworks.sources.conform import conform_schema

_ESTIMATES = {"estimated_fare_eur": 0.0, "estimated_distance_km": 0.0, "estimated_duration_min": 0.0}
_ACTUALS = {"actual_fare_eur": None, "actual_distance_km": None, "actual_duration_min": None}
_INDICES = {"demand_index": 1.0, "supply_index": 1.0, "weather_factor": 1.0, "traffic_factor": 1.0}
_ORDER_TEXTS = {"offer_id": "unknown_offer", "order_id": None, "courier_id": "unknown_courier", "zone_id": "unknown_zone"}


def _pressure() -> Column:
    return F.coalesce(ratio("demand_index", "supply_index"), F.lit(0.0))


def _net_columns() -> dict[str, Column]:
    args = ("estimated_fare_eur", "estimated_distance_km")
    return {"net_eur": net_eur(*args), "net_eur_h": net_eur_h(*args, "estimated_duration_min")}


def fact_offers(offers: DataFrame) -> DataFrame:
    clean = conform_schema(offers, "offers", ["offer_id", "ts"], _ORDER_TEXTS, {**_ESTIMATES, **_ACTUALS, **_INDICES})
    return clean.withColumns({
        "pressure_ratio": _pressure(), **_net_columns(), "fuel_cost_usd": fuel_cost_plain("estimated_distance_km")})


def fact_order_events(events: DataFrame) -> DataFrame:
    clean = conform_schema(events, "order events", ["event_id", "offer_id", "ts", "status"],
                           {"event_id": "unknown_event", **_ORDER_TEXTS, "event_type": None},
                           {**_ESTIMATES, **_ACTUALS, **_INDICES})
    return clean.withColumns({"event_type": F.coalesce("event_type", F.lit("order.event.v1")), **_net_columns()})


def fact_context_signals(signals: DataFrame) -> DataFrame:
    clean = conform_schema(signals, "context signals", ["zone_id", "ts"],
                           {"event_id": "unknown_event", "courier_id": "unknown_courier", "zone_id": "unknown_zone"},
                           _INDICES, with_status=False)
    surge = (F.col("demand_index") > 0.7) & (F.col("supply_index") < 0.4)
    return clean.withColumns({"pressure_ratio": _pressure(), "surge_candidate": F.coalesce(surge, F.lit(False))})


MISSION_COLUMNS = {
    "mission_id": "string", "courier_id": "string", "zone_id": "string", "source_platform": "string",
    "completed_at": "timestamp", "year": "int", "month": "int", "day": "int", "actual_fare_eur": "double",
    "actual_distance_km": "double", "actual_duration_min": "double", "estimated_fare_eur": "double",
    "estimated_distance_km": "double", "estimated_duration_min": "double", "realized_net_eur": "double",
    "realized_net_eur_h": "double", "demand_index": "double", "supply_index": "double", "weather_factor": "double",
    "traffic_factor": "double", "status": "string",
}


def fact_missions(events: DataFrame | None, offers: DataFrame | None = None, spark=None) -> DataFrame:
    """Order events with the newest offer of the same id and the realised net revenue.

    `events` and `offers` are mart tables. Without offers the estimates stay NULL; without events the
    result is one 'no_data' row.
    """
    if events is None:
        row = [F.lit(None).cast(kind).alias(name) for name, kind in MISSION_COLUMNS.items()]
        fixed = {"mission_id": "no_data", "source_platform": "unknown", "status": "unknown"}
        return spark.range(1).select(*row).withColumns({k: F.lit(v) for k, v in fixed.items()})
    estimates = list(_ESTIMATES)
    base = events.drop(*estimates)
    if offers is None:
        joined = base.withColumns({c: F.lit(None).cast("double") for c in estimates})
    else:
        # The tie-break needs a unique column; offers carry none, so equal times fall back on all estimates.
        newest = latest_by(offers.withColumn("__tie", F.struct(*estimates)), ["offer_id"], "ts", "__tie")
        joined = base.join(newest.select("offer_id", *estimates), "offer_id", "left")
    fare, km, minutes = F.col("actual_fare_eur"), F.col("actual_distance_km"), F.col("actual_duration_min")
    # Both are NULL where fare or distance is missing, because NULL goes through the arithmetic.
    net = net_eur(fare, km)
    hourly = F.when(F.coalesce(minutes, F.lit(0.0)) > 0, net / (minutes / 60.0))
    return joined.withColumnsRenamed({"event_id": "mission_id", "ts": "completed_at"}).withColumns(
        {"realized_net_eur": net, "realized_net_eur_h": hourly}).select(*MISSION_COLUMNS)


def build_mart(topics: dict[str, DataFrame], spark=None) -> dict[str, DataFrame]:
    """The mart tables of the topics that are present."""
    tables: dict[str, DataFrame] = {}
    if "order-offers-v1" in topics:
        tables["fact_offers"] = fact_offers(topics["order-offers-v1"])
    if "order-events-v1" in topics:
        tables["fact_order_events"] = fact_order_events(topics["order-events-v1"])
    if "context-signals-v1" in topics:
        tables["fact_context_signals"] = fact_context_signals(topics["context-signals-v1"])
    tables["fact_missions"] = fact_missions(tables.get("fact_order_events"), tables.get("fact_offers"), spark)
    return tables


def write_mart(tables: dict[str, DataFrame], root: str) -> None:
    """Write every table once, by day, so that reports read the days they need."""
    for name, table in tables.items():
        table.repartition("year", "month", "day", F.pmod(F.xxhash64(*table.columns[:2]), F.lit(16))).write.mode(
            "overwrite").partitionBy("year", "month", "day").parquet(f"{root}/{name}")
