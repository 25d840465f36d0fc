"""Schemas of the messages and lakes, as DDL text. Money and rates are doubles in compute, times are UTC timestamps."""

from __future__ import annotations

from courierworks.sources.events import WIDE_COLUMNS, WIDE_TEXTS


POSITION = (
    "event_id string, event_type string, ts string, courier_id string, lat double, lon double, speed_kmh double, heading_deg double, "
    "accuracy_m double, battery_pct double, status string, source_platform string")
ORDER_OFFER = (
    "event_id string, event_type string, ts string, offer_id string, courier_id string, pickup_lat double, pickup_lon double, "
    "dropoff_lat double, dropoff_lon double, estimated_fare_eur double, estimated_distance_km double, estimated_duration_min double, "
    "demand_index double, weather_factor double, traffic_factor double, zone_id string, source_platform string")
ORDER_EVENT = (
    "event_id string, event_type string, ts string, offer_id string, order_id string, courier_id string, status string, "
    "actual_fare_eur double, actual_distance_km double, actual_duration_min double, zone_id string, source_platform string")
CONTEXT_SIGNAL = (
    "event_id string, event_type string, ts string, zone_id string, demand_index double, supply_index double, weather_factor double, "
    "traffic_factor double, source string")

HOUR_PARTS = ["year", "month", "day", "hour"]
_PARTS = ", ".join(f"{p} int" for p in HOUR_PARTS)
POSITION_LAKE_COLUMNS = ["courier_id", "lat", "lon", "speed_kmh", "heading_deg", "status", "accuracy_m", "battery_pct", "ts"]
POSITION_LAKE = (
    "courier_id string, lat double, lon double, speed_kmh double, heading_deg double, status string, accuracy_m double, "
    f"battery_pct double, ts timestamp, {_PARTS}")
EVENT_LAKE = (", ".join(
    f"{c} {'string' if c in WIDE_TEXTS else 'timestamp' if c == 'ts' else 'double'}" for c in WIDE_COLUMNS) + f", {_PARTS}")
