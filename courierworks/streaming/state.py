"""Keyed streaming state: GPS guardrails, live positions and zone trends.

Each query keeps one small state per key and runs the same step as its batch twin, so both give the
same rows for the same order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from courierworks.functions.num import round_half_up
from courierworks.operators.context import SIGNAL_COLUMNS, TREND_COLUMNS, ZONE_TREND, parse_signal, zone_trend_step
from courierworks.operators.guardrails import INPUTS, VERDICT, Limits, guard_step, with_inputs

_STATE = "state array<double>"


def _stateful_fold(stream: DataFrame, key: str, order: list[str], inputs: list[str], carried: list[str], step, outputs: T.StructType,
                   ttl_ms: int | None) -> DataFrame:
    """Run a step over the rows of every key in every micro-batch, ordered by `order` inside the batch.

    Without rows for `ttl_ms` of processing time the state of a key is dropped.
    """
    names = [field.name for field in outputs.fields]
    schema = T.StructType([stream.schema[c] for c in [key, *carried]] + list(outputs.fields))

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # One key's rows of one micro-batch; the trigger and the source limit bound their number.
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        current = list(state.get[0]) if state.exists else None
        made = []
        for values in zip(*(rows[c].tolist() for c in inputs)):
            result, current = step(current, values)
            made.append(result)
        if current is not None:
            state.update((current,))
            if ttl_ms is not None:
                state.setTimeoutDuration(ttl_ms)
        out = rows[[key, *carried]].reset_index(drop=True)
        for field, column in zip(outputs.fields, zip(*made)):
            out[field.name] = pd.Series(column, dtype="object" if isinstance(field.dataType, T.StringType) else None)
        yield out[[key, *carried, *names]]

    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy(key).applyInPandasWithState(run, schema, _STATE, "append", timeout)


def guardrail_stream(positions: DataFrame, limits: Limits = Limits(), ttl_ms: int | None = None) -> DataFrame:
    """Verdict per position of a stream; see `gps_guardrails` for the batch twin."""
    carried = [c for c in positions.columns if c != "courier_id"]
    rows = with_inputs(positions)
    return _stateful_fold(rows, "courier_id", ["__us", "event_id"], INPUTS, carried, guard_step(limits), VERDICT, ttl_ms)


def zone_trend_stream(signals: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Trend columns per signal of a stream; see `zone_trend_ema` for the batch twin."""
    rows = signals.withColumns({"__demand": round_half_up("demand_index", 3), "__us": F.unix_micros("ts").cast("double")})
    return _stateful_fold(rows, "zone_id", ["__us", "event_id"], ["__demand", "__us"], ["event_id", "ts"], zone_trend_step, ZONE_TREND, ttl_ms)


def zone_context_stream(signals: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The whole zone row per signal of a stream: parsed metadata and trend; see `zone_context_history` for the batch twin.

    The trend state of a zone that stays silent for `ttl_ms` expires.
    """
    rows = signals.withColumns({"__demand": round_half_up("demand_index", 3), "__us": F.unix_micros("ts").cast("double")})
    return parse_signal(_stateful_fold(rows, "zone_id", ["__us", "event_id"], ["__demand", "__us"], SIGNAL_COLUMNS, zone_trend_step, ZONE_TREND, ttl_ms), TREND_COLUMNS)


LIVE = "courier_id string, event_id long, ts timestamp, lat double, lon double, status string, live boolean"


def live_position_stream(accepted: DataFrame, ttl_ms: int = 30_000) -> DataFrame:
    """Newest accepted position per courier, and one row with live = false when a courier falls silent."""
    columns = ["event_id", "ts", "lat", "lon", "status"]

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = dict(zip(columns, state.get))
            state.remove()
            yield pd.DataFrame([{"courier_id": group[0], **last, "live": False}])
            return
        newest = None
        for batch in batches:
            top = batch.sort_values(["ts", "event_id"]).iloc[-1]
            if newest is None or (top["ts"], top["event_id"]) > (newest["ts"], newest["event_id"]):
                newest = top
        if state.exists and pd.Timestamp(state.get[1]) > pd.Timestamp(newest["ts"]):
            state.setTimeoutDuration(ttl_ms)
            return
        state.update((int(newest["event_id"]), newest["ts"].to_pydatetime(), float(newest["lat"]), float(newest["lon"]), newest["status"]))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame([{"courier_id": group[0], **{c: newest[c] for c in columns}, "live": True}])

    return accepted.select("courier_id", *columns).groupBy("courier_id").applyInPandasWithState(
        run, LIVE, "event_id long, ts timestamp, lat double, lon double, status string", "update", GroupStateTimeout.ProcessingTimeTimeout)
