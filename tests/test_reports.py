"""Reports against their checks on the smallest data; ALL_REPORTS=1 runs every report."""

import os

import pytest

from courierworks.catalog import CHECKS, REPORTS
from tests.compare import compare
from tests.conftest import SMALL

QUICK = ["heatmap", "trajectory_summary", "driver_scores", "fleet_status", "zone_coverage", "demand_trend", "surge", "nearby_couriers", "fact_missions",
         "kpi_accept_rate", "wide_events", "replay_tail", "gps_guardrails", "frozen_streaks", "detect_anomalies", "event_pressure", "zone_trend_ema",
         "offers_asof_context", "score_offers", "rank_offers", "mission_stats", "backtest", "prepared_trips", "parsed_positions", "speed_samples"]
NAMES = list(REPORTS) if os.environ.get("ALL_REPORTS") else QUICK


@pytest.mark.parametrize("name", NAMES)
def test_report(name, spark, duck):
    assert compare(name, spark, duck, SMALL) is None


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) >= set(CHECKS) and set(entry.queries()) >= set(REPORTS)
    assert set(entry.oracle_sql()) <= set(entry.queries())
