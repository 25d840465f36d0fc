"""Wall time of the headline reports; prints one JSON line.

Every report runs over its whole tables and is written to a sink that discards the rows.
"""

from __future__ import annotations

import json
import os
import time

from courierworks.catalog import REPORTS
from courierworks.session import build_session
from courierworks.sources.adapters import Views

HEADLINES = [
    "heatmap", "trajectory_summary", "step_km", "driver_scores", "fleet_productivity", "fleet_status", "zone_coverage", "demand_trend",
    "surge", "zone_hour_profile", "nearby_couriers", "nearest_zone", "fact_missions", "kpi_accept_rate", "kpi_offer_net", "kpi_pressure",
    "replay_tail", "gps_guardrails", "detect_anomalies", "zone_context_state", "event_pressure", "offers_asof_context", "enrich_offers",
    "score_offers", "rank_offers", "best_offers_around", "next_best_zone", "shift_plan", "training_frame", "backtest", "scenario_comparison",
    "usable_trips", "trip_points", "mission_stats",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(",")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    views = Views(spark, folder)
    views.events.count()
    views.orders.count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REPORTS[name](views).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    positions = views.events.count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1],
        "guardrail_rows_per_s": round(positions / seconds["gps_guardrails"]) if "gps_guardrails" in seconds else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
