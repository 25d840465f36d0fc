"""Health of data, routing and the whole service from one row of figures per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierworks.functions.scoring import words

ROUTING_SUCCESS_MIN, HOLD_RATE_MAX = 0.8, 0.30


def data_quality_health(runs: DataFrame) -> DataFrame:
    """Status, flags, optional sources and context summary.

    Reads replay_mode, supply_flat_alert, stale_sources_count, stale_dot_speeds, dot_speeds_status,
    dot_speeds_rows and context_fallback_applied.
    """
    c = F.col
    single = F.coalesce(c("replay_mode") == "single_driver", F.lit(False))
    flat = c("supply_flat_alert") & ~single
    word = F.coalesce("dot_speeds_status", F.lit(""))
    optional = c("stale_dot_speeds") | (word.isin("", "degraded") & (c("dot_speeds_rows") == 0))
    core = F.greatest(c("stale_sources_count") - c("stale_dot_speeds").cast("int"), F.lit(0))
    flags = words([
        F.when(flat, "supply_flat"), F.when(~optional & (word != "") & ~word.isin("ok", "fresh"), "dot_speeds"),
        F.when(core > 0, "core_context_fallback")])
    rows = runs.withColumns({
        "supply_flat_effective": flat, "supply_signal_mode": F.when(single, "single_driver_demo").otherwise("fleet_live"),
        "effective_stale_sources": core, "optional_sources": words([F.when(optional, "nyc_dot_speeds")]), "monitoring_flags": flags})
    watched = F.size("monitoring_flags") > 0
    return rows.withColumns({
        "data_status": F.when(watched, "monitoring").otherwise("ok"),
        "context_summary": F.when(watched, "Context monitored").when(
            c("context_fallback_applied") & (F.size("optional_sources") > 0), "Fallback stable").otherwise("Context fresh")})


def routing_health(runs: DataFrame, success_min: float = ROUTING_SUCCESS_MIN, hold_max: float = HOLD_RATE_MAX) -> DataFrame:
    """Status and readiness of routing; reads route_requests, routing_state, routing_degraded, routing_success_rate, hold_rate."""
    c = F.col
    poor = (c("routing_success_rate") < success_min) | F.coalesce(c("hold_rate") > hold_max, F.lit(False))
    status = (F.when(c("routing_degraded"), "degraded")
              .when((F.coalesce("routing_state", F.lit("")) != "") & (c("route_requests") == 0), "warming_up")
              .when(c("routing_success_rate").isNull(), "idle").when(poor, "monitoring").otherwise("ok"))
    return runs.withColumn("routing_status", status).withColumn("routing_ready", F.col("routing_status").isin("ok", "warming_up", "idle"))


def readiness(runs: DataFrame) -> DataFrame:
    """Blocking issues, status and summary; reads the two health results, model_loaded, model_accepted, replay_status and replay_mode."""
    c = F.col
    blocking = words([F.when(~c("model_loaded"), "model_unavailable"), F.when(~c("model_accepted"), "model_quality_gate"),
                      F.when(c("routing_status") == "degraded", "routing_degraded")])
    catching_up = (F.coalesce("replay_mode", F.lit("")) != "single_driver") & (F.coalesce("replay_status", F.lit("")) != "") & ~c("replay_status").isin("ok", "running")
    watched = c("routing_status").isin("warming_up", "monitoring") | catching_up | (c("data_status") == "monitoring")
    rows = runs.withColumn("blocking_issues", blocking)
    return rows.withColumns({
        "ready": F.size("blocking_issues") == 0,
        "readiness_status": F.when(F.size("blocking_issues") > 0, "degraded").when(watched, "monitoring").otherwise("ok")}).withColumn(
        "summary", F.when(F.col("readiness_status") == "degraded", "Attention needed before demo")
        .when(F.col("readiness_status") == "monitoring", "Demo ready, monitoring non-blocking signals").otherwise("Demo ready"))


def quality_badges(runs: DataFrame) -> DataFrame:
    """One row per run and badge with its tone."""
    tone = lambda good, warn: F.when(good, "good").when(warn, "warn").otherwise("bad")
    c = F.col
    badges = F.array(
        F.struct(F.lit("demo_readiness").alias("code"), c("summary").alias("label"), tone(c("readiness_status") == "ok", c("ready")).alias("tone")),
        F.struct(F.lit("model_gate").alias("code"), F.when(c("model_accepted"), "Model gate OK").otherwise("Model gate flagged").alias("label"),
                 tone(c("model_accepted"), F.lit(True)).alias("tone")),
        F.struct(F.lit("routing").alias("code"), F.concat(F.lit("Routing "), c("routing_status")).alias("label"),
                 tone(c("routing_status") == "ok", c("routing_ready") | (c("routing_status") == "monitoring")).alias("tone")),
        F.struct(F.lit("context").alias("code"), c("context_summary").alias("label"), tone(c("data_status") == "ok", F.lit(True)).alias("tone")))
    return runs.select("run_id", F.explode(badges).alias("b")).select("run_id", "b.code", "b.label", "b.tone")
