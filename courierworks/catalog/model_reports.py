"""Reports over training data, model metrics, backtests and scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierworks.catalog.offer_reports import clamp, inputs
from courierworks.catalog.registry import r, report
from courierworks.functions.num import round_half_up
from courierworks.functions.status import tidy
from courierworks.operators.keyed import exact_quantile
from courierworks.plans import backtest, training
from courierworks.session import stage
from courierworks.sources.adapters import Views

FRAME_SQL = f"""oo AS (SELECT offer_id, max((s = 'accepted')::int) AS af, max((s = 'rejected')::int) AS rf, max((s = 'dropped_off')::int) AS df, max(nullif(actual_fare_eur, 0)) AS actual
  FROM (SELECT *, lower(trim(status)) AS s FROM order_events) GROUP BY 1),
ac AS (SELECT o.*, c.supply_index AS sctx, (epoch_us(o.ts) - epoch_us(c.ts)) / 1000000.0::double AS age FROM offers o ASOF LEFT JOIN context_signals c ON c.zone_id = o.zone_id AND c.ts <= o.ts),
j AS (SELECT ac.*, coalesce(af, 0) AS af, coalesce(rf, 0) AS rf, coalesce(df, 0) AS df, actual, coalesce(age >= 0 AND age <= 60, false) AS fresh,
  hour(ts - INTERVAL 5 HOUR) + minute(ts - INTERVAL 5 HOUR) / 60.0::double AS h FROM ac LEFT JOIN oo USING (offer_id)),
k AS (SELECT *, CASE WHEN fresh THEN 0 ELSE 1 END AS fallback, greatest(CASE WHEN fresh THEN sctx ELSE 1 END, 0.2) AS supply, CASE WHEN fresh THEN 0 WHEN age IS NULL THEN 3 WHEN age <= 7200 THEN 1 WHEN age <= 21600 THEN 2 ELSE 3 END AS stale,
  CASE WHEN (h >= 7 AND h < 10) OR (h >= 16 AND h < 20) THEN 1 ELSE 0 END AS peak, 1 AS weekend, {clamp('(weather_factor - 0.95::double) / 0.45::double')} AS wi FROM j),
l AS (SELECT *, peak * 0.14::double + 0.08::double AS tp FROM k),
m AS (SELECT *, {clamp('least(greatest(demand_index - 1, 0) / 0.9::double, 1) * 0.65::double + least(tp, 0.35::double) / 0.35::double * 0.25::double + wi * 0.1::double')} AS ep,
  (estimated_fare_eur * 0.75::double - estimated_distance_km * 0.621371::double / 31 * 3.65::double) / greatest(estimated_duration_min, 1) * 60 AS est,
  (actual * 0.75::double - estimated_distance_km * 0.621371::double / 31 * 3.65::double) / greatest(estimated_duration_min, 1) * 60 AS real FROM l),
q AS (SELECT greatest(quantile_cont(coalesce(real, est), 0.6), 14) AS thr FROM m),
fr AS (SELECT m.*, thr, CASE WHEN rf = 1 THEN 0 ELSE (coalesce(real, est) >= thr)::int END AS label,
  CASE WHEN rf = 1 THEN 'observed_rejected' WHEN df = 1 AND real IS NOT NULL THEN 'observed_realized' WHEN af = 1 THEN 'accepted_proxy' ELSE 'fallback_proxy' END AS label_source FROM m, q)"""


def frame(v: Views) -> DataFrame:
    events = v.order_events.withColumn("status", tidy("status"))
    # One minute of context age, so that the test hour has both fresh and stale rows.
    return training.training_frame(v.offers, events, v.context_signals, window_minutes=1)


@report("order_outcomes", """SELECT offer_id, max((s = 'accepted')::int)::bigint AS accepted_flag, max((s = 'rejected')::int)::bigint AS rejected_flag, max((s = 'dropped_off')::int)::bigint AS dropped_off_flag,
  max(nullif(actual_fare_eur, 0)) AS actual_fare_eur FROM (SELECT *, lower(trim(status)) AS s FROM order_events) GROUP BY 1""")
def order_outcomes(v: Views):
    out = training.order_outcomes(v.order_events.withColumn("status", tidy("status")))
    return out.withColumns({f"{k}_flag": F.col(f"{k}_flag").cast("long") for k in ("accepted", "rejected", "dropped_off")})


@report("training_frame", f"""WITH {FRAME_SQL} SELECT offer_id, supply AS supply_index, fallback::double AS context_fallback_applied, stale::double AS context_stale_sources, {r('h', 4)} AS temporal_hour_local,
  peak::double AS is_peak_hour, weekend::double AS is_weekend, {r('tp', 6)} AS temporal_pressure, {r('ep', 6)} AS event_pressure, {r('wi', 6)} AS weather_intensity, {r('est', 6)} AS estimated_net_eur_h, {r('real', 6)} AS realized_net_eur_h,
  {r('thr', 6)} AS label_threshold_eur_h, label::bigint AS label, label_source FROM fr""")
def training_frame(v: Views):
    rounded = ["temporal_pressure", "event_pressure", "weather_intensity", "estimated_net_eur_h", "realized_net_eur_h", "label_threshold_eur_h"]
    return frame(v).select(
        "offer_id", "supply_index", "context_fallback_applied", "context_stale_sources", round_half_up("temporal_hour_local", 4).alias("temporal_hour_local"),
        "is_peak_hour", "is_weekend", *[round_half_up(c, 6).alias(c) for c in rounded], F.col("label").cast("long").alias("label"), "label_source")


@report("training_summary", f"""WITH {FRAME_SQL}, s AS (SELECT label_source, count(*) AS rows, {r('avg(label)', 6)} AS positive_rate FROM fr GROUP BY 1 UNION ALL SELECT 'all', count(*), {r('avg(label)', 6)} FROM fr)
SELECT s.*, (SELECT {r('median(thr)', 6)} FROM fr) AS median_threshold_eur_h FROM s""")
def training_summary(v: Views):
    return training.training_summary(frame(v))


@report("fare_quantile_by_zone", f"SELECT zone_id, {r('quantile_cont(estimated_fare_eur, 0.8)', 6)} AS fare_q80 FROM offers GROUP BY 1")
def fare_quantile_by_zone(v: Views):
    return exact_quantile(v.offers, ["zone_id"], "estimated_fare_eur", 0.8, "q").select("zone_id", round_half_up("q", 6).alias("fare_q80"))


def rule_scored(v: Views) -> DataFrame:
    """Labels with the backtest's rule score in place of a model's, so that the metrics have a check in SQL."""
    return frame(v).select("label", round_half_up(backtest.copilot_score(), 3).alias("p"))


METRICS_SQL = f"""{FRAME_SQL}, sc AS (SELECT label, {r(clamp('est / 20 * 0.55::double + least(demand_index / greatest(supply, 0.01) / 3, 1) * 0.3::double + 0.15::double'), 3)} AS p FROM fr),
st AS (SELECT p, sum(label) AS pos, sum(1 - label) AS neg FROM sc GROUP BY 1),
su AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM st WINDOW w AS (ORDER BY p DESC)),
ag AS (SELECT sum(neg * (tp - pos + pos * 0.5::double)) AS area, sum(pos * (tp::double / (tp + fp))) AS ap, sum(pos)::double AS pp, sum(neg)::double AS nn FROM su),
bn AS (SELECT greatest(least(ceil((p - lo) / (hi - lo) * 10) - 1, 9), 0) AS bin, p, label FROM sc, (SELECT min(p) AS lo, max(p) AS hi FROM sc)),
ec AS (SELECT sum(m * abs(a - b)) / (SELECT count(*) FROM sc) AS ece FROM (SELECT bin, avg(p) AS a, avg(label) AS b, count(*) AS m FROM bn GROUP BY 1)),
pl AS (SELECT count(*) AS n, avg(label) AS pr, avg((p - label) * (p - label)) AS brier, count(*) FILTER (WHERE p >= 0.5 AND label = 1)::double AS a, count(*) FILTER (WHERE p >= 0.5)::double AS b FROM sc)"""


@report("model_metrics", f"""WITH {METRICS_SQL} SELECT n AS rows, {r('pr', 6)} AS positive_rate, {r('area / (pp * nn)', 6)} AS roc_auc, {r('ap / pp', 6)} AS average_precision, {r('a / b', 6)} AS precision_at_0_5, {r('a / pp', 6)} AS recall_at_0_5,
  {r('2 * (a / b) * (a / pp) / (a / b + a / pp)', 6)} AS f1_at_0_5, {r('brier', 6)} AS brier_score, {r('ece', 6)} AS ece_10_bins FROM ag, pl, ec""")
def model_metrics(v: Views):
    metrics = training.evaluate(rule_scored(v))
    return metrics.select("rows", *[round_half_up(c, 6).alias(c) for c in metrics.columns if c != "rows"])


@report("model_curves", f"WITH {METRICS_SQL} SELECT p, {r('fp / nn', 6)} AS fpr, {r('tp / pp', 6)} AS tpr, {r('tp::double / (tp + fp)', 6)} AS precision FROM su, ag")
def model_curves(v: Views):
    return training.curves(rule_scored(v)).select("p", *[round_half_up(c, 6).alias(c) for c in ("fpr", "tpr", "precision")])


@report("model_quality_gate", f"WITH {METRICS_SQL} SELECT n AS rows, CASE WHEN area / (pp * nn) < 0.6 THEN 'roc_auc_below_min' WHEN ap / pp < 0.45 THEN 'avg_precision_below_min' ELSE 'ok' END AS reason FROM ag, pl")
def model_quality_gate(v: Views):
    return training.quality_gate(training.evaluate(rule_scored(v))).select("rows", F.split_part("reason", F.lit(":"), F.lit(1)).alias("reason"))


@report("model_calibration", f"""WITH {METRICS_SQL}, od AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS k, count(*) OVER () AS n FROM sc),
ct AS (SELECT p AS q FROM od, range(1, 10) t(i) WHERE k = n * i // 10),
nb AS (SELECT label, p, (SELECT count(*) FROM ct WHERE q <= sc.p) AS bin FROM sc)
SELECT bin::int AS bin, {r('avg(p)', 6)} AS mean_score, {r('avg(label)', 6)} AS observed_rate, count(*) AS rows FROM nb GROUP BY 1""")
def model_calibration(v: Views):
    return training.calibration_bins(rule_scored(v)).select("bin", round_half_up("mean_score", 6).alias("mean_score"), round_half_up("observed_rate", 6).alias("observed_rate"), "rows")


@report("model_scores")
def model_scores(v: Views):
    """Probabilities of a model trained on the older offers, for the newer ones, with the regularisation chosen from the grid."""
    rows = stage(frame(v))
    model, metrics = training.train_model(rows)
    if [c["c"] for c in metrics["candidate_metrics"]] != training.C_GRID or metrics["best_logreg_c"] not in training.C_GRID:
        raise ValueError("the grid was not searched")
    _, test = training.temporal_split(rows)
    return training.probabilities(model, test).select("offer_id", F.col("label").cast("long").alias("label"), "p")


@report("model_importance")
def model_importance(v: Views):
    """Features of a model of all offers by the size of their standardised coefficient."""
    weighted, total = training.with_weights(frame(v))
    return training.feature_importance(training.fit(stage(weighted), 0.75, total), v.spark)


@report("model_offers")
def model_offers(v: Views):
    """All offers scored by a trained model instead of the rules."""
    weighted, total = training.with_weights(frame(v))
    model = training.fit(stage(weighted), 0.75, total)
    scored = training.score_with_model(inputs(v), model)
    return scored.select("offer_id", "model_used", "accept_score")


@report("train_window", """SELECT offer_id FROM offers WHERE cast(substr(offer_id, 5) AS bigint) % 7 IN (0, 3)""")
def train_window(v: Views):
    """Offers inside a month; some lie on its first instant, some on the first instant after it, some before."""
    number = F.substring("offer_id", 5, 20).cast("long") % 7
    at = lambda text: F.lit(text).cast("timestamp")
    moved = v.offers.withColumn("ts", F.when(number == 0, at("2024-03-01 00:00:00")).when(number == 3, at("2024-04-30 23:59:59.999999"))
                                .when(number == 5, at("2024-05-01 00:00:00")).otherwise(at("2024-02-29 23:59:59.999999")))
    return training.in_window(moved, training.train_window("2024-03", 2)).select("offer_id")


TRIED_SQL = f"""bo AS (SELECT o.*, e.af AS actual_fare, e.ak AS actual_km, e.am AS actual_min, weather_factor - 0.5::double AS supply_index FROM offers o LEFT JOIN (SELECT offer_id, max(actual_fare_eur) AS af, max(actual_distance_km) AS ak,
  max(actual_duration_min) AS am FROM order_events GROUP BY 1) e USING (offer_id)),
bs AS (SELECT *, (estimated_fare_eur * 0.75::double - estimated_distance_km * 0.621371::double / 31 * 3.65::double) / (estimated_duration_min / 60) AS h FROM bo),
bt AS (SELECT *, {clamp('h / 20 * 0.55::double + least(demand_index / greatest(supply_index, 0.01) / 3, 1) * 0.3::double + 0.15::double')} AS score FROM bs),
bx AS (SELECT 'copilot' AS strategy, score >= 0.55 AS take, * FROM bt UNION ALL SELECT 'greedy_eur_h', h >= 12, * FROM bt UNION ALL SELECT 'random', substr(md5(offer_id || '|42'), 1, 8) < '99999999', * FROM bt UNION ALL SELECT 'always_accept', true, * FROM bt),
by1 AS (SELECT *, coalesce(actual_fare, 0) AS f, coalesce(actual_km, 0) AS km, CASE WHEN coalesce(actual_min, 1) <= 0 THEN 1 ELSE coalesce(actual_min, 1) END AS mi FROM bx)"""


def tried(v: Views) -> DataFrame:
    actuals = v.order_events.groupBy("offer_id").agg(*[F.max(c).alias(c) for c in ("actual_fare_eur", "actual_distance_km", "actual_duration_min")])
    return v.offers.withColumn("supply_index", F.col("weather_factor") - 0.5).join(actuals, "offer_id", "left")


@report("backtest", f"""WITH {TRIED_SQL} SELECT strategy, count(*) AS total_offers, count(*) FILTER (WHERE take) AS accepted, {r('count(*) FILTER (WHERE take) / count(*)::double', 4)} AS accept_rate,
  {r('sum(f * 0.75::double - km * 0.621371::double / 31 * 3.65::double) FILTER (WHERE take)', 2)} AS net_eur_total, {r('avg((f * 0.75::double - km * 0.621371::double / 31 * 3.65::double) / (mi / 60)) FILTER (WHERE take)', 2)} AS net_eur_h_mean,
  {r('sum(km) FILTER (WHERE take)', 1)} AS km_total, {r('sum(km * 0.621371::double / 31 * 3.65::double) FILTER (WHERE take)', 2)} AS fuel_cost_usd,
  {r('count(*) FILTER (WHERE take) / (count(DISTINCT courier_id) FILTER (WHERE take))::double', 1)} AS trips_per_driver FROM by1 GROUP BY 1""")
def run_backtest(v: Views):
    return backtest.backtest(tried(v))


def known(x: str, low: float = 0.0, high: float = 1.0) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN {clamp(x, low, high)} END"


SCENARIO_SQL = f"""so AS (SELECT o.* REPLACE (CASE WHEN cast(substr(offer_id, 5) AS bigint) % 19 > 0 THEN demand_index END AS demand_index),
  CASE WHEN cast(substr(offer_id, 5) AS bigint) % 23 > 0 THEN weather_factor - 0.5::double END AS supply_index, traffic_factor / 5 AS event_pressure FROM offers o),
sx AS (SELECT s.scenario, o.offer_id, o.courier_id, o.estimated_fare_eur AS fare, o.estimated_distance_km AS km, CASE WHEN s.d IS NULL THEN o.demand_index ELSE {known('o.demand_index * s.d')} END AS demand,
  CASE WHEN s.su IS NULL THEN o.supply_index ELSE {known('o.supply_index * s.su')} END AS supply, CASE WHEN s.w IS NULL THEN o.weather_factor ELSE {known('o.weather_factor + s.w', 0.5, 2.5)} END AS weather,
  CASE WHEN s.t IS NULL THEN o.traffic_factor ELSE {known('o.traffic_factor * s.t', 0.1, 2.0)} END AS traffic, o.estimated_duration_min * coalesce(s.m, 1) AS minutes, coalesce(s.f, 1) AS fuel,
  CASE WHEN s.e IS NULL THEN o.event_pressure ELSE {known('o.event_pressure + s.e')} END AS event FROM so o,
  (VALUES ('baseline', NULL::double, NULL::double, NULL::double, NULL::double, NULL::double, NULL::double, NULL::double), ('heavy_rain', 1.35, NULL, 0.4, 0.75, 1.3, NULL, NULL), ('traffic_jam', NULL, 0.7, NULL, 0.45, 1.8, NULL, NULL),
   ('fuel_spike', NULL, NULL, NULL, NULL, NULL, 1.4, NULL), ('peak_event', 1.5, NULL, NULL, NULL, NULL, NULL, 0.45)) s(scenario, d, su, w, t, m, f, e)),
sy AS (SELECT *, (fare * 0.75::double - km * 0.621371::double / 31 * (3.65::double * fuel)) / (minutes / 60) AS h, CASE WHEN supply IS NOT NULL THEN {known('demand / greatest(supply, 0.01)', 0, 5)} END AS pressure FROM sx)"""


def scenario_offers(v: Views) -> DataFrame:
    """Offers with context columns; some lack their demand or their supply."""
    number = F.substring("offer_id", 5, 20).cast("long")
    return v.offers.withColumns({
        "supply_index": F.when(number % 23 > 0, F.col("weather_factor") - 0.5), "event_pressure": F.col("traffic_factor") / 5.0,
        "temporal_pressure": F.col("demand_index") / 10.0, "demand_index": F.when(number % 19 > 0, F.col("demand_index"))})


@report("scenarios", f"""WITH {SCENARIO_SQL} SELECT scenario, offer_id, {r('demand', 6)} AS demand_index, {r('supply', 6)} AS supply_index, {r('weather', 6)} AS weather_factor, {r('traffic', 6)} AS traffic_factor, {r('event', 6)} AS event_pressure,
  {r('h', 6)} AS estimated_net_eur_h, {r('pressure', 6)} AS pressure_ratio FROM sy""")
def scenarios(v: Views):
    names = ["demand_index", "supply_index", "weather_factor", "traffic_factor", "event_pressure", "estimated_net_eur_h", "pressure_ratio"]
    return backtest.apply_scenarios(scenario_offers(v)).select("scenario", "offer_id", *[round_half_up(c, 6).alias(c) for c in names])


@report("scenario_comparison", f"""WITH {SCENARIO_SQL}, z AS (SELECT *, {clamp('h / 20 * 0.55::double + least(coalesce(demand, 0.5::double) / greatest(coalesce(supply, 0.5::double), 0.01) / 3, 1) * 0.3::double + 0.15::double')} >= 0.55 AS take FROM sy)
SELECT scenario, 'copilot' AS strategy, count(*) AS total_offers, count(*) FILTER (WHERE take) AS accepted, {r('count(*) FILTER (WHERE take) / count(*)::double', 4)} AS accept_rate,
  {r('sum(fare * 0.75::double - km * 0.621371::double / 31 * 3.65::double) FILTER (WHERE take)', 2)} AS net_eur_total, {r('sum(km) FILTER (WHERE take)', 1)} AS km_total FROM z GROUP BY 1""")
def scenario_comparison(v: Views):
    return backtest.compare_scenarios(scenario_offers(v)).select(
        "scenario", "strategy", "total_offers", "accepted", "accept_rate", "net_eur_total", "km_total")
