"""Training data, model, evaluation and quality gate of the acceptance model."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courierworks.functions import context as fx
from courierworks.functions.cost import fuel_cost_plain
from courierworks.functions.num import at_least, clamp, flag, round_half_up
from courierworks.operators.keyed import asof_left, exact_quantile, first_by, join_checked, order_statistics
from courierworks.session import stage

FEATURES = [
    "estimated_fare_eur", "estimated_distance_km", "estimated_duration_min", "demand_index", "supply_index", "weather_factor",
    "traffic_factor", "event_pressure", "event_count_nearby", "weather_precip_mm", "weather_wind_kmh", "weather_intensity",
    "temporal_hour_local", "is_peak_hour", "is_weekend", "is_holiday", "temporal_pressure", "context_fallback_applied",
    "context_stale_sources", "pressure_ratio", "estimated_net_eur_h",
]
SOURCE_WEIGHTS = {"observed_realized": 1.0, "observed_rejected": 1.0, "accepted_proxy": 0.75, "fallback_proxy": 0.55}
C_GRID = [0.35, 0.75, 1.5]


def train_window(start_month: str | None, months: int) -> tuple[datetime, datetime] | None:
    """Half-open window of whole months, or None."""
    if not start_month or months <= 0:
        return None
    try:
        start = datetime.strptime(start_month, "%Y-%m").replace(tzinfo=timezone.utc)
    except ValueError as error:
        raise ValueError(f"start month must look like 2024-03, not {start_month!r}") from error
    index = start.year * 12 + start.month - 1 + months
    return start, start.replace(year=index // 12, month=index % 12 + 1)


def in_window(df: DataFrame, window: tuple[datetime, datetime] | None) -> DataFrame:
    if window is None:
        return df
    return df.where((F.col("ts") >= F.lit(window[0])) & (F.col("ts") < F.lit(window[1])))


def order_outcomes(events: DataFrame) -> DataFrame:
    """Per offer: whether it was accepted, rejected, dropped off, and the highest actual fare above 0."""
    happened = lambda word: F.max((F.col("status") == word).cast("int"))
    return events.where(F.col("offer_id") != "").groupBy("offer_id").agg(
        happened("accepted").alias("accepted_flag"), happened("rejected").alias("rejected_flag"),
        happened("dropped_off").alias("dropped_off_flag"), F.max(F.nullif("actual_fare_eur", F.lit(0.0))).alias("actual_fare_eur"))


def training_frame(offers: DataFrame, events: DataFrame, signals: DataFrame, window_minutes: int = 30, quantile: float = 0.6,
                   min_eur_h: float = 14.0, window: tuple[datetime, datetime] | None = None,
                   hot_rows: int = 1_000_000) -> DataFrame:
    """One labelled row per offer: features at the time of the offer, outcome, threshold and label source."""
    first = first_by(in_window(offers, window).where(F.col("offer_id") != ""), ["offer_id"], "ts", "courier_id")
    context = signals.where("zone_id <> '' AND supply_index IS NOT NULL").select(
        "zone_id", F.col("ts").alias("ctx_ts"), "event_id", F.col("supply_index").alias("supply_ctx"))
    rows = asof_left(first.select("offer_id", "courier_id", "zone_id", "ts", *FEATURES[:4], "weather_factor", "traffic_factor"), context,
                     "zone_id", "ts", "ctx_ts", "event_id", ["supply_ctx", "ctx_ts"], hot_rows=hot_rows)
    rows = rows.where("estimated_fare_eur IS NOT NULL AND estimated_distance_km IS NOT NULL AND estimated_duration_min IS NOT NULL AND ts IS NOT NULL")
    rows = rows.join(order_outcomes(in_window(events, window)), "offer_id", "left")
    c, one = F.col, F.lit(1.0)
    age = (F.unix_micros("ts") - F.unix_micros("ctx_ts")) / 1e6
    rows = rows.withColumns({
        **{f"{k}_flag": F.coalesce(f"{k}_flag", F.lit(0)) for k in ("accepted", "rejected", "dropped_off")},
        "estimated_duration_min": at_least("estimated_duration_min", 1.0), "demand_index": F.coalesce("demand_index", one),
        "weather_factor": F.coalesce("weather_factor", one), "traffic_factor": F.coalesce("traffic_factor", one), "context_age_s": age})
    fresh = F.coalesce((c("context_age_s") >= 0) & (c("context_age_s") <= float(max(1, window_minutes) * 60)), F.lit(False))
    hour, weekend, holiday = fx.local_hour(c("ts")), fx.is_weekend(c("ts")), fx.is_holiday(c("ts"))
    rows = rows.withColumns({
        "context_fallback_applied": flag(~fresh), "supply_index": at_least(F.when(fresh, c("supply_ctx")).otherwise(one), 0.2),
        "context_stale_sources": F.when(fresh, 0.0).when(c("context_age_s").isNull(), 3.0).when(c("context_age_s") <= 7200, 1.0)
        .when(c("context_age_s") <= 21600, 2.0).otherwise(3.0),
        "temporal_hour_local": hour, "is_peak_hour": flag(fx.is_peak(hour)), "is_weekend": flag(weekend), "is_holiday": flag(holiday),
        "weather_intensity": clamp((c("weather_factor") - 0.95) / 0.45)})
    midday = (c("temporal_hour_local") >= 11) & (c("temporal_hour_local") < 14)
    rows = rows.withColumn("temporal_pressure", c("is_peak_hour") * 0.14 + flag(midday) * 0.05 + c("is_weekend") * 0.08 + c("is_holiday") * 0.12)
    event = clamp(F.least(at_least(c("demand_index") - 1.0, 0.0) / 0.9, one) * 0.65
                  + F.least(c("temporal_pressure"), F.lit(0.35)) / 0.35 * 0.25 + c("weather_intensity") * 0.10)
    fuel, minutes = fuel_cost_plain("estimated_distance_km"), c("estimated_duration_min")
    hourly = lambda fare: (c(fare) * 0.75 - fuel) / minutes * 60.0
    rows = rows.withColumns({
        "weather_precip_mm": c("weather_intensity") * 6.0, "weather_wind_kmh": 8.0 + c("weather_intensity") * 42.0, "event_pressure": event,
        "estimated_net_eur_h": hourly("estimated_fare_eur"), "realized_net_eur_h": hourly("actual_fare_eur"),
        "pressure_ratio": c("demand_index") / c("supply_index")})
    rows = rows.withColumns({
        "event_count_nearby": clamp(F.rint(c("event_pressure") * 5.0), 0.0, 8.0),
        "__target": F.coalesce("realized_net_eur_h", "estimated_net_eur_h"),
        "month": F.date_format(F.from_utc_timestamp("ts", fx.NEW_YORK), "yyyy-MM")})
    rows = stage(rows)  # the quantile below and the label join read it several times
    limits = exact_quantile(rows, ["month"], "__target", min(max(float(quantile), 0.05), 0.95), "__q")
    rows = join_checked(rows, limits, ["month"], "left").withColumn("label_threshold_eur_h", at_least("__q", float(min_eur_h)))
    rejected = c("rejected_flag") == 1
    realised = (c("dropped_off_flag") == 1) & c("realized_net_eur_h").isNotNull()
    reached = (c("__target") >= c("label_threshold_eur_h")).cast("int")
    return rows.withColumns({
        "label": F.when(rejected, 0).otherwise(reached),
        "label_source": F.when(rejected, "observed_rejected").when(realised, "observed_realized")
        .when(c("accepted_flag") == 1, "accepted_proxy").otherwise("fallback_proxy"),
    }).drop("__q", "__target", "supply_ctx", "ctx_ts")


def training_summary(frame: DataFrame) -> DataFrame:
    """Rows, positive rate and median threshold, for all rows and per label source."""
    median = order_statistics(frame, [], "label_threshold_eur_h", {"a": lambda n: F.floor((n - 1) / 2), "b": lambda n: F.floor(n / 2)})
    figures = [F.count("*").alias("rows"), round_half_up(F.avg("label"), 6).alias("positive_rate")]
    both = frame.groupBy("label_source").agg(*figures).unionByName(frame.agg(*figures).withColumn("label_source", F.lit("all")))
    value = median.select(F.lit(1).alias("__one"), round_half_up((F.col("a") + F.col("b")) / 2.0, 6).alias("median_threshold_eur_h"))
    return both.withColumn("__one", F.lit(1)).join(F.broadcast(value), "__one").drop("__one")


def temporal_split(frame: DataFrame, test_size: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """The oldest rows for training, the newest share for testing; equal times are cut by offer id."""
    share = min(max(float(test_size), 0.1), 0.4)
    rows = frame.dropna(subset=[*FEATURES, "label"]).withColumn("__us", F.unix_micros("ts"))
    total = rows.count()
    if total < 20:
        raise ValueError("not enough rows to train a model")
    cut_at = max(1, min(int(total * (1.0 - share)), total - 1))
    cut = order_statistics(rows, [], "__us", {"us": lambda n: F.lit(cut_at)}).first()["us"]
    earlier = rows.where(F.col("__us") < cut).count()
    tied = rows.where(F.col("__us") == cut).select("offer_id").orderBy("offer_id").limit(cut_at - earlier)
    in_tie = join_checked(rows.where(F.col("__us") == cut), tied, ["offer_id"], "left_semi")
    out_tie = join_checked(rows.where(F.col("__us") == cut), tied, ["offer_id"], "left_anti")
    train = rows.where(F.col("__us") < cut).unionByName(in_tie).drop("__us")
    return train, rows.where(F.col("__us") > cut).unionByName(out_tie).drop("__us")


def with_weights(train: DataFrame) -> tuple[DataFrame, float]:
    """Rows with class-balanced source weights, and their sum."""
    counts = {row["label"]: row["n"] for row in train.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    total, classes = sum(counts.values()), len(counts)
    if classes < 2:
        raise ValueError("both labels are needed")
    balance = F.when(F.col("label") == 1, total / (classes * counts[1])).otherwise(total / (classes * counts[0]))
    source = F.create_map(*[x for k, v in SOURCE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    weighted = train.withColumn("weight", balance * F.coalesce(F.try_element_at(source, F.col("label_source")), F.lit(1.0)))
    return weighted, float(weighted.agg(F.sum("weight")).first()[0])


def fit(weighted: DataFrame, c_value: float, weight_sum: float) -> PipelineModel:
    """Standardised L2 logistic regression; Spark's penalty is per unit of weight, so it is 1 / (C * sum of weights)."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True, withStd=True),
        LogisticRegression(featuresCol="__scaled", labelCol="label", weightCol="weight", regParam=1.0 / (c_value * weight_sum),
                           elasticNetParam=0.0, standardization=False, maxIter=200, probabilityCol="__p", rawPredictionCol="__r",
                           predictionCol="__y"),
    ]).fit(weighted)


def probabilities(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with the model's probability of the positive label in `p`."""
    ready = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES})
    return model.transform(ready).withColumn("p", vector_to_array("__p")[1]).drop("__raw", "__scaled", "__p", "__r", "__y")


def train_model(frame: DataFrame, test_size: float = 0.2, grid: list[float] | None = None) -> tuple[PipelineModel, dict]:
    """Fit on the older rows, choose C by the newer ones, and report the metrics."""
    train, test = temporal_split(frame, test_size)
    weighted, weight_sum = with_weights(train)
    weighted, test = stage(weighted), stage(test)  # every iteration of every fit reads them
    candidates, best, best_score = [], None, float("-inf")
    for c_value in grid or C_GRID:
        model = fit(weighted, c_value, weight_sum)
        m = evaluate(probabilities(model, test)).first().asDict()
        combo = 0.55 * m["roc_auc"] + 0.35 * m["average_precision"] + 0.10 * (1.0 - m["brier_score"])
        candidates.append({"c": c_value, "combo_score": combo, **{k: m[k] for k in ("roc_auc", "average_precision", "brier_score")}})
        if combo > best_score:
            best, best_score, metrics = model, combo, {**m, "best_logreg_c": c_value}
    metrics["candidate_metrics"] = candidates
    metrics["quality_flags"] = [name for name, bad in [
        ("temporal_auc_extremely_high", metrics["roc_auc"] >= 0.995), ("calibration_warning", metrics["ece_10_bins"] > 0.08)] if bad]
    return best, metrics


def score_steps(scored: DataFrame, bins: int = 4096) -> DataFrame:
    """Per distinct score `p`: positives and negatives there and above it.

    Scores are counted first; the running sums go over bins, then inside each bin, so no task holds all scores.
    """
    counts = scored.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin"), "p").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    totals = counts.groupBy("bin").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    over = Window.orderBy(F.desc("bin"))  # at most `bins` rows
    above = totals.select("bin", (F.sum("bp").over(over) - F.col("bp")).alias("ap"), (F.sum("bn").over(over) - F.col("bn")).alias("an"))
    inside = Window.partitionBy("bin").orderBy(F.desc("p"))
    return counts.join(F.broadcast(above), "bin").select(
        "p", "pos", "neg", (F.col("ap") + F.sum("pos").over(inside)).alias("tp"), (F.col("an") + F.sum("neg").over(inside)).alias("fp"))


def evaluate(scored: DataFrame) -> DataFrame:
    """One row of exact metrics of scored rows (label, p)."""
    steps = score_steps(scored)
    c, pos = F.col, F.col("label") == 1
    hit = c("p") >= 0.5
    area = F.sum(c("neg") * ((c("tp") - c("pos")) + c("pos") * 0.5))
    ranks = steps.agg(area.alias("area"), F.sum(c("pos") * (c("tp") / (c("tp") + c("fp")))).alias("ap"),
                      F.sum("pos").alias("P"), F.sum("neg").alias("N")).withColumn("__one", F.lit(1))
    plain = scored.agg(
        F.count("*").alias("rows"), F.count_if(hit & pos).alias("a"), F.count_if(hit).alias("b"),
        F.avg(F.pow(c("p") - c("label"), F.lit(2.0))).alias("brier_score"), F.avg("label").alias("positive_rate")).withColumn("__one", F.lit(1))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))
    precision, recall = ratio(c("a"), c("b")), ratio(c("a"), c("P"))
    return ranks.join(plain, "__one").join(calibration_error(scored).withColumn("__one", F.lit(1)), "__one").select(
        "rows", "positive_rate", ratio(c("area"), c("P") * c("N")).alias("roc_auc"), ratio(c("ap"), c("P")).alias("average_precision"),
        precision.alias("precision_at_0_5"), recall.alias("recall_at_0_5"),
        ratio(2.0 * precision * recall, precision + recall).alias("f1_at_0_5"), "brier_score", "ece_10_bins")


def calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins between the smallest and the largest score."""
    ends = scored.agg(F.min("p").alias("__lo"), F.max("p").alias("__hi"), F.count("*").alias("__n")).withColumn("__one", F.lit(1))
    rows = scored.withColumn("__one", F.lit(1)).join(F.broadcast(ends), "__one")
    place = (F.col("p") - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)) * bins
    number = F.greatest(F.least(F.ceil(F.coalesce(place, F.lit(1.0))) - 1, F.lit(bins - 1)), F.lit(0))
    per_bin = rows.groupBy(number.alias("bin")).agg(F.avg("p").alias("conf"), F.avg("label").alias("acc"), F.count("*").alias("m"), F.first("__n").alias("n"))
    return per_bin.agg(F.sum(F.col("m") / F.col("n") * F.abs(F.col("conf") - F.col("acc"))).alias("ece_10_bins"))


def curves(scored: DataFrame) -> DataFrame:
    """Points of the ROC and precision-recall curves, one per distinct score."""
    steps = score_steps(scored)
    ends = F.broadcast(steps.agg(F.sum("pos").cast("double").alias("__pos"), F.sum("neg").cast("double").alias("__neg")).withColumn("__one", F.lit(1)))
    return steps.withColumn("__one", F.lit(1)).join(ends, "__one").select(
        "p", (F.col("fp") / F.nullif("__neg", F.lit(0.0))).alias("fpr"), (F.col("tp") / F.nullif("__pos", F.lit(0.0))).alias("tpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def calibration_bins(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and observed rate in bins of equal size, cut at the exact quantiles of the score."""
    ranks = {f"q{i}": (lambda i: lambda n: F.floor(n * i / bins))(i) for i in range(1, bins)}
    cuts = order_statistics(scored, [], "p", ranks).first()  # one row
    number = sum(((F.col("p") >= F.lit(cuts[f"q{i}"])).cast("int") for i in range(1, bins)), F.lit(0))
    return scored.groupBy(number.alias("bin")).agg(F.avg("p").alias("mean_score"), F.avg("label").alias("observed_rate"), F.count("*").alias("rows"))


def feature_importance(model: PipelineModel, spark) -> DataFrame:
    weights = [float(w) for w in model.stages[-1].coefficients.toArray()]
    return spark.createDataFrame(list(zip(FEATURES, weights)), "feature string, coefficient double").withColumn(
        "importance", F.abs("coefficient")).orderBy(F.desc("importance"), "feature")


def quality_gate(metrics: DataFrame, min_auc: float = 0.6, min_average_precision: float = 0.45, min_rows: int = 200) -> DataFrame:
    """Metrics rows with `accepted` and the first reason against."""
    c = F.col
    number = lambda name: F.format_string("%.4f", c(name))
    reason = (
        F.when(c("rows") < min_rows, F.concat(F.lit("trained_rows_below_min:"), c("rows").cast("string"), F.lit(f"<{min_rows}")))
        .when(c("roc_auc").isNull(), "missing_metric_roc_auc").when(c("average_precision").isNull(), "missing_metric_average_precision")
        .when(c("roc_auc") < min_auc, F.concat(F.lit("roc_auc_below_min:"), number("roc_auc"), F.lit(f"<{min_auc:.4f}")))
        .when(c("average_precision") < min_average_precision,
              F.concat(F.lit("avg_precision_below_min:"), number("average_precision"), F.lit(f"<{min_average_precision:.4f}")))
        .otherwise("ok"))
    return metrics.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "ok")


def score_with_model(offers: DataFrame, model: PipelineModel | None, profiles: DataFrame | None = None) -> DataFrame:
    """Scored offers whose score is the model's probability, or the heuristic without a model."""
    from courierworks.functions.scoring import add_features
    from courierworks.operators.offers import score_offers

    if model is None:
        return score_offers(offers, profiles)
    p: Column = F.col("p")
    return score_offers(probabilities(model, add_features(offers)), profiles, model_score=p)
