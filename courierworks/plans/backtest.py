"""Backtest of acceptance strategies and what-if scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierworks.functions.cost import FUEL_PRICE_USD_GALLON, KM_TO_MILES, VEHICLE_MPG, fuel_cost_plain, net_eur
from courierworks.functions.num import at_least, clamp, clamp_known, ratio, round_half_up

STRATEGIES = ["copilot", "greedy_eur_h", "random", "always_accept"]
COPILOT_MIN, GREEDY_MIN_EUR_H, RANDOM_SHARE = 0.55, 12.0, 0.6

# The modifiers of the scenarios.
SCENARIOS = {
    "baseline": {},
    "heavy_rain": {"demand_index_mul": 1.35, "weather_factor_add": 0.40, "weather_precip_mm_add": 22.0,
                   "weather_intensity_add": 0.55, "traffic_factor_mul": 0.75, "estimated_duration_min_mul": 1.30},
    "traffic_jam": {"traffic_factor_mul": 0.45, "estimated_duration_min_mul": 1.80, "supply_index_mul": 0.70},
    "fuel_spike": {"fuel_price_mul": 1.40},
    "peak_event": {"demand_index_mul": 1.50, "event_pressure_add": 0.45, "event_count_nearby_add": 6.0, "temporal_pressure_add": 0.35},
}
# Lower and upper bounds after a modifier.
BOUNDS = {"demand_index": (0.0, 1.0), "supply_index": (0.0, 1.0), "weather_factor": (0.5, 2.5), "weather_intensity": (0.0, 1.0),
          "traffic_factor": (0.1, 2.0), "event_pressure": (0.0, 1.0), "temporal_pressure": (0.0, 1.0)}


def chance(key: Column, seed: int, share: float) -> Column:
    """True for about `share` of the keys, the same ones on every run and partitioning."""
    limit = f"{int(share * 2**32):08x}"
    return F.substring(F.md5(F.concat_ws("|", key, F.lit(str(seed)))), 1, 8) < F.lit(limit)


def hourly_net(fare: Column, km: Column, minutes: Column) -> Column:
    return net_eur(fare, km) / (F.when(minutes <= 0, 1.0).otherwise(minutes) / 60.0)


def copilot_score() -> Column:
    """The rule score of the backtest, from the columns estimated_net_eur_h, demand_index and supply_index."""
    pressure = F.coalesce("demand_index", F.lit(0.5)) / at_least(F.coalesce("supply_index", F.lit(0.5)), 0.01)
    return clamp(F.coalesce("estimated_net_eur_h", F.lit(0.0)) / 20.0 * 0.55 + F.least(pressure / 3.0, F.lit(1.0)) * 0.30 + 0.15)


def backtest(offers: DataFrame, groups: list[str] | None = None, score: Column | None = None, seed: int = 42,
             strategies: list[str] | None = None) -> DataFrame:
    """Key figures per strategy (and group).

    Actual fare, distance and duration replace the estimates where any accepted offer of the strategy
    has them. Sums are first taken per courier, so that counting couriers needs no distinct pass.
    """
    groups, strategies = groups or [], strategies or STRATEGIES
    parts = {"fare": ("actual_fare_eur", "estimated_fare_eur", 0.0), "km": ("actual_distance_km", "estimated_distance_km", 0.0),
             "minutes": ("actual_duration_min", "estimated_duration_min", 1.0)}
    estimate = lambda name: F.coalesce(parts[name][1], F.lit(parts[name][2]))
    actual = lambda name: F.coalesce(parts[name][0], F.lit(parts[name][2])) if parts[name][0] in offers.columns else estimate(name)
    with_net = offers if "estimated_net_eur_h" in offers.columns else offers.withColumn(
        "estimated_net_eur_h", hourly_net(estimate("fare"), estimate("km"), estimate("minutes")))
    greedy = hourly_net(estimate("fare"), F.coalesce("estimated_distance_km", F.lit(1.0)), F.coalesce("estimated_duration_min", F.lit(1.0)))
    takes = {"copilot": (score if score is not None else copilot_score()) >= COPILOT_MIN, "greedy_eur_h": greedy >= GREEDY_MIN_EUR_H,
             "random": chance(F.col("offer_id"), seed, RANDOM_SHARE), "always_accept": F.lit(True)}
    rows = with_net.select(
        *groups, "courier_id",
        *[x.alias(f"a_{n}") for n in parts for x in [actual(n)]], *[estimate(n).alias(f"e_{n}") for n in parts],
        *[(F.col(parts[n][0]).isNotNull() if parts[n][0] in offers.columns else F.lit(False)).alias(f"has_{n}") for n in parts],
        F.array(*[F.struct(F.lit(s).alias("strategy"), takes[s].alias("take")) for s in strategies]).alias("__s"))
    rows = rows.withColumn("__s", F.explode("__s")).select("*", "__s.strategy", F.coalesce("__s.take", F.lit(False)).alias("take")).drop("__s")
    on = [*groups, "strategy"]
    when = lambda x: F.when(F.col("take"), x)
    # fare and distance enter the hourly figure linearly, so sums per kind of duration are enough.
    sums = {f"{a}_{n}": F.sum(when(F.col(f"{a}_{n}"))) for a in "ae" for n in ("fare", "km")}
    for d in "ae":
        hours = F.when(F.col(f"{d}_minutes") <= 0, 1.0).otherwise(F.col(f"{d}_minutes")) / 60.0
        sums |= {f"{a}_{n}_per_{d}": F.sum(when(F.col(f"{a}_{n}") / hours)) for a in "ae" for n in ("fare", "km")}
    per_courier = rows.groupBy(*on, "courier_id").agg(
        F.count("*").alias("offers"), F.count_if("take").alias("taken"),
        *[F.count_if(F.col("take") & F.col(f"has_{n}")).alias(f"n_{n}") for n in parts], *[x.alias(n) for n, x in sums.items()])
    total = per_courier.groupBy(*on).agg(
        F.sum("offers").alias("total_offers"), F.sum("taken").alias("accepted"), F.count_if((F.col("taken") > 0) & F.col("courier_id").isNotNull()).alias("drivers"),
        *[F.sum(n).alias(n) for n in [f"n_{p}" for p in parts] + list(sums)])
    c = F.col
    use = lambda n: c(f"n_{n}") > 0
    pick = lambda n: F.when(use(n), c(f"a_{n}")).otherwise(c(f"e_{n}"))
    per = lambda n: F.when(use("minutes"), F.when(use(n), c(f"a_{n}_per_a")).otherwise(c(f"e_{n}_per_a"))).otherwise(
        F.when(use(n), c(f"a_{n}_per_e")).otherwise(c(f"e_{n}_per_e")))
    zero = lambda x, digits: round_half_up(F.coalesce(x, F.lit(0.0)), digits)
    n = c("accepted").cast("double")
    return total.select(
        *on, "total_offers", "accepted", zero(ratio(n, c("total_offers").cast("double")), 4).alias("accept_rate"),
        zero(net_eur(pick("fare"), pick("km")), 2).alias("net_eur_total"),
        zero(ratio(net_eur(per("fare"), per("km")), n), 2).alias("net_eur_h_mean"), zero(pick("km"), 1).alias("km_total"),
        zero(fuel_cost_plain(pick("km")), 2).alias("fuel_cost_usd"), zero(n / F.greatest(c("drivers"), F.lit(1)), 1).alias("trips_per_driver"))


def apply_scenarios(offers: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Every offer once per scenario, with the modified inputs, net per hour and pressure."""
    names = names or list(SCENARIOS)
    keys = sorted({k for s in SCENARIOS.values() for k in s})
    neutral = lambda key: 1.0 if key.endswith("_mul") else 0.0
    table = F.array(*[F.struct(F.lit(name).alias("scenario"), *[F.lit(SCENARIOS[name].get(k, neutral(k))).alias(k) for k in keys],
                               *[F.lit(k in SCENARIOS[name]).alias(f"has_{k}") for k in keys]) for name in names])
    rows = offers.withColumn("__m", F.explode(table)).withColumn("scenario", F.col("__m.scenario"))
    changes = {}
    for key in keys:
        name, kind = key.rsplit("_", 1)
        if name == "fuel_price":
            continue
        targets = [name] + (["actual_duration_min"] if name == "estimated_duration_min" else [])
        for target in targets:
            if target not in offers.columns:
                continue
            value = F.col(target) * F.col(f"__m.{key}") if kind == "mul" else F.col(target) + F.col(f"__m.{key}")
            if target in BOUNDS:
                value = clamp_known(value, *BOUNDS[target])
            changes[target] = F.when(F.col(f"__m.has_{key}"), value).otherwise(F.col(target))
    rows = rows.withColumns(changes)
    or_one = lambda name: F.coalesce(F.nullif(F.col(name), F.lit(0.0)), F.lit(1.0))
    fare, km, minutes = F.coalesce("estimated_fare_eur", F.lit(0.0)), or_one("estimated_distance_km"), or_one("estimated_duration_min")
    dear = (fare * 0.75 - km * KM_TO_MILES / VEHICLE_MPG * (FUEL_PRICE_USD_GALLON * F.col("__m.fuel_price_mul"))) / (at_least(minutes, 1.0) / 60.0)
    return rows.withColumns({
        "estimated_net_eur_h": F.when(F.col("__m.fuel_price_mul") != 1.0, dear).otherwise(hourly_net(fare, km, minutes)),
        "pressure_ratio": F.when(F.col("supply_index").isNotNull(), clamp_known(F.col("demand_index") / at_least("supply_index", 0.01), 0.0, 5.0))}).drop("__m")


def compare_scenarios(offers: DataFrame) -> DataFrame:
    """Key figures of the copilot strategy under every scenario."""
    return backtest(apply_scenarios(offers), ["scenario"], strategies=["copilot"])
