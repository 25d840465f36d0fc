"""Fuel cost and net revenue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courierworks.functions.num import ColumnLike, at_least, col_of

# Fixed values.
KM_TO_MILES = 0.621371
MILES_TO_KM = 1.60934
FUEL_PRICE_USD_GALLON = 3.65
VEHICLE_MPG = 31.0
PLATFORM_FEE_PCT = 25.0


def fuel_cost_usd(km: ColumnLike, mpg: ColumnLike = VEHICLE_MPG, price: ColumnLike = FUEL_PRICE_USD_GALLON) -> Column:
    return at_least(km, 0.0) * KM_TO_MILES / at_least(mpg, 1.0) * at_least(price, 0.0)


def fuel_cost_plain(km: ColumnLike) -> Column:
    """Fuel cost at the standard price and consumption, for distances as they are."""
    return col_of(km) * KM_TO_MILES / VEHICLE_MPG * FUEL_PRICE_USD_GALLON


def net_eur(fare: ColumnLike, km: ColumnLike) -> Column:
    """Fare after the platform fee and fuel."""
    return col_of(fare) * (1.0 - PLATFORM_FEE_PCT / 100.0) - fuel_cost_plain(km)


def net_eur_h(fare: ColumnLike, km: ColumnLike, minutes: ColumnLike) -> Column:
    """Net per hour, not below zero; 0 without a duration."""
    minutes = col_of(minutes)
    return F.when(minutes > 0, at_least(net_eur(fare, km) / (minutes / 60.0), 0.0)).otherwise(F.lit(0.0))
