"""Named reports over the test tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from courierworks.sources.adapters import Views, check_sql

REPORTS: dict[str, Callable[[Views], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def report(name: str, sql: str | None = None):
    """Register a report; `sql` computes the same rows in another engine, None where SQL cannot."""

    def register(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in REPORTS:
            raise ValueError(f"report {name} is registered twice")
        REPORTS[name] = fn
        if sql is not None:
            CHECKS[name] = check_sql(sql)
        return fn

    return register


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return REPORTS[name](Views(spark, folder))


def r(expr: str, digits: int) -> str:
    """Text of the rounding used in checks: the same doubles as `round_half_up`."""
    scale = f"{10.0 ** digits:.1f}"
    return f"(floor(({expr}) * cast({scale} as double) + cast(0.5 as double)) / cast({scale} as double))"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Text of the great-circle distance in kilometres."""
    return (
        f"(12742.0::double * asin(sqrt((power(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1}))"
        f" * cos(radians({lat2})) * power(sin(radians(({lon2}) - ({lon1})) / 2), 2)))))"
    )
