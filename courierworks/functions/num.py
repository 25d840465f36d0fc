"""Small numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str | float | int
LARGEST = 1.7976931348623157e308


def col_of(value: ColumnLike) -> Column:
    """A column from a name, a column or a number."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def round_half_up(value: ColumnLike, digits: int = 0) -> Column:
    """Scaled rounding with ties going up; unlike `F.round` it gives the same double in other engines."""
    scale = float(10**digits)
    return F.floor(col_of(value) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def at_least(value: ColumnLike, low: ColumnLike) -> Column:
    return F.greatest(col_of(value), col_of(low))


def at_most(value: ColumnLike, high: ColumnLike) -> Column:
    return F.least(col_of(value), col_of(high))


def clamp(value: ColumnLike, low: ColumnLike = 0.0, high: ColumnLike = 1.0) -> Column:
    """The value within the bounds, for values that are never NULL (`clamp_known` is for those that may be)."""
    return at_least(at_most(value, high), low)


def clamp_known(value: ColumnLike, low: ColumnLike = 0.0, high: ColumnLike = 1.0) -> Column:
    """The value within the bounds; NULL stays NULL."""
    return F.when(col_of(value).isNotNull(), clamp(value, low, high))


def finite(value: ColumnLike, default: ColumnLike | None = None) -> Column:
    """The value as a finite double; missing, unparseable, NaN and infinite values become `default`."""
    number = col_of(value).try_cast("double")
    fallback = F.lit(None).cast("double") if default is None else col_of(default)
    # NaN sorts above every number in Spark, so one comparison rules out NaN, infinities and NULL.
    return F.when(F.abs(number) <= F.lit(LARGEST), number).otherwise(fallback)


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, else 0.0 (also for unknown)."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def ratio(top: ColumnLike, bottom: ColumnLike) -> Column:
    """Division that gives NULL for a zero denominator."""
    return col_of(top) / F.nullif(col_of(bottom), F.lit(0.0))
