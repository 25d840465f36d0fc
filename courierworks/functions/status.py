"""Courier status, route tags and source metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courierworks.functions.num import ColumnLike, col_of, finite

# The status words and their aliases.
POSITION_STATUSES = ["available", "delivering", "idle", "pickup_assigned", "pickup_en_route", "pickup_arrived",
                     "repositioning", "unknown"]
MOVING_STATUSES = ["delivering", "pickup_assigned", "pickup_en_route", "pickup_arrived", "repositioning"]
PICKUP_STATUSES = ["pickup_arrived", "pickup_assigned", "pickup_en_route"]
DELIVERING_ALIASES = ["delivering", "on_trip", "busy"]
AVAILABLE_ALIASES = ["available", "ready", "waiting_order"]
IDLE_ALIASES = ["idle", "offline", "paused"]
TRUE_WORDS = ["1", "true", "yes", "y", "on"]
FALSE_WORDS = ["0", "false", "no", "n", "off"]


def tidy(value: ColumnLike) -> Column:
    """Trimmed lower-case text, empty string for NULL."""
    return F.lower(F.trim(F.coalesce(col_of(value).cast("string"), F.lit(""))))


def canonical_status(status: ColumnLike) -> Column:
    word = tidy(status)
    return (
        F.when(word.isin(DELIVERING_ALIASES), "delivering")
        .when(word.isin(AVAILABLE_ALIASES), "available")
        .when(word.isin(IDLE_ALIASES), "idle")
        .when(word == "", "unknown")
        .otherwise(word)
    )


def status_bucket(status: ColumnLike) -> Column:
    word = canonical_status(status)
    return (
        F.when(word.isin("available", "delivering", "repositioning", "idle"), word)
        .when(word.isin(PICKUP_STATUSES), "pickup")
        .otherwise("unknown")
    )


def route_source(platform: ColumnLike) -> Column:
    """The `route=` part of a platform tag such as `name|route=osrm`; 'unknown' when there is none."""
    found = F.trim(F.regexp_extract(tidy(platform), r"(?:^|\|)route=([^|]*)", 1))
    return F.when(found == "", "unknown").otherwise(found)


def with_route(platform: ColumnLike, route: ColumnLike) -> Column:
    """Platform tag with its route part replaced."""
    base = F.regexp_replace(F.coalesce(col_of(platform), F.lit("")), r"\|route=[^|]*", "")
    return F.concat(base, F.lit("|route="), F.lower(F.trim(col_of(route))))


def metadata_tag(source: ColumnLike) -> Column:
    return F.trim(F.split_part(F.coalesce(col_of(source), F.lit("")), F.lit(";"), F.lit(1)))


def metadata_map(source: ColumnLike) -> Column:
    """`tag;key=value;…` as a map with lower-case keys; items without `=` or without a key are left out."""
    pairs = F.transform(
        F.filter(F.split(F.coalesce(col_of(source), F.lit("")), ";"), lambda item, i: (i > 0) & F.trim(item).rlike(r"^\s*[^=\s][^=]*=")),
        lambda item: F.struct(
            F.lower(F.trim(F.split_part(item, F.lit("="), F.lit(1)))).alias("key"),
            F.trim(F.regexp_replace(item, r"^[^=]*=", "")).alias("value"),
        ),
    )
    # A repeated key keeps its last value: an entry goes when a later one has the same key.
    last = F.filter(
        pairs,
        lambda pair, i: F.size(F.filter(F.slice(pairs, i + 2, F.size(pairs) + 1),
                                        lambda later: later["key"] == pair["key"])) == 0,
    )
    return F.map_from_entries(last)


def metadata_number(meta: Column, key: str, default: float = 0.0, low: float | None = None,
                    high: float | None = None) -> Column:
    value = finite(meta[key], default)
    if low is not None:
        value = F.greatest(value, F.lit(low))
    if high is not None:
        value = F.least(value, F.lit(high))
    return value


def metadata_count(meta: Column, key: str, default: int = 0, low: int | None = None, high: int | None = None) -> Column:
    value = F.coalesce(F.trim(meta[key]).try_cast("long"), F.lit(default).cast("long"))
    if low is not None:
        value = F.greatest(value, F.lit(low).cast("long"))
    if high is not None:
        value = F.least(value, F.lit(high).cast("long"))
    return value


def truthy(value: ColumnLike, default: bool = False) -> Column:
    word = tidy(value)
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False).otherwise(F.lit(default))


def metadata_flag(meta: Column, key: str) -> Column:
    return F.when(truthy(meta[key]), 1).otherwise(0).cast("long")


def build_metadata(tag: ColumnLike, values: dict[str, Column], kinds: dict[str, str]) -> Column:
    """Inverse of `metadata_map`: sorted keys, flags as 1/0, decimals with at most four digits.

    `kinds` gives 'flag', 'decimal' or 'text' per key; NULL values are left out.
    """
    parts = [F.coalesce(F.nullif(F.trim(col_of(tag)), F.lit("")), F.lit("none"))]
    for key in sorted(values):
        value, kind = values[key], kinds[key]
        if kind == "flag":
            text = F.when(value, "1").when(~value, "0")
        elif kind == "decimal":
            text = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", value), r"0+$", ""), r"\.$", "")
            text = F.when(value.isNotNull(), text)
        else:
            text = F.nullif(F.trim(value.cast("string")), F.lit(""))
        parts.append(F.concat(F.lit(f"{key}="), text))
    return F.concat_ws(";", *parts)
