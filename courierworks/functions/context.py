"""City context: time of day, weather, events, closures, speeds, boroughs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierworks.functions.num import ColumnLike, at_least, clamp, col_of, flag, round_half_up
from courierworks.functions.status import tidy

NEW_YORK = "America/New_York"

# Borough names, their aliases and centres.
BOROUGH_CENTRES = {
    "manhattan": (40.7831, -73.9712),
    "brooklyn": (40.6782, -73.9442),
    "queens": (40.7282, -73.7949),
    "bronx": (40.8448, -73.8648),
    "staten_island": (40.5795, -74.1502),
}
BOROUGH_ALIASES = {
    "manhattan": ["manhattan", "mn", "m", "new york"],
    "brooklyn": ["brooklyn", "bk", "k"],
    "queens": ["queens", "qn", "q"],
    "bronx": ["bronx", "bx", "x"],
    "staten_island": ["staten island", "staten_island", "si", "r"],
}
# In a longer text the first of these that occurs gives the borough.
BOROUGH_TOKENS = [("staten island", "staten_island"), ("manhattan", "manhattan"), ("new york", "manhattan"),
                  ("brooklyn", "brooklyn"), ("queens", "queens"), ("bronx", "bronx")]
EVENT_CLASSES = [
    (1.25, ["parade", "festival", "fair", "concert", "marathon", "carnival"]),
    (1.1, ["street", "block party", "community", "cultural"]),
    (0.95, ["sport", "baseball", "soccer", "basketball", "tournament"]),
]


def normalize_borough(value: ColumnLike) -> Column:
    word = tidy(value)
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for borough, aliases in BOROUGH_ALIASES.items():
        chain = chain.when(word.isin(aliases), borough)
    return chain


def infer_borough(text: ColumnLike) -> Column:
    body = F.translate(tidy(text), "/-_", "   ")
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for token, borough in BOROUGH_TOKENS:
        chain = chain.when(body.contains(token), borough)
    return chain


def borough_centre(borough: ColumnLike) -> tuple[Column, Column]:
    lat = lon = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, (y, x) in BOROUGH_CENTRES.items():
        lat, lon = lat.when(col_of(borough) == name, y), lon.when(col_of(borough) == name, x)
    return lat, lon


def _any(body: Column, tokens: list[str]) -> Column:
    hit = body.contains(tokens[0])
    for token in tokens[1:]:
        hit = hit | body.contains(token)
    return hit


def event_intensity(event_type: ColumnLike, event_name: ColumnLike) -> Column:
    body = F.concat_ws(" ", tidy(event_type), tidy(event_name))
    chain = F.when(_any(body, EVENT_CLASSES[0][1]), EVENT_CLASSES[0][0])
    for weight, tokens in EVENT_CLASSES[1:]:
        chain = chain.when(_any(body, tokens), weight)
    return chain.otherwise(F.lit(1.0))


def event_time_weight(now_s: Column, start_s: Column, end_s: Column, lookahead_hours: float,
                      post_minutes: float) -> Column:
    """1 while active, rising from 0.25 before the start, falling from 0.35 after the end; times in seconds."""
    ahead, after = max(900.0, lookahead_hours * 3600.0), max(0.0, post_minutes * 60.0)
    lead, tail = start_s - now_s, now_s - end_s
    fading = 0.35 * (1.0 - tail / after) if after > 0 else F.lit(0.0)
    return (
        F.when(tail > after, 0.0).when((lead <= 0) & (tail <= 0), 1.0)
        .when(lead > ahead, 0.0).when(lead > 0, 0.25 + 0.75 * (1.0 - lead / ahead)).otherwise(fading)
    )


def closure_severity(text: ColumnLike) -> Column:
    body = tidy(text)
    lanes = (F.when(_any(body, ["double-lane", "two out of", "2 out of"]), 0.32)
             .when(_any(body, ["single-lane", "single lane"]), 0.2).otherwise(0.0))
    total = (0.25 + flag(body.contains("full") & body.contains("close")) * 0.65 + lanes
             + flag(_any(body, ["bridge", "tunnel"])) * 0.1 + flag(body.contains("rolling closure")) * 0.12)
    return clamp(total, 0.1, 1.35)


def normalize_speed(speed: ColumnLike, column_name: str = "", unit: str = "mph") -> Column:
    """Kilometres per hour; the source column's name tells the unit, else `unit` ('auto': mph up to 30)."""
    name, unit, value = column_name.lower(), unit.strip().lower(), col_of(speed)
    if "kmh" in name or "kph" in name or ("mph" not in name and unit in ("kmh", "kph")):
        return value
    if "mph" in name or unit == "mph":
        return value * 1.60934
    return F.when(value <= 30.0, value * 1.60934).otherwise(value)


def speed_severity(kmh: ColumnLike, usual_kmh: float = 38.0) -> Column:
    usual, speed = max(5.0, usual_kmh), at_least(kmh, 0.0)
    deficit = (usual - speed) / usual + flag(speed < 12.0) * 0.2
    return F.when(speed >= usual, 0.0).otherwise(clamp(deficit, 0.0, 1.25))


def weather_factor(precip_mm: Column, wind_kmh: Column) -> Column:
    return round_half_up(1.0 + F.least(at_least(precip_mm, 0.0) / 4.0, F.lit(0.5))
                         + F.least(at_least(wind_kmh, 0.0) / 45.0, F.lit(0.25)), 3)


def weather_intensity(precip_mm: Column, wind_kmh: Column) -> Column:
    return round_half_up(clamp(precip_mm / 6.0) * 0.65 + clamp(wind_kmh / 50.0) * 0.35, 4)


def local_hour(ts: Column) -> Column:
    """Hour of the day in New York with its minutes as a fraction."""
    local = F.from_utc_timestamp(ts, NEW_YORK)
    return F.hour(local) + F.minute(local) / 60.0


def _within(hour: Column, start: float, end: float) -> Column:
    return (hour >= start) & (hour < end)


def is_peak(hour: Column) -> Column:
    return _within(hour, 7, 10) | _within(hour, 16, 20)


def rush_hour_factor(ts: Column) -> Column:
    hour = local_hour(ts)
    return F.when(_within(hour, 7, 10), 0.18).when(_within(hour, 16, 20), 0.22).when(_within(hour, 11, 14), 0.07).otherwise(0.0)


# Public holidays as month * 100 + day, and as (month, weekday from Monday = 0, which one of the month).
FIXED_HOLIDAYS = [101, 619, 704, 1111, 1225]
FLOATING_HOLIDAYS = [(1, 0, 3), (2, 0, 3), (9, 0, 1), (10, 0, 2), (11, 3, 4)]


def is_holiday(ts: Column) -> Column:
    """Whether the New York date of `ts` is a public holiday as observed, in any year.

    Fixed dates on a Saturday are observed the day before, on a Sunday the day after; Memorial Day is the last Monday of May.
    """
    local = F.to_date(F.from_utc_timestamp(ts, NEW_YORK))
    weekday, month, day = F.weekday(local), F.month(local), F.dayofmonth(local)
    fixed = lambda d: (F.month(d) * 100 + F.dayofmonth(d)).isin(FIXED_HOLIDAYS)
    found = ((weekday < 5) & fixed(local)) | ((weekday == 4) & fixed(F.date_add(local, 1))) | ((weekday == 0) & fixed(F.date_sub(local, 1)))
    found = found | ((month == 5) & (weekday == 0) & (day > 24))
    for of_month, on, which in FLOATING_HOLIDAYS:
        found = found | ((month == of_month) & (weekday == on) & (F.ceil(day / 7) == which))
    return found


def is_weekend(ts: Column) -> Column:
    return F.weekday(F.from_utc_timestamp(ts, NEW_YORK)) >= 5


def temporal_pressure(hour: Column, weekend: Column, holiday: Column) -> Column:
    season = (F.when(is_peak(hour), 0.14).when(_within(hour, 11, 14), 0.05).otherwise(0.0)
              + flag(weekend) * 0.08 + flag(holiday) * 0.12)
    return round_half_up(clamp(season, 0.0, 0.32), 4)


def temporal_context(ts: Column) -> dict[str, Column]:
    hour, weekend, holiday = local_hour(ts), is_weekend(ts), is_holiday(ts)
    return {
        "hour_local": round_half_up(hour, 3), "is_peak_hour": is_peak(hour), "is_weekend": weekend,
        "is_holiday": holiday, "temporal_pressure": temporal_pressure(hour, weekend, holiday),
    }


def recent_incidents(rows: DataFrame, now: Column, hours: float = 6.0) -> DataFrame:
    """Traffic, blocked-street and parking complaints of the last hours that have coordinates."""
    kind = F.col("complaint_type")
    wanted = kind.like("%Traffic%") | kind.like("%Blocked%") | kind.like("%Illegal Parking%")
    located = rows.withColumns({"lat": F.col("latitude").try_cast("double"), "lon": F.col("longitude").try_cast("double")})
    since = F.unix_micros(now) - F.lit(int(hours * 3.6e9))
    return located.where(wanted & (F.unix_micros("created_date") > since) & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def city_event_window(events: DataFrame, now: Column, lookahead_hours: float = 6.0, post_minutes: float = 60.0) -> DataFrame:
    """Events that are not long over and start within the look-ahead."""
    us = F.unix_micros(now)
    return events.where(
        (F.unix_micros("end_ts") >= us - F.lit(int(max(15.0, post_minutes) * 6e7)))
        & (F.unix_micros("start_ts") <= us + F.lit(int(lookahead_hours * 3.6e9))))
