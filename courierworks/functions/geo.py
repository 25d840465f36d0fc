"""Distances, bearings and grid cells as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courierworks.functions.num import ColumnLike, col_of, round_half_up

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.32


def haversine_km(lat1: ColumnLike, lon1: ColumnLike, lat2: ColumnLike, lon2: ColumnLike) -> Column:
    lat1, lon1, lat2, lon2 = (col_of(v) for v in (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # Rounding may lift the chord a little over 1; `least` would turn a NULL chord into 1.
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.when(chord > 1.0, 1.0).otherwise(chord)))


def bearing_deg(lat1: ColumnLike, lon1: ColumnLike, lat2: ColumnLike, lon2: ColumnLike) -> Column:
    """Initial bearing from point 1 to point 2, 0 <= bearing < 360."""
    phi1, phi2 = F.radians(col_of(lat1)), F.radians(col_of(lat2))
    delta = F.radians(col_of(lon2) - col_of(lon1))
    y = F.sin(delta) * F.cos(phi2)
    x = F.cos(phi1) * F.sin(phi2) - F.sin(phi1) * F.cos(phi2) * F.cos(delta)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def project_point(lat: ColumnLike, lon: ColumnLike, bearing: ColumnLike, km: ColumnLike) -> tuple[Column, Column]:
    """Latitude and longitude reached from a point along a bearing on the sphere."""
    phi, lam, theta = F.radians(col_of(lat)), F.radians(col_of(lon)), F.radians(col_of(bearing))
    arc = col_of(km) / EARTH_RADIUS_KM
    phi2 = F.asin(F.sin(phi) * F.cos(arc) + F.cos(phi) * F.sin(arc) * F.cos(theta))
    lam2 = lam + F.atan2(F.sin(theta) * F.sin(arc) * F.cos(phi), F.cos(arc) - F.sin(phi) * F.sin(phi2))
    return F.degrees(phi2), F.pmod(F.degrees(lam2) + 540.0, F.lit(360.0)) - 180.0


def grid_axis(value: ColumnLike, resolution: float, digits: int | None = None) -> Column:
    """Centre of the grid cell on one axis, rounded to `digits` when given."""
    cell = F.round(col_of(value) / F.lit(resolution), 0) * F.lit(resolution)
    return cell if digits is None else round_half_up(cell, digits)


def grid_zone_id(lat: ColumnLike, lon: ColumnLike, resolution: float = 0.02) -> Column:
    """Identifier `<lat>_<lon>` of a grid cell with three decimals on each axis."""
    return F.format_string("%.3f_%.3f", grid_axis(lat, resolution), grid_axis(lon, resolution))


def cell_index(value: ColumnLike, resolution: float) -> Column:
    """Integer index of a grid cell; cheaper to group by than its centre."""
    return F.round(col_of(value) / F.lit(resolution), 0).cast("long")


def cell_centre(index: ColumnLike, resolution: float, digits: int | None = None) -> Column:
    centre = col_of(index).cast("double") * F.lit(resolution)
    return centre if digits is None else round_half_up(centre, digits)
