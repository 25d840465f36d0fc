"""Joins by distance: radius search, counts within a radius, nearest zone.

Points are matched to centres by grid cell, so the join is an equi-join and never compares all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courierworks.functions.geo import KM_PER_DEGREE, haversine_km
from courierworks.operators.keyed import join_checked, top_per_key
from courierworks.session import stage

_SAFE_KM_PER_DEGREE = 111.0  # a little under the true value, so that covers are never too small


def _grid(size_deg: float) -> tuple[int, float]:
    columns = max(1, min(1_000_000, int(360.0 / size_deg)))
    return columns, 360.0 / columns


def _point_cells(points: DataFrame, size_deg: float) -> DataFrame:
    columns, step = _grid(size_deg)
    return points.withColumn("__row", F.floor(F.col("lat") / F.lit(size_deg)).cast("long")).withColumn(
        "__column", F.pmod(F.floor((F.col("lon") + 180.0) / F.lit(step)).cast("long"), F.lit(columns)))


def _covering_cells(centres: DataFrame, radius_km: float, size_deg: float, lat: str, lon: str) -> DataFrame:
    columns, step = _grid(size_deg)
    reach = radius_km / _SAFE_KM_PER_DEGREE
    edge = F.least(F.abs(F.col(lat)) + reach, F.lit(89.9))
    reach_lon = F.least(F.lit(reach) / F.cos(F.radians(edge)), F.lit(180.0))
    first = F.floor((F.col(lon) - reach_lon + 180.0) / F.lit(step))
    last = F.least(F.floor((F.col(lon) + reach_lon + 180.0) / F.lit(step)), first + F.lit(columns - 1))
    rows = F.sequence(F.floor((F.col(lat) - reach) / F.lit(size_deg)).cast("long"),
                      F.floor((F.col(lat) + reach) / F.lit(size_deg)).cast("long"))
    return (
        centres.withColumn("__row", F.explode(rows))
        .withColumn("__column", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        .withColumn("__column", F.pmod("__column", F.lit(columns)))
    )


def _on_cells(centres: DataFrame, points: DataFrame, radius_km: float, box: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both sides of `radius_join` with the cells they meet in: a centre once for each cell it covers, a point once."""
    size_deg = max(radius_km / _SAFE_KM_PER_DEGREE, 1e-3)
    named = centres.withColumnsRenamed({"lat": "centre_lat", "lon": "centre_lon"})
    covered = _covering_cells(named, radius_km * (1.001 if not box else 1.01), size_deg, "centre_lat", "centre_lon")
    return covered, _point_cells(points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()), size_deg)


def pairs_compared(centres: DataFrame, points: DataFrame, radius_km: float, on: list[str] | None = None) -> int:
    """The number of pairs that `radius_join` compares, by the counts of both sides in every cell."""
    keys = ["__row", "__column", *(on or [])]
    centres, points = (df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in zip(_on_cells(centres, points, radius_km), ("__c", "__p")))
    return int(centres.join(points, keys).agg(F.sum(F.col("__c") * F.col("__p").cast("double"))).first()[0] or 0)


def radius_join(centres: DataFrame, points: DataFrame, radius_km: float, box: bool = False,
                max_centres: int = 20_000, on: list[str] | None = None) -> DataFrame:
    """Pairs (centre, point) within the radius; centres carry lat and lon, which come back as centre_lat, centre_lon.

    With `box` the test is the latitude/longitude box of the radius instead of the circle. Result
    columns: the other columns of the centres, all columns of the points and `distance_km`.
    A hot cell is spread over sub-keys unless the covered centres are few enough to broadcast. `on` names
    columns of both sides that have to be equal as well; they become part of the join key.
    """
    covered, located = _on_cells(centres, points, radius_km, box)
    pairs = join_checked(located, covered, ["__row", "__column", *(on or [])], max_rows=max_centres * 25)
    pairs = pairs.withColumn("distance_km", haversine_km("centre_lat", "centre_lon", "lat", "lon"))
    if box:
        half_lat = radius_km / KM_PER_DEGREE
        half_lon = F.lit(radius_km) / (F.lit(KM_PER_DEGREE) * F.greatest(F.cos(F.radians("centre_lat")), F.lit(0.01)))
        inside = F.col("lat").between(F.col("centre_lat") - half_lat, F.col("centre_lat") + half_lat) & F.col(
            "lon").between(F.col("centre_lon") - half_lon, F.col("centre_lon") + half_lon)
    else:
        inside = F.col("distance_km") <= F.lit(float(radius_km))
    return pairs.where(inside).drop("__row", "__column")


def count_within(centres: DataFrame, points: DataFrame, radius_km: float, key: str, name: str = "n") -> DataFrame:
    """Points within the radius of every centre; centres without points have 0."""
    hits = radius_join(centres.select(key, "lat", "lon"), points.select("lat", "lon"), radius_km)
    counts = hits.groupBy(key).agg(F.count("*").alias(name))
    return centres.select(key).join(counts, key, "left").select(key, F.coalesce(name, F.lit(0)).alias(name))


def nearby(points: DataFrame, centres: DataFrame, key: str, radius_km: float, k: int, tie: str = "courier_id",
           statuses: list[str] | None = None) -> DataFrame:
    """The `k` nearest points of every centre, nearest first; the status filter applies to those `k` only."""
    found = top_per_key(radius_join(centres, points, radius_km), [key],
                        [F.asc("distance_km"), F.asc(tie)], k, rank="rank")
    return found if statuses is None else found.where(F.col("status").isin(statuses))


FINEST = 32  # cells a degree on the finest grid of the zone index
STEP = 2  # bits by which the row and column of a cell shrink from one grid to the next coarser one
COARSEST = 10  # bits to the coarsest grid: cells of 32 degrees, 12 columns by 6 rows


def _grid_cell(row: Column, column: Column, bits: int) -> Column:
    return F.shiftright(row, bits) * F.lit(360 * FINEST) + F.shiftright(column, bits)


def _place(lat: str, lon: str) -> tuple[Column, Column]:
    """Row and column of a point on the finest grid; poles and the date line belong to the last cells."""
    row = F.least(F.floor((F.col(lat) + 90.0) * FINEST), F.lit(180 * FINEST - 1)).cast("long")
    column = F.pmod(F.floor((F.col(lon) + 180.0) * FINEST).cast("long"), F.lit(360 * FINEST))
    return row, column


def _unit(lat: Column, lon: Column) -> list[Column]:
    y, x = F.radians(lat), F.radians(lon)
    return [F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _around(cells: DataFrame, bits: int) -> DataFrame:
    """Cells with the unit vector of their middle (mx, my, mz) and the sine of the radius of a cap that holds the cell."""
    width = F.lit(float((1 << bits) / FINEST))
    south = F.floor(F.col("cell") / (360 * FINEST)) * width - 90.0
    north = F.least(south + width, F.lit(90.0))
    west = F.pmod("cell", F.lit(360 * FINEST)) * width - 180.0
    middle = (south + north) / 2.0
    # the farthest points of a cell from its middle are its corners
    reach = F.greatest(haversine_km(middle, west + width / 2.0, south, west), haversine_km(middle, west + width / 2.0, north, west)) / 6371.0
    return cells.withColumns(dict(zip(("mx", "my", "mz"), _unit(middle, west + width / 2.0)))).withColumn("reach", F.sin(reach) + 1e-9)


def _prune(pairs: DataFrame, bits: int) -> DataFrame:
    """Candidates (cell, zone_id, zone_lat, zone_lon, x, y, z) that some point of their cell may be nearest to.

    A zone goes when the whole cap around the cell lies on the other side of the great circle halfway between it and the zone nearest to
    the middle of the cell. Zones at equal distance stay.
    """
    rows = _around(pairs, bits)
    zone, middle = [F.col(c) for c in "xyz"], [F.col(f"m{c}") for c in "xyz"]
    order = F.struct(_dot(zone, middle), -F.col("zone_lat"), -F.col("zone_lon"))
    rows = rows.withColumn("best", F.max_by(F.struct("x", "y", "z"), order).over(Window.partitionBy("cell")))
    apart = [F.col(f"best.{c}") - F.col(c) for c in "xyz"]
    keep = _dot(apart, middle) <= F.sqrt(_dot(apart, apart)) * F.col("reach") + 1e-12
    return rows.where(keep).select("cell", "zone_id", "zone_lat", "zone_lon", "x", "y", "z")


def zone_index(points: DataFrame, zones: DataFrame, max_pairs: int = 4_000_000) -> DataFrame:
    """cell, candidates: for every cell of the finest grid that holds a point, the zones that can be nearest to a point in it.

    Candidates are passed from coarse cells to the finer ones in them, by equi-joins on the coarse cell, and pruned on every grid. A step
    goes to the finest grid on which cells times candidates stay under `max_pairs`, so that a city with some hundred zones takes one.
    """
    row, column = _place("lat", "lon")
    cells = stage(points.where("lat IS NOT NULL AND lon IS NOT NULL").select(row.alias("row"), column.alias("column")).distinct())
    grids = list(range(COARSEST, -1, -STEP))
    counts = cells.agg(*[F.count_distinct(_grid_cell(F.col("row"), F.col("column"), b)).alias(f"n{b}") for b in grids]).first()
    first = zones.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy(F.col("lat").alias("zone_lat"), F.col("lon").alias("zone_lon")).agg(
        F.min("zone_id").alias("zone_id"))  # of zones at one place the smallest id answers
    first = first.withColumns(dict(zip("xyz", _unit(F.col("zone_lat"), F.col("zone_lon")))))
    coarse = [r * 360 * FINEST + c for r in range(180 * FINEST >> COARSEST, -1, -1) for c in range((360 * FINEST >> COARSEST) + 1)]
    there = cells.select(_grid_cell(F.col("row"), F.col("column"), COARSEST).alias("cell")).distinct()  # 72 cells at most
    candidates = first.withColumn("cell", F.explode(F.array(*map(F.lit, coarse)).cast("array<long>"))).join(F.broadcast(there), "cell")
    at, most = COARSEST, first.count()
    if counts["n0"] * most > max_pairs:
        candidates = stage(_prune(candidates, at))
    while at > 0:
        to = next((b for b in range(0, at, STEP) if counts[f"n{b}"] * most <= max_pairs), at - STEP)
        inside = cells.select(_grid_cell(F.col("row"), F.col("column"), at).alias("outer"), _grid_cell(F.col("row"), F.col("column"), to).alias("cell")).distinct()
        candidates, at = _prune(inside.join(candidates.withColumnRenamed("cell", "outer"), "outer").drop("outer"), to), to
        if at > 0:
            candidates = stage(candidates)
            most = candidates.groupBy("cell").count().agg(F.max("count")).first()[0] or 0
    return candidates.groupBy("cell").agg(F.collect_list(F.struct("zone_id", "zone_lat", "zone_lon")).alias("candidates"))


def nearest_zone(points: DataFrame, zones: DataFrame, key: str, max_pairs: int = 4_000_000, max_candidates: int = 1_000_000) -> DataFrame:
    """Each point with the nearest zone (zone_id) and its distance (zone_km); equal distances go to the smaller zone id.

    The points meet the index of candidates in one join on their cell and pick among them in the row, so no point is shuffled while the
    index holds at most `max_candidates` (it is counted), and none is compared with zones that cannot be nearest. Points without coordinates,
    or without any zone, have NULL. `key` names the points' own key and is not needed for the answer. Reads `points` twice; write them first
    if they are dear to make.
    """
    index = stage(zone_index(points, zones, max_pairs))
    held = index.agg(F.sum(F.size("candidates"))).first()[0] or 0
    row, column = _place("lat", "lon")
    nowhere = -1 - F.pmod(F.xxhash64(key), F.lit(4096))  # points without a place do not meet in one key
    located = points.withColumn("__cell", F.coalesce(_grid_cell(row, column, 0), nowhere))
    index = index.withColumnRenamed("cell", "__cell").withColumnRenamed("candidates", "__zones")
    joined = located.join(F.broadcast(index), "__cell", "left") if held <= max_candidates else join_checked(located, index, ["__cell"], "left", max_rows=0)
    best = F.array_min(F.transform("__zones", lambda z: F.struct(haversine_km(F.col("lat"), F.col("lon"), z["zone_lat"], z["zone_lon"]).alias("km"), z["zone_id"].alias("id"))))
    return joined.withColumn("__best", best).select(*points.columns, F.col("__best.id").alias("zone_id"), F.col("__best.km").alias("zone_km"))
