"""Spatial joins of positions with cable routes on a latitude/longitude grid.

A route is a row (route_idx, cable_id, name, positional_class, source, line) with densified ``line``.
Segments are put into every grid cell within reach, positions into their own cell, and an equi-join
on the cell finds the candidates whose exact distance is then computed: no cross join, and the work
follows the number of positions near a route.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealane.functions.geo import EARTH_M, haversine_m, nearest_share, point_segment_terms

CORRIDOR_M = 3_000.0
SURVEY_M = 15_000.0
#: A route table with so many rows of cells at most is broadcast; a larger one is joined by shuffle.
BROADCAST_CELLS = 200_000
#: The nearest route is looked for in rings up to this reach, then among all vertices, so many at a time.
WIDEST_M, VERTEX_BLOCK = 3_200_000.0, 200_000
_LAT_M = EARTH_M * 3.141592653589793 / 180


def segments(routes: DataFrame) -> DataFrame:
    """(route_idx, seg_idx, lon1, lat1, lon2, lat2)."""
    pairs = routes.select("route_idx", F.posexplode("line").alias("seg_idx", "a"), "line").withColumn("b", F.get("line", F.col("seg_idx") + 1)).where("b IS NOT NULL")
    return pairs.select("route_idx", "seg_idx", F.col("a.lon").alias("lon1"), F.col("a.lat").alias("lat1"), F.col("b.lon").alias("lon2"), F.col("b.lat").alias("lat2"))


def vertices(routes: DataFrame) -> DataFrame:
    return routes.select("route_idx", F.explode("line").alias("v")).select("route_idx", F.col("v.lon").alias("vlon"), F.col("v.lat").alias("vlat"))


def _row(lat: Column, reach_m: float) -> Column:
    return F.floor(lat / (reach_m / _LAT_M)).cast("long")


def _width(row: Column, reach_m: float) -> Column:
    """Degrees of longitude that a cell of a row spans: at least ``reach_m`` anywhere in it and next to it."""
    height = reach_m / _LAT_M
    far = F.least(F.lit(89.0), F.greatest(F.abs(row * height), F.abs((row + 1) * height)) + height)
    return F.lit(360.0) / F.greatest(F.lit(1.0), F.floor(F.lit(360.0) * F.cos(F.radians(far)) / height))


def cells_of_points(points: DataFrame, reach_m: float) -> DataFrame:
    row = _row(F.col("lat"), reach_m)
    return points.withColumn("cell_row", row).withColumn("cell_col", F.floor(F.pmod(F.col("lon"), F.lit(360.0)) / _width(F.col("cell_row"), reach_m)).cast("long"))


def cells_near(boxes: DataFrame, reach_m: float) -> DataFrame:
    """One row for each cell within one cell of the box lon1..lon2, lat1..lat2 of each row."""
    near = lambda d: F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)
    low, high = _row(F.least("lat1", "lat2"), reach_m) - 1, _row(F.greatest("lat1", "lat2"), reach_m) + 1
    out = boxes.withColumn("cell_row", F.explode(F.sequence(low, high)))
    width = _width(F.col("cell_row"), reach_m)
    west = F.col("lon1") + F.least(F.lit(0.0), near(F.col("lon2") - F.col("lon1")))
    east = F.col("lon1") + F.greatest(F.lit(0.0), near(F.col("lon2") - F.col("lon1")))
    first, last = F.floor(west / width).cast("long") - 1, F.floor(east / width).cast("long") + 1
    around = F.round(F.lit(360.0) / width).cast("long")
    out = out.withColumn("_c", F.explode(F.sequence(first, last))).withColumn("cell_col", F.pmod(F.col("_c"), around)).drop("_c")
    return out.dropDuplicates(["route_idx", *[c for c in ("seg_idx", "vlon", "vlat") if c in boxes.columns], "cell_row", "cell_col"])


def small(table: DataFrame) -> DataFrame:
    """A table to broadcast, if a count finds it small enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_CELLS else table


def with_distance(pairs: DataFrame) -> DataFrame:
    """Adds dist_m from lat, lon to the segment lat1, lon1, lat2, lon2, as :func:`point_segment_m` has it, but each term once."""
    terms = point_segment_terms(*map(F.col, ("lat", "lon", "lat1", "lon1", "lat2", "lon2")))
    pairs = pairs.withColumns(dict(zip(("_x1", "_y1", "_x2", "_y2"), terms, strict=True)))
    pairs = pairs.withColumns({"_dx": F.col("_x2") - F.col("_x1"), "_dy": F.col("_y2") - F.col("_y1")})
    pairs = pairs.withColumn("_along", nearest_share(*map(F.col, ("_x1", "_y1", "_dx", "_dy"))))
    return pairs.withColumn("dist_m", F.hypot(F.col("_x1") + F.col("_along") * F.col("_dx"), F.col("_y1") + F.col("_along") * F.col("_dy"))).drop("_x1", "_y1", "_x2", "_y2", "_dx", "_dy", "_along")


def corridor_join(points: DataFrame, routes: DataFrame, reach_m: float, key: list[str], payload: list[str] | None = None) -> DataFrame:
    """(key, payload, route_idx, dist_m): every point less than ``reach_m`` from a route."""
    keep = [*key, *(payload or [])]
    placed = cells_of_points(points.select(*dict.fromkeys([*keep, "lat", "lon"])), reach_m)
    near = small(cells_near(segments(routes), reach_m).withColumnRenamed("cell_row", "_r").withColumnRenamed("cell_col", "_c"))
    pairs = placed.join(near, (placed["cell_row"] == near["_r"]) & (placed["cell_col"] == near["_c"]))
    firsts = [F.first(c).alias(c) for c in payload or [] if c not in key]
    # The reach is asked of the least distance: a filter of pairs would go into the join's condition, with each shared term written out again wherever it stands.
    return with_distance(pairs).groupBy(*key, "route_idx").agg(F.min("dist_m").alias("dist_m"), *firsts).where(F.col("dist_m") < reach_m)


def vertex_distance(pairs: DataFrame, routes: DataFrame, key: list[str]) -> DataFrame:
    """(key, route_idx, vertex_m): least distance to a vertex for given (point, route) pairs."""
    held = routes.select("route_idx", "line")
    joined = pairs.join(held, "route_idx")
    least = F.array_min(F.transform("line", lambda v: haversine_m(F.col("lat"), F.col("lon"), v["lat"], v["lon"])))
    return joined.select(*key, "route_idx", least.alias("vertex_m"))


def vertices_within(points: DataFrame, routes: DataFrame, reach_m: float, key: list[str]) -> DataFrame:
    """(key, route_idx, vertex_m) of routes with a vertex at most ``reach_m`` away."""
    placed = cells_of_points(points.select(*key, "lat", "lon"), reach_m)
    v = vertices(routes).select("route_idx", "vlon", "vlat", *[F.col(f"v{c}").alias(f"{c}{k}") for k in (1, 2) for c in ("lon", "lat")])
    near = small(cells_near(v, reach_m).select("route_idx", "vlon", "vlat", F.col("cell_row").alias("_r"), F.col("cell_col").alias("_c")))
    pairs = placed.join(near, (placed["cell_row"] == near["_r"]) & (placed["cell_col"] == near["_c"]))
    pairs = pairs.withColumn("vertex_m", haversine_m(F.col("lat"), F.col("lon"), F.col("vlat"), F.col("vlon"))).where(F.col("vertex_m") <= reach_m)
    return pairs.groupBy(*key, "route_idx").agg(F.min("vertex_m").alias("vertex_m"))


def nearest_route(points: DataFrame, routes: DataFrame, key: list[str], first_reach_m: float = 50_000.0) -> DataFrame:
    """(key, route_idx, nearest_m): the route with the nearest vertex of all.

    Rings of growing reach: points with a vertex inside a ring are done, as anything outside it is
    farther; the others go on to a ring four times as wide.  What is left after the widest ring
    (points over 3,200 km from any route) looks at every route's vertices.
    """
    found, reach = None, first_reach_m
    left = points.select(*key, "lat", "lon").persist()
    while reach <= WIDEST_M and not left.isEmpty():
        # Kept, so that the next ring starts from what this one has left and not from the points again.
        hit = vertices_within(left, routes, reach, key).groupBy(*key).agg(F.min_by("route_idx", F.struct("vertex_m", "route_idx")).alias("route_idx"), F.min("vertex_m").alias("nearest_m")).persist()
        found = hit if found is None else found.unionByName(hit)
        rest = left.join(hit.select(*key), key, "left_anti").persist()
        rest.count()
        left.unpersist()
        left, reach = rest, reach * 4
    if not left.isEmpty():
        far = nearest_of_all(left, routes, key)
        return far if found is None else found.unionByName(far)
    left.unpersist()
    if found is None:
        return left.select(*key, F.lit(None).cast("long").alias("route_idx"), F.lit(None).cast("double").alias("nearest_m"))
    return found


def nearest_of_all(points: DataFrame, routes: DataFrame, key: list[str]) -> DataFrame:
    """(key, route_idx, nearest_m) over all vertices, whose blocks are broadcast one by one.

    Each task keeps the least distance of its points so far; points without a position get no row.
    """
    known = lambda lat, lon: F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    points, v, best = points.where(known("lat", "lon")), vertices(routes).where(known("vlat", "vlon")).distinct(), None
    n_blocks = -(-v.count() // VERTEX_BLOCK)
    for k in range(max(1, n_blocks)):
        block = v.where(F.pmod(F.xxhash64("route_idx", "vlon", "vlat"), F.lit(max(1, n_blocks))) == k)
        pairs = points.crossJoin(F.broadcast(block)).withColumn("vertex_m", haversine_m(F.col("lat"), F.col("lon"), F.col("vlat"), F.col("vlon")))
        least = pairs.groupBy(*key).agg(F.min(F.struct("vertex_m", "route_idx")).alias("best"))
        best = least if best is None else best.unionByName(least).groupBy(*key).agg(F.min("best").alias("best"))
    return best.select(*key, F.col("best.route_idx").alias("route_idx"), F.col("best.vertex_m").alias("nearest_m"))
