"""Corridor polygons around routes, and which of them points lie in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealane.functions import outline

#: Degrees of a cell of the polygon index; a whole number of them makes a full turn.
CELL = 0.05
RINGS = "route_idx bigint, ring array<struct<lon:double,lat:double>>"
_INDEX = "polygon bigint, cell_row bigint, cell_col bigint, shift double, winding int, edges array<array<double>>"


def tolerance_deg(width_m: float) -> float:
    """How far a published outline may stand from the true one, in degrees."""
    return max(0.002, width_m / 111_000.0 * 0.35)


def corridor_polygons(routes: DataFrame, width_m: float, tolerance: float | None = None) -> DataFrame:
    """(route_idx, ring): a closed ring ``width_m`` around each route's line.

    Without a tolerance the ring follows the width to a thousandth and a half, the sag of its chords;
    with one it is simplified by Douglas and Peucker's rule.  Longitudes run on over the antimeridian.
    Lines without points are left out; a line of one point has a circle.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, line in zip(frame["route_idx"], frame["line"], strict=True):
                points = np.array([[p["lon"], p["lat"]] for p in line], float)
                ring = outline.offset_ring(points[:, 0], points[:, 1], width_m)
                ring = ring if tolerance is None else outline.simplified(ring, tolerance)
                rows.append((k, [{"lon": x, "lat": y} for x, y in ring.tolist()]))
            yield pd.DataFrame(rows, columns=["route_idx", "ring"])

    return routes.where(F.size("line") > 0).select("route_idx", "line").mapInPandas(run, RINGS)


def turns(ring: str) -> Column:
    """array of rings: a ring that runs over the antimeridian as its parts of each turn, brought between -180 and 180.

    A part is what is left after cutting at the meridian (Sutherland and Hodgman's rule for one
    edge); it stays closed.
    """

    def cut(points: Column, at: float, east: bool) -> Column:
        inside = lambda p: p["lon"] >= at if east else p["lon"] <= at

        def step(k: Column) -> Column:
            a, b = F.get(points, k), F.get(points, k + 1)
            share = (F.lit(at) - a["lon"]) / (b["lon"] - a["lon"])
            on = F.struct(F.lit(at).alias("lon"), (a["lat"] + share * (b["lat"] - a["lat"])).alias("lat"))
            both = F.when(inside(b), F.when(inside(a), F.array(b)).otherwise(F.array(on, b))).when(inside(a), F.array(on)).otherwise(F.slice(F.array(b), 1, 0))
            return both

        kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(points) - 2), step))
        return F.when(F.size(kept) > 0, F.concat(F.slice(kept, -1, 1), kept)).otherwise(kept)

    whole = F.col(ring)
    lon = F.transform(whole, lambda p: p["lon"])
    moved = lambda points, by: F.transform(points, lambda p: F.struct((p["lon"] + by).alias("lon"), p["lat"].alias("lat")))
    over = F.array(cut(whole, 180.0, False), moved(cut(whole, 180.0, True), -360.0))
    under = F.array(cut(whole, -180.0, True), moved(cut(whole, -180.0, False), 360.0))
    return F.when(F.array_max(lon) > 180, over).when(F.array_min(lon) < -180, under).otherwise(F.array(whole))


def polygon_index(polygons: DataFrame, size: float = CELL) -> DataFrame:
    """(polygon, cell_row, cell_col, shift, winding, edges): the cells of each polygon (polygon, ring).

    ``winding`` is that of the cell's centre and ``edges`` [x1, y1, x2, y2] are those that touch the
    cell; ``shift`` takes a longitude to the polygon's own turn.
    """
    around = round(360.0 / size)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, ring in zip(frame["polygon"], frame["ring"], strict=True):
                points = np.array([[p["lon"], p["lat"]] for p in ring], float)
                for row, column, winding, edges in outline.covered_cells(points, size):
                    turn = (column + around // 2) // around
                    rows.append((k, row, column - turn * around, turn * 360.0, winding, edges))
            yield pd.DataFrame(rows, columns=["polygon", "cell_row", "cell_col", "shift", "winding", "edges"])

    return polygons.where(F.size("ring") > 0).select("polygon", "ring").mapInPandas(run, _INDEX)


def _crossed(edge: Column, size: float) -> Column:
    """What an edge adds to the winding between a cell's centre and a point: along the centre's meridian to the point's latitude, then along that."""
    x1, y1, x2, y2 = (F.get(edge, F.lit(k)) for k in range(4))
    x, y = F.col("_x"), F.col("lat")
    cx, cy = (F.col("_column") + 0.5) * size, (F.col("cell_row") + 0.5) * size
    way = lambda low, high, at: F.when((low <= at) & (at < high), 1).when((high <= at) & (at < low), -1).otherwise(0)
    # Both steps use half-open ends, as if the path stood a hair above and to the east.
    at_y = F.when(y1 != y2, x1 + (y - y1) * (x2 - x1) / (y2 - y1))
    level = F.when((at_y > cx) & (at_y <= x), 1).when((at_y > x) & (at_y <= cx), -1).otherwise(0) * way(y1, y2, y)
    at_x = F.when(x1 != x2, y1 + (cx - x1) * (y2 - y1) / (x2 - x1))
    steep = F.when((at_x > cy) & (at_x <= y), 1).when((at_x > y) & (at_x <= cy), -1).otherwise(0) * way(x1, x2, cx)
    return level - steep


def points_in_polygons(points: DataFrame, polygons: DataFrame, key: list[str], size: float = CELL) -> DataFrame:
    """(key, polygon) for each polygon (polygon, ring) that a point (lat, lon) lies in.

    Points and polygons meet in an equi-join on cells, so a point sees only the edges of its own
    cell: its winding is the centre's plus what the way from there crosses.  An edge belongs to what
    is east of it, and of two ends to the lower; points without a place are in nothing.  Work
    follows the points in covered cells; the index is joined by shuffle unless Spark finds it small.
    """
    around = round(360.0 / size)
    placed = points.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)").select(*key, "lat", "lon")
    column = F.floor(F.col("lon") / size).cast("long")
    turn = F.floor((column + around // 2) / around)
    placed = placed.withColumns({"cell_row": F.floor(F.col("lat") / size).cast("long"), "cell_col": (column - turn * around).cast("long"), "_own": turn * 360.0})
    met = placed.join(polygon_index(polygons, size), ["cell_row", "cell_col"])
    met = met.withColumns({"_x": F.col("lon") - F.col("_own") + F.col("shift"), "_column": F.col("cell_col") + F.round(F.col("shift") / size)})
    winding = F.aggregate("edges", F.col("winding"), lambda total, edge: total + _crossed(edge, size))
    return met.where(winding != 0).select(*key, "polygon").distinct()
