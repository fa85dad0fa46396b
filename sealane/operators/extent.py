"""Whether points of a group lie far apart on the sphere, without looking at all pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealane.functions.geo import EARTH_M, haversine_m

#: Directions in space: axes, diagonals of faces and diagonals of the cube.
_AXES = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) > (0, 0, 0)]
DIRECTIONS = [tuple(c / math.sqrt(x * x + y * y + z * z) for c in (x, y, z)) for x, y, z in _AXES]
#: No direction is farther than this angle's cosine from one of them or its opposite.
COSINE = 0.88
#: Degrees of the cells in which undecided groups compare their points.
CELL = 0.25


def _along(direction: tuple[float, float, float]) -> Column:
    """How far a point of the unit sphere lies in a direction."""
    lat, lon = F.radians("lat"), F.radians("lon")
    return F.lit(direction[0]) * F.cos(lat) * F.cos(lon) + F.lit(direction[1]) * F.cos(lat) * F.sin(lon) + F.lit(direction[2]) * F.sin(lat)


def extremes(points: DataFrame, key: list[str]) -> DataFrame:
    """(key, ends, width): the outermost points in each direction, and the largest extent in any, in radii.

    One aggregate of bounded size a group, added up where the points are.
    """
    here = F.struct("lat", "lon")
    ends = [f(here, _along(d)) for d in DIRECTIONS for f in (F.min_by, F.max_by)]
    widths = [F.max(_along(d)) - F.min(_along(d)) for d in DIRECTIONS]
    return points.groupBy(*key).agg(F.array_distinct(F.array(*ends)).alias("ends"), F.greatest(*widths).alias("width"))


def far_apart(points: DataFrame, key: list[str], metres: float) -> DataFrame:
    """(key, apart): whether two points (lat, lon) of a group are at least ``metres`` apart, for groups of any size.

    Two of a group's outermost points that far apart settle it.  Nothing is that far apart if no
    extent reaches the chord's share that the nearest direction must show.  Only groups between
    (their farthest points within a tenth or so above the bound) compare points, of those cells
    that can be far enough from each other.  Rows without a place are left out.
    """
    points = points.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)").select(*key, "lat", "lon")
    chord = 2 * math.sin(min(math.pi, metres / EARTH_M) / 2)
    ends = extremes(points, key)
    pair = F.transform("ends", lambda a: F.array_max(F.transform("ends", lambda b: haversine_m(a["lat"], a["lon"], b["lat"], b["lon"]))))
    judged = ends.select(*key, (F.array_max(pair) >= metres).alias("sure"), (F.col("width") >= COSINE * chord).alias("open"))
    undecided = judged.where("open AND NOT sure").select(*key)
    cells = points.join(undecided, key, "left_semi").distinct().withColumns({"row": F.floor(F.col("lat") / CELL), "col": F.floor(F.col("lon") / CELL)})
    corners = cells.select(*key, "row", "col").distinct()
    other = corners.withColumnsRenamed({"row": "row2", "col": "col2"})
    middle = lambda c: (F.col(c) + 0.5) * CELL
    reach = 2 * EARTH_M * math.radians(CELL) * math.sqrt(0.5)
    near = corners.join(other, key).where((F.struct("row", "col") <= F.struct("row2", "col2")) & (haversine_m(middle("row"), middle("col"), middle("row2"), middle("col2")) + reach >= metres))
    second = cells.withColumnsRenamed({"lat": "lat2", "lon": "lon2", "row": "row2", "col": "col2"})
    pairs = cells.join(near, [*key, "row", "col"]).join(second, [*key, "row2", "col2"])
    found = pairs.where(haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) >= metres).select(*key).distinct().withColumn("found", F.lit(True))
    return judged.join(found, key, "left").select(*key, (F.col("sure") | F.coalesce("found", F.lit(False))).alias("apart"))
