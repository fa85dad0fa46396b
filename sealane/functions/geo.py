"""Geodesic column functions on a sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8
CELL_DEG = 0.02


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def initial_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees from 0 up to 360."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)))
    return F.pmod(angle + F.lit(360.0), F.lit(360.0))


def angular_diff(a: Column, b: Column) -> Column:
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, F.lit(360.0) - d)


def cell(degrees: Column, size: float = CELL_DEG) -> Column:
    return F.floor(degrees / F.lit(size)).cast("long")


def densify(line: Column, step_m: float = 2000.0) -> Column:
    """Vertices of a line (array<struct<lon,lat>>) with equal lon/lat steps of at most ``step_m``.

    Steps that cross the antimeridian go the short way round.
    """
    near = lambda d: F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)
    wrap = lambda x: F.when(x > 180, x - 360).when(x < -180, x + 360).otherwise(x)

    def leg(i: Column) -> Column:
        a, b = F.get(line, i - 1), F.get(line, i)
        steps = F.greatest(F.lit(1), F.ceil(haversine_m(a["lat"], a["lon"], b["lat"], b["lon"]) / step_m)).cast("int")
        dlon, dlat = near(b["lon"] - a["lon"]), b["lat"] - a["lat"]
        return F.transform(F.sequence(F.lit(1), steps), lambda k: F.struct(wrap(a["lon"] + dlon * k / steps).alias("lon"), (a["lat"] + dlat * k / steps).alias("lat")))

    rest = F.flatten(F.transform(F.sequence(F.lit(1), F.size(line) - 1), leg))
    return F.when(F.size(line) < 2, line).otherwise(F.concat(F.slice(line, 1, 1), rest))


def bbox_contains(lon: Column, lat: Column, bbox: tuple[float, float, float, float]) -> Column:
    return lon.between(bbox[0], bbox[2]) & lat.between(bbox[1], bbox[3])


def point_segment_terms(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column, Column, Column]:
    """(x1, y1, x2, y2): metres of a segment's ends from a point, in a plane that touches the sphere at the point."""
    near = lambda d: F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)
    scale = F.cos(F.radians(lat)) * EARTH_M
    x1, y1 = F.radians(near(lon1 - lon)) * scale, F.radians(lat1 - lat) * EARTH_M
    return x1, y1, F.radians(near(lon2 - lon)) * scale, F.radians(lat2 - lat) * EARTH_M


def nearest_share(x1: Column, y1: Column, dx: Column, dy: Column) -> Column:
    """How much of the way from x1, y1 along dx, dy the point nearest to the origin lies."""
    length2 = dx * dx + dy * dy
    return F.when(length2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(x1 * dx + y1 * dy) / length2))).otherwise(F.lit(0.0))


def point_segment_m(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres from a point to a short segment, in a plane that touches the sphere at the point."""
    x1, y1, x2, y2 = point_segment_terms(lat, lon, lat1, lon1, lat2, lon2)
    dx, dy = x2 - x1, y2 - y1
    along = nearest_share(x1, y1, dx, dy)
    return F.hypot(x1 + along * dx, y1 + along * dy)


def aeqd_m(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """(x, y) metres in the azimuthal equidistant projection about (lat0, lon0) on the sphere."""
    p, p0, dl = F.radians(lat), F.radians(lat0), F.radians(lon - lon0)
    c = haversine_m(lat, lon, lat0, lon0) / EARTH_M
    k = F.when(c < 1e-12, F.lit(1.0)).otherwise(c / F.sin(c)) * EARTH_M
    return k * F.cos(p) * F.sin(dl), k * (F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(dl))
