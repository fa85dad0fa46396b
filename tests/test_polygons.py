"""Corridor outlines against distances, and the cell index against winding numbers of all edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealane.functions import outline
from sealane.functions.geo import densify, point_segment_m
from sealane.operators import polygons
from sealane.operators.corridors import corridor_join, segments

WIDTH = 3000.0


def lines(rng):
    """Straight, bent, doubling back, tighter than the width, across the antimeridian, far north, and one point."""
    out = [[(24.8, 59.6), (24.8, 60.1)], [(10.0, 55.0), (10.3, 55.1), (10.2, 55.3), (10.6, 55.2)], [(5.0, 50.0), (5.2, 50.0), (5.0, 50.01)], [(0.0, 0.0), (0.01, 0.01), (0.02, 0.0), (0.02, -0.02), (0.0, -0.02), (0.0, 0.0)]]
    out += [[(179.9, -17.0), (-179.9, -17.1), (-179.7, -16.9)], [(20.0, 78.0), (20.8, 78.2)], [(3.0, 3.0)], [(7.0, 7.0), (7.0, 7.0), (7.1, 7.0)]]
    for _ in range(6):
        walk = np.cumsum(rng.normal(0, 0.04, (12, 2)), axis=0) + rng.uniform(-50, 50, 2)
        out.append([tuple(p) for p in walk.tolist()])
    return out


@pytest.fixture(scope="module")
def routes(spark):
    rows = [(k, [dict(lon=x, lat=y) for x, y in line]) for k, line in enumerate(lines(np.random.default_rng(3)))]
    return spark.createDataFrame(rows, "route_idx long, line array<struct<lon:double,lat:double>>").withColumn("line", densify(F.col("line"))).cache()


@pytest.fixture(scope="module")
def points(spark, routes):
    """Places up to twice the width from each line, and some without a place."""
    rng = np.random.default_rng(4)
    rows = []
    for r in routes.collect():
        for _ in range(400):
            p = r.line[rng.integers(len(r.line))]
            away, angle = rng.uniform(0, 2 * WIDTH) / outline.DEGREE_M, rng.uniform(0, 2 * math.pi)
            lon = p.lon + away * math.cos(angle) / math.cos(math.radians(p.lat))
            rows.append((len(rows), (lon + 180) % 360 - 180, p.lat + away * math.sin(angle)))
    rows += [(len(rows), None, 1.0), (len(rows) + 1, 1.0, None), (len(rows) + 2, float("nan"), 1.0)]
    return spark.createDataFrame(rows, "id long, lon double, lat double").cache()


def distances(points, routes):
    """(id, route_idx, m) of all pairs, by the plane that the corridor join uses; a line of one point has its own."""
    one = routes.where(F.size("line") == 1).select("route_idx", *[F.get("line", F.lit(0))[c].alias(f"{c}{k}") for k in (1, 2) for c in ("lon", "lat")])
    legs = segments(routes).drop("seg_idx").unionByName(one)
    m = point_segment_m(*map(F.col, ("lat", "lon", "lat1", "lon1", "lat2", "lon2")))
    rows = points.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lon)").crossJoin(F.broadcast(legs)).groupBy("id", "route_idx").agg(F.min(m).alias("m"))
    return {(r.id, r.route_idx): r.m for r in rows.where(F.col("m") < 4 * WIDTH).collect()}


def test_corridor_join_writes_each_term_once(points, routes):
    """The distance stands in the plan once, and not again with all its terms in the join's condition."""
    long = routes.where(F.size("line") > 1)
    out = corridor_join(points, long, WIDTH, ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HYPOT(") == 1
    want = {pair: m for pair, m in distances(points, long).items() if m < WIDTH}
    assert {(r.id, r.route_idx): r.dist_m for r in out.collect()} == want and len(want) > 1500


@pytest.mark.parametrize("tolerance", [None, polygons.tolerance_deg(WIDTH)])
def test_points_are_inside_exactly_when_nearer_than_the_width(points, routes, tolerance):
    rings = polygons.corridor_polygons(routes, WIDTH, tolerance).withColumnRenamed("route_idx", "polygon").cache()
    found = {(r.id, r.polygon) for r in polygons.points_in_polygons(points, rings, ["id"]).collect()}
    slack = 0.003 * WIDTH + (0 if tolerance is None else tolerance * outline.DEGREE_M)
    known = distances(points, routes)
    assert all(known.get(pair, math.inf) < WIDTH + slack for pair in found)
    inside = {pair for pair, m in known.items() if m < WIDTH - slack}
    assert len(inside) > (1500 if tolerance is None else 600) and inside <= found


def test_cells_agree_with_all_edges(points, routes):
    rings = polygons.corridor_polygons(routes, WIDTH, 0.002).withColumnRenamed("route_idx", "polygon").cache()
    where = [r for r in points.collect() if r.lat is not None and r.lon is not None and not math.isnan(r.lon)]
    x, y, want = np.array([r.lon for r in where]), np.array([r.lat for r in where]), set()
    for r in rings.collect():
        ring = np.array([[p.lon, p.lat] for p in r.ring])
        for shift in (-360.0, 0.0, 360.0):
            want |= {(where[k].id, r.polygon) for k in np.flatnonzero(outline.windings(ring, x + shift, y))}
    for size in (0.05, 0.2):
        assert {(r.id, r.polygon) for r in polygons.points_in_polygons(points, rings, ["id"], size).collect()} == want


def test_boundary_and_simple_shapes(spark):
    """A square: its west and south sides belong to it; a ring wound twice stays inside, one around nothing is nothing."""
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    shape = lambda ring: [dict(lon=x, lat=y) for x, y in ring]
    rings = spark.createDataFrame([(1, shape(square)), (2, shape(square + square[1:])), (3, shape([(5.0, 5.0)] * 4)), (4, [])], "polygon long, ring array<struct<lon:double,lat:double>>")
    places = {"middle": (0.5, 0.5), "west": (0.0, 0.5), "east": (1.0, 0.5), "south": (0.5, 0.0), "north": (0.5, 1.0), "corner": (0.0, 0.0), "far": (1.0, 1.0), "out": (0.5, 1.2), "point": (5.0, 5.0)}
    points = spark.createDataFrame([(k, x, y) for k, (x, y) in places.items()], "id string, lon double, lat double")
    found = {(r.id, r.polygon) for r in polygons.points_in_polygons(points, rings, ["id"]).collect()}
    assert found == {(k, p) for k in ("middle", "west", "south", "corner") for p in (1, 2)}
    assert polygons.points_in_polygons(points.limit(0), rings, ["id"]).count() == 0 == polygons.points_in_polygons(points, rings.limit(0), ["id"]).count()


def test_simplification_keeps_within_its_tolerance():
    rng = np.random.default_rng(5)
    for _ in range(30):
        angle = np.sort(rng.uniform(0, 2 * np.pi, 200))
        ring = np.stack([np.cos(angle), np.sin(angle)], 1) * rng.uniform(0.9, 1.1, 200)[:, None]
        ring = np.concatenate([ring, ring[:1]])
        short = outline.simplified(ring, 0.05)
        assert len(short) < len(ring) and (short[0] == short[-1]).all()
        for p in ring:
            a, d = short[:-1], np.diff(short, axis=0)
            along = np.clip(np.sum((p - a) * d, axis=1) / np.maximum(1e-30, np.sum(d * d, axis=1)), 0, 1)
            assert np.min(np.sum((p - a - along[:, None] * d) ** 2, axis=1)) <= 0.05**2 + 1e-12
