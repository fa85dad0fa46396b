"""The detectors on made tracks; the negative cases matter most."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sealane.operators import corridors, grading, places
from sealane.operators.quality import track_quality
from sealane.operators.tracks import clean_segments, slow_runs, time_segments, track_stats
from sealane.plans import adapter, engine

T0 = datetime(2026, 1, 15)
FIELDS = "ts timestamp, mmsi long, lat double, lon double, sog double, cog double, heading double, nav_status string, source string"


def fix(mmsi, minutes, lat, lon, sog, cog=90.0, status="Under way using engine"):
    return (T0 + timedelta(minutes=minutes), mmsi, lat, lon, sog, cog, None, status, "made")


def crossing(mmsi, sog, n=60, minutes=4, lat=59.85, lon=24.65, span=0.30, start=0, cog=None):
    return [fix(mmsi, start + minutes * i, lat, lon + span * i / (n - 1), sog, cog(i) if cog else 90.0) for i in range(n)]


def found(spark, rows, positional="CHARTED", **more):
    df = spark.createDataFrame(rows, FIELDS)
    return engine.run(df, adapter.meridian(spark, positional), **more).detections.select("kind", "mmsi", "confidence", "score").collect()


def drag(mmsi=1):
    return crossing(mmsi, 12.0, 20, lon=24.65, span=0.10) + crossing(mmsi, 2.2, 60, lon=24.75, span=0.12, start=200) + crossing(mmsi, 12.0, 20, lon=24.87, span=0.10, start=680)


def test_all_kinds_at_once(spark):
    """One run over one hull for each behaviour, each with its own identity."""
    rng = random.Random(3)
    rows = drag(1)
    rows += crossing(2, 13.0)
    rows += [fix(3, 4 * i, 59.85 + 0.004 * math.sin(i / 2), 24.65 + 0.30 * i / 59, 2.2, (90 + 60 * math.sin(i / 2)) % 360) for i in range(60)]
    rows += [fix(4, 5 * i, 59.75 + rng.gauss(0, 1.5e-4), 24.80 + rng.gauss(0, 1.5e-4), 0.4, rng.uniform(0, 359), "Moored") for i in range(60)]
    rows += [fix(5, 5 * i, 59.76 + 1.0e-4 * i, 24.79 + 1.6e-4 * i, 0.5, rng.uniform(0, 359), "At anchor") for i in range(60)]
    rows += [fix(6, 5 * i, 59.95 + rng.gauss(0, 4e-4), 24.80 + rng.gauss(0, 4e-4), 0.5, rng.uniform(0, 359)) for i in range(60)]
    rows += [fix(7, 0, 55.0, 15.0, 10.0), fix(7, 360, 55.1, 15.1, 10.0)]
    rows += [fix(8, 20 * i, *((59.8, 24.8) if i % 2 else (35.9, 14.5)), 8.0) for i in range(12)]
    got = found(spark, rows)
    kinds = {m: {r.kind for r in got if r.mmsi == m} for m in range(1, 9)}
    assert "anchor_drag" in kinds[1]
    assert not kinds[2] and "anchor_drag" not in kinds[3] and not kinds[4] and not kinds[7] and not kinds[8]
    assert "loiter" in kinds[5] and "loiter" in kinds[6]
    low = found(spark, drag(1), "DISPLAY")
    assert low and {r.confidence for r in low} == {"LOW"}


def test_collision_and_teleport(spark):
    rows = [fix(8, 20 * i, *((59.8, 24.8) if i % 2 else (35.9, 14.5)), 8.0) for i in range(12)]
    rows += crossing(9, 2.0, 30, span=0.05) + [fix(9, 4 * 30, 59.85, 31.0, 2.0)] + crossing(9, 2.0, 30, lon=24.75, span=0.05, start=300) + crossing(10, 11.0)
    df = spark.createDataFrame(rows, FIELDS)
    q = {r.mmsi: r for r in track_quality(df).collect()}
    assert q[8].verdict == "PROBABLE_MMSI_COLLISION" and not q[8].usable and q[10].verdict == "CLEAN"
    assert q[9].n_segments >= 2
    runs = track_stats(slow_runs(time_segments(clean_segments(df.where("mmsi = 9")), ["mmsi", "clean_seg"])), ["mmsi", "clean_seg", "time_seg", "run"])
    assert runs.agg(F.max("distance_m")).first()[0] < 100_000


def test_learned_and_seeded_places(spark):
    rows = [fix(100 + v, 10 * i, 59.85, 24.80, 0.2) for v in range(6) for i in range(8)]
    cells = places.stopped_cells(spark.createDataFrame(rows, FIELDS))
    points = spark.createDataFrame([(1, 59.8505, 24.8005), (2, 59.85, 20.0), (3, 59.868, 24.815)], "k int, lat double, lon double")
    seeds = spark.createDataFrame([(59.85, 24.80, 4000.0, "Test Harbour")], "lat double, lon double, radius_m double, label string")
    assert {r.k for r in places.why_normal(points, ["k"], cells, None).collect()} == {1, 3}
    got = {r.k: r.reason for r in places.why_normal(points, ["k"], None, seeds).collect()}
    assert set(got) == {1, 3} and "Test Harbour" in got[1]
    assert places.stats(cells).first().cells_suppressing == 1


def test_row_order_and_repeats_do_not_matter(spark):
    rows = drag(1) + crossing(2, 13.0)
    shuffled = rows + rows[:30]
    random.Random(1).shuffle(shuffled)
    assert sorted(found(spark, rows)) == sorted(found(spark, shuffled))


@pytest.mark.parametrize("kind,positional,fault,want", [("anchor_drag", "CHARTED", "operator_notice", "HIGH"), ("loiter", "CHARTED", "operator_notice", "MODERATE"), ("anchor_drag", "CHARTED", "passive_outage", "MODERATE"), ("anchor_drag", "DISPLAY", "grid_capacity", "MODERATE"), ("anchor_drag", "DISPLAY", "passive_outage", "LOW")])
def test_corroboration(spark, kind, positional, fault, want):
    d = spark.createDataFrame([("x", kind, positional, "LOW", T0, T0 + timedelta(hours=1), 59.85, 24.8), ("y", kind, positional, "LOW", T0 + timedelta(days=9), T0 + timedelta(days=9), 59.85, 24.8)], "detection_id string, kind string, positional_class string, confidence string, start_ts timestamp, end_ts timestamp, lat double, lon double")
    f = spark.createDataFrame([("f", fault, "asset", T0 + timedelta(hours=13), T0 + timedelta(hours=14), 59.9, 24.8, 150.0), ("far", fault, "asset", T0, T0, 10.0, 10.0, 150.0)], "fault_id string, kind string, asset string, start timestamp, end timestamp, lat double, lon double, radius_km double")
    got = {r.detection_id: r for r in grading.corroborate(d, f).collect()}
    assert got["x"].confidence == want and [c.fault_id for c in got["x"].corroboration] == ["f"]
    assert got["y"].confidence == "LOW" and got["y"].corroboration is None


@pytest.mark.parametrize("block", [corridors.VERTEX_BLOCK, 3])
def test_nearest_route_beyond_the_widest_ring(spark, monkeypatch, block):
    monkeypatch.setattr(corridors, "VERTEX_BLOCK", block)
    lines = {7: [(20.0, 60.0), (25.0, 60.0), (30.0, 59.0)], 3: [(-4.0, 50.0), (-40.0, 45.0), (-70.0, 41.0)], 9: [(-40.0, 45.0)]}
    routes = spark.createDataFrame([(k, [{"lon": x, "lat": y} for x, y in line]) for k, line in lines.items()], "route_idx long, line array<struct<lon double, lat double>>")
    places_ = {1: (60.1, 21.0), 2: (-50.0, 150.0), 3: (-45.0, 140.0), 4: (-20.0, -30.0), 5: (5.0, -179.0), 6: (-75.0, -120.0), 7: (None, 10.0), 8: (4.0, -40.0)}

    def away(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371008.8 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))

    want = {m: min((away(lat, lon, y, x), k) for k, line in lines.items() for x, y in line) for m, (lat, lon) in places_.items() if lat is not None}
    assert sum(d > 3_200_000 for d, _ in want.values()) == 6
    points = spark.createDataFrame([(m, *p) for m, p in places_.items()], "mmsi long, lat double, lon double")
    rows = corridors.nearest_route(points, routes, ["mmsi"]).collect()
    assert len(rows) == len(want) and {r.mmsi: r.route_idx for r in rows} == {m: k for m, (_, k) in want.items()}
    assert all(abs(r.nearest_m - want[r.mmsi][0]) < 0.01 for r in rows)
