"""Global numbers and farthest points against plain Python."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from sealane.operators import extent, grading, order
from sealane.operators.quality import track_quality


@pytest.mark.parametrize("rows_a_part", [10_000, 60, 7])
def test_numbers_follow_the_whole_key(spark, rows_a_part):
    """Nulls come first, a third of the rows share one key, names clash with those used inside."""
    rng = random.Random(1)
    rows = [(rng.choice([None, 0.5, 0.5, rng.random()]), rng.choice([None, "a", "b", "é"]), i, "x", 1) for i in range(300)]
    rows += [(0.5, "same", 1000, "x", 1)] * 150
    df = spark.createDataFrame(rows, "score double, name string, id long, _row string, _part int").repartition(5).cache()
    out = order.numbered(df, {"s": -F.col("score"), "name": F.col("name"), "id": F.col("id")}, "ord", rows_a_part=rows_a_part)
    got = sorted(out.collect(), key=lambda r: r.ord)
    assert out.columns == [*df.columns, "ord"] and [r.ord for r in got] == list(range(1, 451))
    place = lambda x: (x is not None, x)
    want = sorted(rows, key=lambda r: (place(None if r[0] is None else -r[0]), place(None if r[1] is None else r[1].encode()), r[2]))
    assert [tuple(r)[:5] for r in got] == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert rows_a_part > len(rows) or "SinglePartition" not in plan
    assert order.numbered(df.limit(0), {"id": F.col("id")}, "ord").count() == 0


def test_many_small_ranges(spark):
    """A range for each fifty rows: no row is compared with two thousand cuts."""
    rows = spark.range(0, 100_000, 1, 4).select("id", F.when(F.col("id") % 5 > 0, F.pmod(F.col("id") * 7919, F.lit(100_003))).alias("k")).cache()
    began = time.time()
    out = order.numbered(rows, {"k": F.col("k"), "id": F.col("id")}, "ord", rows_a_part=50).collect()
    assert time.time() - began < 30
    want = sorted((r.k is not None, r.k or 0, r.id) for r in out)
    assert [(r.k is not None, r.k or 0, r.id) for r in sorted(out, key=lambda r: r.ord)] == want and sorted(r.ord for r in out) == list(range(1, 100_001))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 100])
def test_ranges_are_found_by_halving(spark, n):
    cuts = F.array(*[F.struct(F.lit(2 * k).cast("long").alias("k")) for k in range(n)])
    got = spark.range(-1, 2 * n + 2).select("id", order._not_above(cuts, n, F.struct(F.col("id").alias("k"))).alias("part")).collect()
    assert {r.id: r.part for r in got} == {k: min(n, max(0, k // 2 + 1)) for k in range(-1, 2 * n + 2)}


def test_detection_order_under_ties(spark):
    kinds = grading.KIND_ORDER
    rng = random.Random(2)
    rows = [(rng.choice(["LOW", "MODERATE", "HIGH", None]), rng.choice([0.1, 0.5]), rng.randint(0, 2), rng.randint(1, 3), rng.randint(0, 1), rng.choice(kinds), rng.randint(0, 3)) for _ in range(200)]
    df = spark.createDataFrame(rows, "confidence string, score double, s long, mmsi long, clean_seg long, kind string, route_idx long").withColumn("start_ts", F.timestamp_seconds("s")).cache()
    got = [(r.confidence, r.score, r.s, r.mmsi, r.clean_seg, r.kind, r.route_idx) for r in sorted(grading.ordered(df, rows_a_part=20).collect(), key=lambda r: r.ord)]
    assert got == sorted(rows, key=lambda r: (-grading.CONFIDENCE.get(r[0], 0), -r[1], *r[2:5], kinds.index(r[5]), r[6]))


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(min(1.0, h)))


def test_far_apart_equals_all_pairs(spark):
    """Groups of one place, near the bound on both sides, over the pole and the antimeridian, and opposite ends of the earth."""
    rng, rows, want = random.Random(3), [(0, None, 1.0), (0, 1.0, None), (0, float("nan"), 1.0)], {}
    centres = [(0, 0), (60, 25), (89.9, 10), (-45, 179.9), (10, -180), (70, -179.5)]
    for g in range(1, 240):
        lat, lon = rng.choice(centres)
        size = rng.choice([0.0, 0.5, 0.9, 1.0, 1.1, 1.3, 3.0])
        pts = []
        for _ in range(rng.randint(1, 25)):
            away, angle = size * math.sqrt(rng.random()), rng.uniform(0, 2 * math.pi)
            y = max(-90.0, min(90.0, lat + away * math.sin(angle)))
            x = lon + away * math.cos(angle) / max(0.01, math.cos(math.radians(y)))
            pts.append((y, (x + 180) % 360 - 180))
        if g % 40 == 0:
            pts.append((float(-lat), float((lon + 360) % 360 - 180)))
        rows += [(g, *p) for p in pts] * rng.randint(1, 2)
        want[g] = max(metres(a, b) for a in pts for b in pts) >= 200_000
    assert 60 < sum(want.values()) < 180
    df = spark.createDataFrame(rows, "mmsi long, lat double, lon double")
    assert {r.mmsi: r.apart for r in extent.far_apart(df, ["mmsi"], 200_000.0).collect()} == want
    assert extent.far_apart(df.limit(0), ["mmsi"], 200_000.0).count() == 0


def test_an_identity_with_many_flips(spark):
    """100,000 segments of one identity, all at different places."""
    t = F.col("id")
    rows = spark.range(0, 100_000, 1, 4).select(F.timestamp_seconds(1_700_000_000 + t * 60).alias("ts"), F.lit(1).cast("long").alias("mmsi"), (F.when(t % 2 == 0, 59.0).otherwise(36.0) + t * 1e-6).alias("lat"), (F.lit(20.0) + t * 1e-6).alias("lon"))
    began = time.time()
    (row,) = track_quality(rows).collect()
    assert (row.verdict, row.usable, row.n_segments) == ("PROBABLE_MMSI_COLLISION", False, 100_000)
    assert time.time() - began < 60
