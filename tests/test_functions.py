import math
from datetime import datetime
from urllib.parse import quote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sealane.functions import ais, geo, identity


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def hav(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(math.sqrt(min(1, h)))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(*[st.floats(-80, 80)] * 4), min_size=1, max_size=20))
def test_haversine(spark, points):
    df = spark.createDataFrame(points, "a double, b double, c double, d double")
    for r in df.select("*", geo.haversine_m(*map(F.col, "abcd")).alias("m")).collect():
        assert abs(r.m - hav(r.a, r.b, r.c, r.d)) < 1e-3


def test_densify(spark):
    line = F.array(*[F.struct(F.lit(24.0).alias("lon"), F.lit(float(y)).alias("lat")) for y in (59, 60)])
    points = one(spark, geo.densify(line).alias("x")).x
    steps = [hav(a.lat, a.lon, b.lat, b.lon) for a, b in zip(points, points[1:])]
    assert max(steps) <= 2100 and points[0].lat == 59 and points[-1].lat == 60
    line = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(0.0).alias("lat")) for x in (179.9, -179.9)])
    assert all(abs(p.lon) > 179 for p in one(spark, geo.densify(line).alias("x")).x)


def test_angles(spark):
    r = one(spark, geo.angular_diff(F.lit(350.0), F.lit(10.0)).alias("d"), geo.initial_bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("b"))
    assert r.d == 20 and abs(r.b - 90) < 1e-9


@pytest.mark.parametrize("mmsi,flag,low", [(273000000, "Russian Federation", False), (375000000, "St Vincent & the Grenadines", True), (613000000, "Cameroon", True), (230000000, "Finland", False), (477000000, "Hong Kong", False), (999999999, None, False)])
def test_mid(spark, mmsi, flag, low):
    r = identity.decode_mmsi(spark.createDataFrame([(mmsi,)], "mmsi long")).first()
    assert (r.flag_from_mid, r.low_transparency_registry) == (flag, low)


def test_stations(spark):
    rows = [(2301234, "Coast station", "230"), (23012345, "Group of ships", "230"), (111230123, "SAR aircraft", "230"), (992301234, "Aid to navigation", "230"), (982301234, "Craft associated with parent ship", "230"), (970230123, "AIS-SART", "230")]
    got = {r.mmsi: r for r in identity.decode_mmsi(spark.createDataFrame([(m,) for m, _, _ in rows] + [(1234567890,), (None,)], "mmsi long")).collect()}
    assert all((got[m].station_class, got[m].mid) == (k, mid) for m, k, mid in rows)
    assert not got[1234567890].mmsi_valid and not got[None].mmsi_valid


@pytest.mark.parametrize("imo,present,valid", [("9074729", True, True), ("1234567", True, True), ("9074720", True, False), ("907472", True, False), ("", False, False), (None, False, False), ("IMO 9074729", True, True)])
def test_imo(spark, imo, present, valid):
    r = one(spark, identity.imo_present(F.lit(imo).cast("string")).alias("p"), identity.imo_valid(F.lit(imo).cast("string")).alias("v"))
    assert (r.p, r.v) == (present, valid)


@pytest.mark.parametrize("name", ["M/V Ex ample~*", "Åland & Co", "a+b=c?"])
def test_quoting(spark, name):
    assert one(spark, identity.quoted(F.lit(name)).alias("x")).x == quote(name)


def test_times(spark):
    r = one(
        spark, ais.first_epoch(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(1668075025)).alias("s"), ais.first_epoch(F.lit(1668075026035)).alias("ms"), ais.first_epoch(F.lit(12)).alias("none"),
        ais.go_time(F.lit("2024-01-02 03:04:05.678901234 +0000 UTC")).alias("go"), ais.go_time(F.lit("2024-01-02 03:04:05 +0200")).alias("off"), ais.go_time(F.lit("junk")).alias("bad"), ais.iso(F.timestamp_seconds(F.lit(1704067200))).alias("iso"),
    )
    assert r.s.year == 2022 and r.ms.microsecond == 35000 and r.none is None and r.bad is None
    assert r.go == datetime(2024, 1, 2, 3, 4, 5, 678901) and r.off == datetime(2024, 1, 2, 1, 4, 5) and r.iso == "2024-01-01T00:00:00Z"


def test_cleaning(spark):
    r = one(spark, ais.clean_text(F.lit(" NAME@@ ")).alias("a"), ais.clean_text(F.lit("@@@")).alias("b"), ais.below(F.lit(102.3), 102.3).alias("c"), ais.below(F.lit(10.7), 102.3).alias("d"), ais.below(F.lit(float("nan")), 360.0).alias("e"), ais.dimension(F.lit(160), F.lit(33)).alias("f"), ais.dimension(F.lit(0), F.lit(None)).alias("g"), ais.ship_type(F.lit(70)).alias("h"), ais.ship_type(F.lit(11)).alias("i"), ais.nav_status(F.lit(99)).alias("j"), ais.cargo_hazard(F.lit(81)).alias("k"), ais.loose_float(F.lit("1,234.5 km")).alias("l"))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i, r.j, r.k, r.l) == ("NAME", None, None, 10.7, None, 193, None, "Cargo", "Type 11", "Unknown (99)", "Category A (hazardous)", 1234.5)


def test_setting_names_are_the_published_ones():
    from sealane.plans.config import Thresholds

    given = {"gap_max_entry_dist_m": 9, "drag_strict_cog_stability": 0.9, "survey_min_lobe_share": 0.6, "survey_buffer_m": 8000, "impossible_kn": 70, "max_gap_for_continuity_s": 600, "jump": 1}
    th = Thresholds().with_known(given)
    assert (th.gap_max_entry_dist_m, th.drag_strict_cog_stability, th.survey_min_lobe_share, th.survey_buffer_m, th.impossible_kn, th.max_gap_for_continuity_s) == (9.0, 0.9, 0.6, 8000.0, 70.0, 600.0)


def test_flags_from_a_given_table(spark, tmp_path):
    from sealane.functions import identity

    (tmp_path / "mids.csv").write_text("mid,country\n740,Somewhere\n230, Finland \n12,short\n")
    mids = identity.read_mids(spark, str(tmp_path / "mids.csv"))
    ships = spark.createDataFrame([(740123456,), (230123456,), (503000001,)], "mmsi long")
    flags = lambda table: {r.mmsi: r.flag_from_mid for r in identity.decode_mmsi(ships, table).collect()}
    assert flags(mids) == {740123456: "Somewhere", 230123456: "Finland", 503000001: None}
    assert flags(None) == {740123456: None, 230123456: "Finland", 503000001: "Australia"}


def test_limits_are_settings(spark):
    from sealane.operators.quality import track_quality
    from sealane.operators.tracks import clean_segments

    fixes = spark.createDataFrame([(1, 0, 0.0), (1, 3600, 1.1), (1, 7200, 2.2)], "mmsi long, t long, lat double").selectExpr("mmsi", "timestamp_seconds(t) AS ts", "lat", "0.0D AS lon")
    assert clean_segments(fixes).agg({"clean_seg": "max"}).first()[0] == 2
    assert clean_segments(fixes, 80.0).agg({"clean_seg": "max"}).first()[0] == 0
    assert track_quality(fixes, max_kn=80.0).first().verdict == "CLEAN"
