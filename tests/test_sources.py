import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from sealane.plans import publish
from sealane.sources import readers, routes
from sealane.sources.schema import POSITIONS, STATIC, conform, empty
from sealane.streaming import jobs


def test_conform(spark):
    df = spark.createDataFrame([("12", "x", float("nan"), 5), ("bad", "1.5", 2.0, 6)], "mmsi string, lat string, lon double, extra int")
    rows = conform(df, POSITIONS).collect()
    assert len(rows) == 1 and rows[0].mmsi == 12 and rows[0].lat is None and rows[0].lon is None
    assert empty(spark, STATIC).columns == STATIC.names


def test_snapshot(spark, tmp_path):
    item = lambda m, lon, **p: {"mmsi": m, "geometry": {"coordinates": [lon, 59.8]}, "properties": p}
    (tmp_path / "a.json").write_text(json.dumps({"features": [item(1, 24.8, sog=102.3, cog=360, heading=511, navStat=5, timestampExternal=1704067200000), item(2, 50.0, sog=3.0, navStat=0, time=1704067200)]}))
    rows = readers.snapshot_positions(spark, str(tmp_path / "a.json"), (20.0, 55.0, 30.0, 66.0)).collect()
    assert len(rows) == 1 and rows[0].sog is None and rows[0].cog is None and rows[0].nav_status == "Moored" and rows[0].ts == datetime(2024, 1, 1)


def message(m, lat, sog=5.0, at="2024-01-01 00:00:00.5 +0000 UTC"):
    return json.dumps({"MessageType": "PositionReport", "MetaData": {"MMSI": m, "time_utc": at, "latitude": lat, "longitude": 24.8}, "Message": {"PositionReport": {"UserID": m, "Sog": sog, "Cog": 90.0, "NavigationalStatus": 12}}})


def test_stream_decode_and_archive(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    static = json.dumps({"MessageType": "ShipStaticData", "MetaData": {"MMSI": 1, "time_utc": "2024-01-01 00:00:01 +0000 UTC"}, "Message": {"ShipStaticData": {"Name": "SHIP@@", "ImoNumber": 0, "Type": 81, "Dimension": {"A": 100, "B": 20, "C": 0, "D": 0}}}})
    lines = [message(1, 59.8), message(1, 59.8), message(2, 95.0), "not json", static, message(3, 59.9, 102.3)]
    (land / "a.txt").write_text("\n".join(lines))
    parsed = readers.messages(spark.read.text(str(land)))
    rows = {r.mmsi: r for r in readers.stream_positions(parsed).collect()}
    assert set(rows) == {1, 3} and rows[3].sog is None and rows[1].nav_status == "Pushing ahead"
    s = readers.stream_static(parsed).first()
    assert (s.name, s.imo, s.length, s.width, s.ship_type) == ("SHIP", None, 120.0, None, "Tanker")
    q = jobs.to_archive(jobs.landed_messages(spark, str(land)), str(tmp_path / "arc"), str(tmp_path / "cp"), None)
    q.awaitTermination(120)
    got = readers.archive_positions(spark, str(tmp_path / "arc"), datetime(2024, 1, 1, tzinfo=timezone.utc))
    assert got.count() == 2 and got.columns == POSITIONS.names
    assert publish.prune(spark, str(tmp_path / "arc"), 45) == ["date=2024-01-01"]


def test_learning_is_idempotent(spark, tmp_path):
    src = tmp_path / "src"
    spark.range(8).select(F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("mmsi"), F.lit(59.85).alias("lat"), F.lit(24.8).alias("lon"), F.lit(0.1).alias("sog")).write.parquet(str(src))
    for k in range(2):
        rows = spark.readStream.schema("ts timestamp, mmsi long, lat double, lon double, sog double").parquet(str(src))
        jobs.learn_places(rows, str(tmp_path / f"state{k // 2}"), str(tmp_path / f"cp{k}")).awaitTermination(120)
    assert jobs.learned_state(spark, str(tmp_path / "state0")).count() == 8


def test_routes(spark, tmp_path):
    line = [[24.8, 59.6], [24.8, 60.1]]
    far = [[100.0, 1.0], [101.0, 1.0]]
    features = [{"properties": {"id": "c1", "name": "One"}, "geometry": {"type": "MultiLineString", "coordinates": [line, far]}}, {"properties": {"OBJNAM": "Two"}, "geometry": {"type": "LineString", "coordinates": line}}]
    (tmp_path / "r.json").write_text(json.dumps({"features": features}))
    path = str(tmp_path / "r.json")
    shown = routes.display_routes(spark, path, "layer")
    assert sorted(r.cable_id for r in shown.collect()) == ["1", "c1", "c1:1"]
    assert routes.display_routes(spark, path, "layer", (20.0, 55.0, 30.0, 66.0)).count() == 2
    charted = routes.charted_routes(spark, path, "enc1", bbox=(20.0, 55.0, 30.0, 66.0))
    assert {(r.cable_id, r.name, r.positional_class) for r in charted.collect()} == {("enc:enc1:0:0", "One", "CHARTED"), ("enc:enc1:1:0", "Two", "CHARTED")}
    whole = routes.assembled(charted, shown)
    assert [r.route_idx for r in whole.orderBy("route_idx").collect()] == [0, 1, 2, 3, 4]
    assert json.loads(publish.route_features(whole).first().value)["geometry"]["type"] == "LineString"


def test_faults(spark, tmp_path):
    good = {"fault_id": "f", "start": "2026-01-01T00:00:00Z", "end": "2026-01-01T01:00:00Z", "kind": "operator_notice"}
    for name, payload in (("a.json", [good, {"fault_id": "x", "start": "no"}]), ("b.json", {"faults": [good]})):
        (tmp_path / name).write_text(json.dumps(payload))
        rows = readers.faults(spark, str(tmp_path / name)).collect()
        assert len(rows) == 1 and rows[0].radius_km == 150


def test_daily_csv(spark, tmp_path):
    head = readers.DAILY.replace("`", "").replace(" string", "").replace(" double", "").split(", ")
    row = {"# Timestamp": "31/12/2023 23:59:58", "Type of mobile": "Class A", "MMSI": "219000000", "Latitude": "55.5", "Longitude": "12.5", "SOG": "0.1", "Name": "Unknown", "Callsign": "ABCD"}
    base = {**row, "Type of mobile": "Base Station"}
    (tmp_path / "d.csv").write_text("\n".join([",".join(head), *[",".join(r.get(h, "") for h in head) for r in (row, base)]]))
    rows = readers.daily_rows(spark, str(tmp_path / "d.csv"), (10.0, 50.0, 20.0, 60.0))
    got = readers.daily_positions(rows).collect()
    assert len(got) == 1 and got[0].ts == datetime(2023, 12, 31, 23, 59, 58)
    s = readers.daily_static(rows).first()
    assert s.name is None and s.callsign == "ABCD"
