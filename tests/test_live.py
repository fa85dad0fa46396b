"""Feeds, state, moving windows and whole runs on small landed data."""

import json
import zipfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from sealane.__main__ import main
from sealane.functions.geo import densify
from sealane.operators import grading, payloads, places
from sealane.plans import adapter, engine, incremental, publish, scratch
from sealane.plans.live_catalogue import messages
from sealane.sources import feed, readers, registry, routes
from sealane.streaming import state

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def tracks(spark):
    return adapter.tracks(spark, SF).cache()


def envelopes(spark, low, high, step=60):
    rows = spark.range(low, high, 1, 3)
    return rows.select(F.timestamp_seconds(int(T0.timestamp()) + F.col("id") * step).alias("ts"), (F.col("id") % 7).alias("mmsi"), F.concat(F.lit("v"), "id").alias("value"))


def test_feed_batches_prune_files(spark, tmp_path):
    folder = str(tmp_path / "feed")
    assert feed.read_feed(spark, folder).count() == 0
    assert [feed.land(envelopes(spark, k * 300, k * 300 + 300), folder, 50) for k in range(3)] == [1, 2, 3]
    feed.land(envelopes(spark, 0, 0), folder)
    (tmp_path / "feed/data/batch=9").mkdir()  # a landing that ended early has no index
    (tmp_path / "feed/data/batch=9/part.txt").write_text('{"t":1,"mmsi":1,"value":"lost"}\n')
    rows = feed.read_feed(spark, folder)
    assert rows.count() == 900 and {r.value for r in rows.collect()} == {f"v{k}" for k in range(900)}
    some = feed.read_feed(spark, folder, T0 + timedelta(hours=8), T0 + timedelta(hours=9))
    assert sorted(r.value for r in some.collect()) == sorted(f"v{k}" for k in range(480, 541))
    assert some.rdd.getNumPartitions() < rows.rdd.getNumPartitions() // 3
    # with pushdown the plan's own comparisons choose the files
    spark.conf.set(feed.PUSHDOWN, "true")
    try:
        pushed = feed.read_feed(spark, folder).where("ts >= timestamp'2024-01-01 08:00:00' AND ts < timestamp'2024-01-01 09:00:00' AND value LIKE 'v%' AND mmsi = 3")
        assert sorted(r.value for r in pushed.collect()) == sorted(f"v{k}" for k in range(480, 540) if k % 7 == 3)
        assert "ts#" not in [x for x in pushed._jdf.queryExecution().executedPlan().toString().split("\n") if "Filter" in x][0].split("isnotnull(value")[1]
    finally:
        spark.conf.unset(feed.PUSHDOWN)


def test_bounds_of_conditions():
    assert feed.bound_of(EqualTo(("mmsi",), 5)) == ("mmsi", 5, 5)
    assert feed.bound_of(GreaterThan(("mmsi",), 5)) == ("mmsi", 6, None)
    assert feed.bound_of(LessThanOrEqual(("ts",), datetime(1970, 1, 1, 0, 0, 1))) == ("t", None, 1_000_000)
    assert feed.bound_of(In(("mmsi",), (1, 2))) is None and feed.bound_of(EqualTo(("value",), "x")) is None


def test_feed_stream_restarts_and_keeps_its_limit(spark, tmp_path):
    folder, out, check = str(tmp_path / "feed"), str(tmp_path / "out"), str(tmp_path / "check")
    for k in range(3):
        feed.land(envelopes(spark, k * 300, k * 300 + 300), folder, 110)
    seen = []
    for n in range(5):
        if n == 2:
            feed.land(envelopes(spark, 900, 930), folder)
        q = feed.stream_feed(spark, folder, 250).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination(120)
        seen += [p["numInputRows"] for p in q.recentProgress]
    assert max(seen) == 250 and sum(seen) == 930
    rows = [r.value for r in spark.read.parquet(out).collect()]
    assert len(rows) == 930 and set(rows) == {f"v{k}" for k in range(930)}


def test_feed_replays_a_batch_that_failed(spark, tmp_path):
    folder, check, got = str(tmp_path / "feed"), str(tmp_path / "check"), {}
    feed.land(envelopes(spark, 0, 100), folder, 30)

    def keep(batch, k, fail=[True]):  # noqa: B006
        if k == 1 and fail:
            fail.clear()
            raise RuntimeError("lost")
        got[k] = sorted(r.value for r in batch.collect())

    for _ in range(4):
        q = feed.stream_feed(spark, folder, 40).writeStream.foreachBatch(keep).option("checkpointLocation", check).trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
        except Exception:
            pass
    assert [len(got[k]) for k in sorted(got)] == [40, 40, 20] and sorted(sum(got.values(), [])) == sorted(f"v{k}" for k in range(100))


def test_sources_by_name(spark, tmp_path, tracks):
    folder = str(tmp_path / "stream")
    feed.land(messages(tracks), folder)
    with pytest.warns(UserWarning, match="nobody"):
        positions, static = registry.collected(spark, {"stream": folder, "nobody": "x"}, bbox=(20.0, 50.0, 30.0, 65.0))
    want = tracks.where("lon BETWEEN 20 AND 30 AND lat BETWEEN 50 AND 65")
    assert positions.count() == want.count() and positions.select("mmsi", "ts", "lat", "lon", "sog", "cog").exceptAll(want.select("mmsi", "ts", "lat", "lon", "sog", "cog")).count() == 0
    assert static.count() == 0 and registry.collected(spark, {})[0].count() == 0


def test_state_equals_the_batch_answer(spark, tmp_path, tracks):
    """Landings out of order, one of them twice, and rows without a place."""
    folder = str(tmp_path / "in")
    half = tracks.withColumn("even", F.pmod(F.unix_seconds("ts"), F.lit(480)) == 0).cache()
    bad = half.where("even").withColumn("lat", F.lit(None).cast("double"))
    for part in (half.where("NOT even"), half.where("even"), half.where("even"), bad):
        part.drop("even").coalesce(1).write.mode("append").parquet(folder)
        rows = spark.readStream.schema(tracks.schema).parquet(folder)
        state.learn(rows, str(tmp_path / "grown"), str(tmp_path / "check")).awaitTermination(180)
    want = {(r.cell_y, r.cell_x): r.vessels for r in places.learned_cells(places.stopped_cells(tracks)).collect()}
    assert {(r.cell_y, r.cell_x): r.vessels for r in state.learned(spark, str(tmp_path / "grown")).collect()} == want


def test_state_learns_more_than_a_batch_of_a_feed(spark, tmp_path):
    """Vessels that stop once each, in landings of several batches; a new query goes on after the last one."""
    folder, seen = str(tmp_path / "feed"), []
    stops = lambda low, high: spark.range(low, high, 1, 2).select(F.timestamp_seconds(int(T0.timestamp()) + F.col("id")).alias("ts"), (F.lit(230000000) + F.col("id")).alias("mmsi"), F.lit(59.85).alias("lat"), F.lit(24.8).alias("lon"), F.lit(0.1).alias("sog"), F.lit(90.0).alias("cog"), F.lit("Moored").alias("nav_status"))
    for low, high in ((0, 400), (400, 700), (300, 700)):
        feed.land(messages(stops(low, high)), folder, 70)
        rows = readers.stream_positions(readers.messages(feed.stream_feed(spark, folder, 150)))
        state.learn_all(rows, str(tmp_path / "grown"), str(tmp_path / "check"))
        seen += [r.vessels for r in state.learned(spark, str(tmp_path / "grown")).collect()]
    assert seen == [400, 700, 700]


def test_incremental_steps_equal_a_full_run(spark, tmp_path, tracks):
    """As fixes come and the window moves on, the kept detections are those of a full run over the window."""
    line = adapter.meridian(spark)
    kept, archive, before = incremental.Kept(spark, str(tmp_path / "kept")), str(tmp_path / "archive"), None
    for low, high, since in ((0, 9_000, T0), (9_000, 90_000, T0 + timedelta(seconds=3_000))):
        fresh = tracks.where(F.unix_seconds("ts").between(int(T0.timestamp()) + low, int(T0.timestamp()) + high - 1))
        incremental.step(kept, archive, fresh, since, line, before=before)
        before = since
    full = engine.run(tracks.where((F.unix_seconds("ts") < int(T0.timestamp()) + high) & (F.col("ts") >= F.lit(since))), line)
    rows = lambda df: sorted(map(str, df.select("detection_id", "kind", "mmsi", "score", "confidence", "ord").collect()))
    assert rows(incremental.current(kept)) == rows(full.detections)
    full.release()
    change = {r.change for r in incremental.changes(kept.read(1), kept.read()).collect()}
    assert change and change <= {"new", "gone", "regraded"}


def test_zipped_days_go_by_their_header(spark, tmp_path):
    header = ["# Timestamp", "Type of mobile", "MMSI", "Latitude", "Longitude", "Navigational status", "SOG", "COG", "Heading", "Name", "Ship type", "Destination"]
    row = lambda k: {"# Timestamp": f"01/02/2024 00:00:{k:02d}", "Type of mobile": "Class A", "MMSI": str(200 + k % 3), "Latitude": "59.8", "Longitude": "24.8", "Navigational status": "Moored", "SOG": "1.5" if k else "x", "COG": "90", "Heading": "", "Name": f'"N, {k}"', "Ship type": "Cargo", "Destination": "Unknown"}
    rows = [row(k) for k in range(20)] + [row(30) | {"Type of mobile": "Base Station"}, row(31) | {"Latitude": "north"}, row(32) | {"Longitude": "99"}]
    for n, order in enumerate((header, header[::-1])):
        text = ",".join(order) + ",Extra\n" + "".join(",".join(r[c] for c in order) + ",z\n" for r in rows)
        with zipfile.ZipFile(tmp_path / f"day{n}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("readme.txt", "x")
            z.writestr("day.CSV", text)
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("readme.txt", "x")
    daily = readers.zipped_daily_rows(spark, str(tmp_path), (20.0, 55.0, 30.0, 66.0))
    got = readers.daily_positions(daily).collect()
    assert len(got) == 40 and sum(r.sog is None for r in got) == 2 and {r.nav_status for r in got} == {"Moored"} and all(r.heading is None for r in got)
    static = {r.mmsi: r for r in readers.daily_static(daily).collect()}
    assert set(static) == {200, 201, 202} and static[200].destination is None and static[200].name.startswith("N, ") and static[200].imo is None


def test_newest_files_alone_are_read(spark, tmp_path):
    folder = tmp_path / "static"
    for day in range(5):
        spark.createDataFrame([(day, f"n{day}")], "mmsi long, name string").coalesce(1).write.parquet(str(tmp_path / "x" / str(day)))
        folder.mkdir(exist_ok=True)
        next((tmp_path / "x" / str(day)).glob("*.parquet")).rename(folder / f"2024010{day}T000000-00000.parquet")
    (folder / "19990101T000000-00000.parquet").write_text("not parquet")  # would fail if it were opened
    assert {r.mmsi for r in readers.archive_static(spark, str(folder), 3).collect()} == {2, 3, 4}
    from sealane.plans import program

    assert program.prune_static(spark, str(folder), 4) == ["19990101T000000-00000.parquet", "20240100T000000-00000.parquet"]
    (tmp_path / "none").mkdir()
    assert readers.archive_static(spark, str(tmp_path / "none")).count() == 0


def write_cables(folder):
    folder.mkdir(parents=True)
    line = {"type": "LineString", "coordinates": [[24.8, 59.6], [24.8, 60.1]]}
    far = {"type": "LineString", "coordinates": [[100.0, 1.0], [101.0, 1.0]]}
    make = lambda *shapes: json.dumps({"type": "FeatureCollection", "features": [{"properties": {"name": "Test cable"}, "geometry": s} for s in shapes]})
    (folder / "a.geojson").write_text(make(line, far))
    (folder / "a.meta.json").write_text(json.dumps({"positional_class": "charted", "source": "survey", "stated_accuracy_m": 50}))
    (folder / "b.json").write_text(make(line))
    (folder / "c.geojson").write_text(make(line))
    (folder / "c.meta.json").write_text("{broken")


def test_folder_routes_and_metadata(spark, tmp_path):
    write_cables(tmp_path / "cables")
    found = {r.cable_id: r for r in routes.folder_routes(spark, str(tmp_path / "cables"), (20.0, 55.0, 30.0, 66.0)).collect()}
    assert {k: (r.positional_class, r.source, r.stated_accuracy_m) for k, r in found.items()} == {
        "enc:survey:0:0": ("CHARTED", "survey", 50.0), "geo:local:b.json:0:0": ("DISPLAY", "local:b.json", None), "geo:local:c.geojson:0:0": ("DISPLAY", "local:c.geojson", None),
    }
    plain = spark.createDataFrame([("one", "o", "1,200 km"), ("one:1", None, None), ("two", "x", None)], "cable_id string, owners string, length string").select("cable_id", "owners", F.lit(None).cast("string").alias("rfs"), F.lit(5.0).alias("length_km"))
    meta = spark.createDataFrame([("one", "Owner", "1999", "1,500 km"), ("three", "?", "?", "?")], "id string, owners string, rfs string, length string")
    assert {r.cable_id: (r.owners, r.rfs, r.length_km) for r in routes.with_metadata(plain, meta).collect()} == {"one": ("Owner", "1999", 1500.0), "one:1": ("Owner", "1999", 1500.0), "two": ("x", None, 5.0)}


def test_outage_alerts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"data": [{"time": 1704067200, "datasource": "bgp", "level": "critical"}, {"time": "later"}, {"level": "x"}]}))
    (row,) = readers.outage_alerts(spark, str(tmp_path), "TW").collect()
    assert (row.fault_id, row.end - row.start, row.kind, row.radius_km, row.lat) == ("outage:TW:1704067200:bgp", timedelta(hours=6), "passive_outage", 400.0, None)


def test_track_payloads(spark):
    fix = lambda s, lon, lat, sog: (datetime.fromtimestamp(s, timezone.utc), lon, lat, sog, None)
    rows = [(1, [fix(0, 1.0, 2.0, 9.0), fix(60, 1.5, 2.0, 3.0), fix(7200, 2.0, 1.0, 9.0), fix(7260, 2.1, 1.0, None)]), (2, [fix(0, 179.0, 0.0, 1.0), fix(60, -179.5, 1.0, 8.0)]), (3, [fix(0, 1.0, 1.0, 1.0)]), (4, []), (5, None)]
    df = spark.createDataFrame(rows, "id long, track array<struct<ts:timestamp,lon:double,lat:double,sog:double,cog:double>>")
    got = {r.id: r for r in df.select("id", payloads.track_segments(F.col("track")).alias("s"), payloads.track_bounds(F.col("track")).alias("b")).collect()}
    assert [(x.kind, x.sog, x.seconds) for x in got[1].s] == [("slow", 3.0, 60.0), ("silent", 9.0, 7140.0), ("unknown", 0.0, 60.0)]
    assert tuple(got[1].b) == (1.0, 1.0, 2.1, 2.0) and tuple(got[2].b) == (179.0, 0.0, -179.5, 1.0) and got[3].s == [] == got[4].s and got[5].s is None and got[4].b is None is got[5].b
    links = spark.createDataFrame([([("g", "a", "u1"), ("h", "b", "u2"), ("g", "c", "u3")],)], "l array<struct<group:string,label:string,url:string>>")
    assert links.select(payloads.grouped_links(F.col("l")).alias("m")).first().m == {"g": [("a", "u1"), ("c", "u3")], "h": [("b", "u2")]}
    found = spark.createDataFrame([("loiter", "LOW"), ("loiter", "HIGH"), ("gap", None)], "kind string, confidence string")
    assert {tuple(r) for r in payloads.facets(found, ["kind", "confidence"]).collect()} == {("kind", "loiter", 2), ("kind", "gap", 1), ("confidence", "LOW", 1), ("confidence", "HIGH", 1)}
    assert payloads.chosen(found, {"kind": ["loiter"], "confidence": []}).count() == 2


def test_corridor_features_part_at_the_antimeridian(spark):
    line = [{"lon": 179.9, "lat": 10.0}, {"lon": -179.9, "lat": 10.0}]
    rows = spark.createDataFrame([(0, "c", "n", "DISPLAY", line)], "route_idx long, cable_id string, name string, positional_class string, line array<struct<lon:double,lat:double>>").withColumn("line", densify(F.col("line")))
    (feature,) = [json.loads(r.value) for r in publish.corridor_features(rows, 3000.0).collect()]
    parts = [p[0] for p in feature["geometry"]["coordinates"]]
    assert len(parts) == 2 and all(p[0] == p[-1] for p in parts) and all(-180 <= x <= 180 for p in parts for x, _ in p)
    assert {min(x for x, _ in p) for p in parts} == {-180.0, min(x for x, _ in parts[0])} and max(x for x, _ in parts[0]) == 180.0


def test_a_whole_run(spark, tmp_path, tracks):
    """From a landed feed to files, twice: the second run has nothing new to say.  Then a feed with nothing in it."""
    data, site = tmp_path / "data", tmp_path / "site"
    write_cables(data / "cables")
    feed.land(messages(tracks), str(data / "landed/stream"))
    (data / "faults.json").write_text(json.dumps([{"fault_id": "f1", "kind": "operator_notice", "start": "2024-01-01T01:00:00Z", "end": "2024-01-01T03:00:00Z", "lat": 59.85, "lon": 24.8}]))
    (data / "incidents.json").write_text(json.dumps({"incidents": [{"id": 1}]}))
    (data / "cables/landing-points.geojson").write_text(json.dumps({"features": [{"properties": {"name": "Harbour"}, "geometry": {"coordinates": [24.9, 60.1]}}, {"properties": {}, "geometry": {"coordinates": [99.0, 1.0]}}]}))
    config = tmp_path / "settings.yml"
    config.write_text(f"name: gulf\nbbox: [9, 30, 31, 66]\nsources: [stream, nowhere]\ndata_dir: {data}\nsite_data_dir: {site}\nretain_days: 100000\n")
    from sealane.plans import program
    from sealane.plans.config import Settings

    settings, now = Settings.load(str(config)), datetime(2024, 1, 3, tzinfo=timezone.utc)
    first = program.run(spark, settings, now)
    assert first.code == 0 and first.changed and first.counts["positions_observed"] == tracks.count() and first.counts["routes"] == 3
    found = json.loads((site / "detections.json").read_text())
    assert found["counts"]["detections"] == len(found["detections"]) == first.counts["published"] > 0 and found["counts"]["routes_charted"] == 1
    one = found["detections"][0]
    assert one["confidence"] in ("HIGH", "MODERATE") and one["vessel"]["pivots"] and one["summary"] and one["benign_explanations"] and isinstance(one["evidence"], dict)
    assert any(d["corroboration"] for d in found["detections"])
    lines = lambda name: [json.loads(x) for p in sorted((site / name).glob("part-*")) for x in p.read_text().splitlines()]
    assert len(lines("cables.geojsonl")) == len(lines("corridors.geojsonl")) == 3 and len(lines("landing-points.geojsonl")) == 1
    assert len(lines("vessels.geojsonl")) == first.counts["vessels_observed"] and len(lines("track-quality.jsonl")) == first.counts["tracks_suspect"] and lines("faults.jsonl")[0]["start"] == "2024-01-01T01:00:00Z"
    watch = json.loads((site / "watchlist.json").read_text())
    assert watch["count"] == len(watch["vessels"]) == first.counts["in_corridor_now"] and json.loads((site / "incidents.json").read_text())["incidents"]
    again = program.run(spark, settings, now + timedelta(seconds=1))
    assert not again.changed and again.counts == first.counts
    assert main(["doctor", "--config", str(config)], spark) == 1
    late = program.run(spark, settings, now + timedelta(days=4000))
    assert late.code == 2 and json.loads((site / "detections.json").read_text())["counts"] == found["counts"]


def test_steps_leave_nothing_behind(spark, tracks):
    found = engine.run(tracks, adapter.meridian(spark))
    assert found.detections.count() == found.counts["detections"] and found.steps.paths
    paths = list(found.steps.paths)
    found.release()
    assert not any(scratch.children(spark, p) for p in paths)


def test_external_events_become_detections(spark, tmp_path):
    event = lambda k, kind, lon, **more: {"id": f"e{k}", "start": "2024-01-01T00:00:00.000Z", "end": None, "position": {"lat": 59.8, "lon": lon}, "vessel": {"ssvid": "230000001234"}, **more}
    (tmp_path / "gap.json").write_text(json.dumps({"entries": [event(1, "GAP", 24.801, gap={"durationHours": 12}), event(2, "GAP", 25.9), {"id": "e3", "start": "2024-01-01T00:00:00Z"}]}))
    (tmp_path / "enc.json").write_text(json.dumps({"entries": [event(4, "ENCOUNTER", 24.79, durationHours=0)]}))
    rows = readers.external_events(spark, str(tmp_path / "gap.json"), "GAP").unionByName(readers.external_events(spark, str(tmp_path / "enc.json"), "ENCOUNTER"))
    found = {r.kind: r for r in grading.external_detections(rows, adapter.meridian(spark), 3000.0).collect()}
    assert {k: (r.mmsi, r.cable_id, r.score, r.duration_s, r.confidence) for k, r in found.items()} == {"gfw_ais_off": (230000001, "t1", 0.5, 43_200.0, "LOW"), "gfw_encounter": (230000001, "t1", 0.3, 0.0, "LOW")}
    assert found["gfw_ais_off"].end_ts == found["gfw_ais_off"].start_ts and found["gfw_ais_off"].distance_to_route_m < 9_000


def test_first_values_and_state_export(spark):
    rows = spark.createDataFrame([(1, " ", None, 0), (1, "nan", "9", 1), (1, "SHIP", "8", 2), (2, None, None, 0)], "mmsi long, name string, imo string, _seq int")
    rows = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in ("ship_type", "destination", "callsign")])
    assert {r.mmsi: (r.name, r.imo) for r in readers.first_values(rows, "_seq").collect()} == {1: ("SHIP", "9"), 2: (None, None)}
    cells = spark.range(100).select(F.lit(1).cast("long").alias("cell_y"), F.lit(-2).cast("long").alias("cell_x"), F.col("id").alias("mmsi"))
    (row,) = places.exported(cells).collect()
    assert row.cell == "1:-2" and row.vessels == list(range(40))
