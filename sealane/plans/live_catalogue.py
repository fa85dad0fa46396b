"""Registered queries of feeds, state, moving windows, outlines and payloads, on tracks made from ``events``."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealane.operators import grading, payloads, polygons
from sealane.operators.tracks import track_payload
from sealane.plans import adapter, incremental, scratch
from sealane.plans.catalogue import QUERIES, SQL, _t, query, sql  # noqa: F401
from sealane.sources import feed, readers, registry
from sealane.streaming import jobs, state

#: Seconds from the first fix of a track at which the tracks are cut into three landings.
CUTS = (4_800, 14_400)
T0 = 1_704_067_200


def messages(positions: DataFrame) -> DataFrame:
    """Envelopes (ts, mmsi, value) of the stream messages that would have carried these positions."""
    report = F.struct(F.col("mmsi").alias("UserID"), F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"), F.col("sog").alias("Sog"), F.col("cog").alias("Cog"), F.lit(511).cast("double").alias("TrueHeading"), F.when(F.col("nav_status") == "Moored", 5).otherwise(0).alias("NavigationalStatus"))
    meta = F.struct(F.col("mmsi").alias("MMSI"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.000000000 xx 'UTC'").alias("time_utc"))
    value = F.to_json(F.struct(F.lit("PositionReport").alias("MessageType"), meta.alias("MetaData"), F.struct(report.alias("PositionReport")).alias("Message")))
    return positions.select("ts", "mmsi", value.alias("value"))


def _parts(positions: DataFrame) -> list[DataFrame]:
    """The positions before, between and after the cuts."""
    t = F.unix_seconds("ts")
    edges = [None, *[T0 + c for c in CUTS], None]
    out = []
    for low, high in zip(edges, edges[1:], strict=False):
        part = positions if low is None else positions.where(t >= low)
        out.append(part if high is None else part.where(t < high))
    return out


@query("feed_window", f"SELECT mmsi, t, lat, lon, sog, cog FROM pos WHERE t BETWEEN {T0 + 3600} AND {T0 + 10800} AND lon BETWEEN 24.5 AND 25.0 AND lat BETWEEN 59.0 AND 60.0")
def feed_window(spark: SparkSession, d: str) -> DataFrame:
    """Positions of a time and an area from a landed feed: files of other times are never opened."""
    folder = scratch.folder(spark, "feed")
    for part in _parts(adapter.tracks(spark, d)):
        feed.land(messages(part), folder)
    start, end = (datetime.fromtimestamp(T0 + s, timezone.utc) for s in (3600, 10800))
    rows, _ = registry.collected(spark, {"stream": folder}, start, end, (24.5, 59.0, 25.0, 60.0))
    return rows.select("mmsi", _t("ts"), "lat", "lon", "sog", "cog")


@query("feed_stream", "SELECT mmsi, count(*) AS n, min(t) AS t0, max(t) AS t1, round(sum(lat), 6) AS lat_sum FROM pos GROUP BY mmsi")
def feed_stream(spark: SparkSession, d: str) -> DataFrame:
    """The archive after bounded runs over three landings: each run is a new query that goes on where the last one ended."""
    folder, positions = scratch.folder(spark, "feed"), adapter.tracks(spark, d)
    most = max(1, positions.count() // 2)
    for part in _parts(positions):
        feed.land(messages(part), folder)
        while jobs.drain(spark, folder, f"{folder}/archive", f"{folder}/checkpoint", rows_a_batch=most) == most:
            pass
    rows = spark.read.parquet(f"{folder}/archive")
    return rows.groupBy("mmsi").agg(F.count("*").alias("n"), F.min(F.unix_seconds("ts")).alias("t0"), F.max(F.unix_seconds("ts")).alias("t1"), F.round(F.sum("lat"), 6).alias("lat_sum"))


@query("learned_state", "SELECT * FROM learned")
def learned_state(spark: SparkSession, d: str) -> DataFrame:
    """Stopping places kept as state: the last landing comes first and one comes twice, the answer is the batch's."""
    folder = scratch.folder(spark, "places")
    one, two, three = _parts(adapter.tracks(spark, d))
    for part in (three, one.unionByName(two), two):
        feed.land(messages(part), folder)
        rows = readers.stream_positions(readers.messages(feed.stream_feed(spark, folder)))
        state.learn_all(rows, f"{folder}/grown", f"{folder}/checkpoint")
    return state.learned(spark, f"{folder}/grown")


@query(
    "redetected",
    """SELECT 'anchor_drag' AS kind, mmsi, (t1 - t0)::DOUBLE AS duration_s, score FROM drag d
      WHERE EXISTS (SELECT 1 FROM runfix r JOIN near x USING (mmsi, t) WHERE r.mmsi = d.mmsi AND r.clean_seg = d.clean_seg AND r.time_seg = d.time_seg AND r.run = d.run AND x.dist_m < 3000)
    UNION ALL SELECT 'loiter', mmsi, duration_s, score FROM loit WHERE verdict <> 'BERTHED'
    UNION ALL SELECT 'survey_pattern', mmsi, duration_s, round(least(1.0::DOUBLE, legs / 10::DOUBLE) * 0.45::DOUBLE + least(a, b)::DOUBLE / greatest(a, b) * 0.30::DOUBLE + least(1.0::DOUBLE, (a + b) / bearings::DOUBLE) * 0.25::DOUBLE, 3)
      FROM svsum JOIN svstat USING (mmsi, clean_seg, ts2) JOIN svleg USING (mmsi, clean_seg, ts2)
      WHERE duration_s >= 10800 AND mean_sog >= 2.5 AND extent_m >= 5000 AND bearings >= 10 AND (a + b) / bearings::DOUBLE >= 0.55 AND least(a, b)::DOUBLE / greatest(a, b) >= 0.30 AND legs >= 4
    UNION ALL SELECT 'corridor_gap', mmsi, gap_s, round(least(1.0::DOUBLE, gap_s / 43200) * 0.6::DOUBLE + CASE WHEN a_in <> b_in THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END, 3) FROM gap2 WHERE a_in OR b_in OR vm <= 25000""",
)
def redetected(spark: SparkSession, d: str) -> DataFrame:
    """Detections kept over three steps of fresh fixes, each of which looks at changed identities only."""
    folder, routes = scratch.folder(spark, "window"), adapter.meridian(spark)
    kept, since = incremental.Kept(spark, f"{folder}/detections"), datetime(2023, 12, 31, tzinfo=timezone.utc)
    for part in _parts(adapter.tracks(spark, d)):
        incremental.step(kept, f"{folder}/archive", part, since, routes)
    return incremental.current(kept).select("kind", "mmsi", "duration_s", "score")


@query("corridor_polygon_hits", "SELECT mmsi, t FROM pos WHERE lat BETWEEN 59.60 AND 60.10 AND 6371008.8::DOUBLE * cos(radians(lat)) * abs(radians(lon - 24.80::DOUBLE)) < 2990")
def corridor_polygon_hits(spark: SparkSession, d: str) -> DataFrame:
    """Positions in the outline of the corridor, but those within 10 m of the width, where chords may cut either way."""
    rings = polygons.corridor_polygons(adapter.meridian(spark), 3000.0).withColumnRenamed("route_idx", "polygon")
    p = adapter.tracks(spark, d).select("mmsi", "ts", "lat", "lon")
    away = F.lit(6371008.8) * F.cos(F.radians("lat")) * F.abs(F.radians(F.col("lon") - adapter.ROUTE_LON))
    inside = polygons.points_in_polygons(p.where((F.abs(away - 3000) > 10) & F.col("lat").between(*adapter.ROUTE_LAT)), rings, ["mmsi", "ts"])
    return inside.select("mmsi", _t("ts"))


@query(
    "global_order",
    """SELECT event_id, row_number() OVER (ORDER BY CASE event_id % 3 WHEN 0 THEN -2 WHEN 1 THEN -1 ELSE 0 END, -round(value / 100), epoch_us(ts), user_id, event_id % 2,
      CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END, event_id) AS ord FROM events""",
)
def global_order(spark: SparkSession, d: str) -> DataFrame:
    """The published order of rows with many ties, numbered by ranges and not by one task."""
    e = spark.read.parquet(f"{d}/events.parquet")
    kind = F.when(F.col("event_type") == "click", grading.KIND_ORDER[0]).when(F.col("event_type") == "view", grading.KIND_ORDER[1]).otherwise(grading.KIND_ORDER[2])
    level = F.when(F.col("event_id") % 3 == 0, "HIGH").when(F.col("event_id") % 3 == 1, "MODERATE").otherwise("LOW")
    rows = e.select("event_id", level.alias("confidence"), F.round(F.col("value") / 100).alias("score"), F.col("ts").alias("start_ts"), F.col("user_id").alias("mmsi"), F.pmod("event_id", F.lit(2)).alias("clean_seg"), kind.alias("kind"), F.col("event_id").alias("route_idx"))
    return grading.ordered(rows, rows_a_part=2_000).select("event_id", "ord")


@query(
    "track_segments",
    """SELECT mmsi, t, round(dt::DOUBLE, 3) AS seconds, round(sog, 1) AS sog, CASE WHEN dt > 1800 THEN 'silent' WHEN round(sog, 1) < 5 THEN 'slow' ELSE 'under_way' END AS kind, round(plon, 5) AS from_lon, round(lat, 5) AS to_lat
    FROM (SELECT *, t - lag(t) OVER w AS dt, lag(lon) OVER w AS plon FROM pos WINDOW w AS (PARTITION BY mmsi ORDER BY t)) WHERE dt IS NOT NULL""",
)
def track_segments(spark: SparkSession, d: str) -> DataFrame:
    payload = track_payload(adapter.tracks(spark, d), ["mmsi"])
    s = payload.select("mmsi", F.col("track"), F.posexplode(payloads.track_segments(F.col("track"))).alias("k", "s"))
    return s.select("mmsi", F.unix_seconds(F.get("track", F.col("k") + 1)["ts"]).alias("t"), F.round("s.seconds", 3).alias("seconds"), "s.sog", "s.kind", F.col("s.from.lon").alias("from_lon"), F.col("s.to.lat").alias("to_lat"))


@query("track_bounds", "SELECT mmsi, min(round(lon, 5)) AS west, min(round(lat, 5)) AS south, max(round(lon, 5)) AS east, max(round(lat, 5)) AS north FROM pos GROUP BY mmsi")
def track_bounds(spark: SparkSession, d: str) -> DataFrame:
    return track_payload(adapter.tracks(spark, d), ["mmsi"]).select("mmsi", payloads.track_bounds(F.col("track")).alias("b")).select("mmsi", "b.*")


@query("facets", "SELECT 'event_type' AS facet, event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY ALL")
def facets(spark: SparkSession, d: str) -> DataFrame:
    return payloads.facets(spark.read.parquet(f"{d}/events.parquet"), ["event_type", "user_id"])
