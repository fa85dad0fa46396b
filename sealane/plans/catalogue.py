"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealane.functions import ais, identity
from sealane.functions.geo import angular_diff, cell, haversine_m, initial_bearing
from sealane.operators import detectors, grading, places, tracks, vessels
from sealane.operators.corridors import corridor_join, nearest_route, vertex_distance
from sealane.operators.quality import track_quality
from sealane.plans import adapter
from sealane.plans.config import Thresholds
from sealane.plans.scratch import Steps
from sealane.sources.schema import POSITIONS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TH = Thresholds()

#: Named parts of the SQL; a query takes those that it names, and what these name.
PARTS = {
    "ev0": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, user_id % 8 AS role, value - floor(value) AS u, value FROM events",
    "ev": "SELECT *, n // 8 AS leg, n % 8 AS k FROM ev0",
    "pos": """SELECT 230000000 + user_id AS mmsi, CAST(1704067200 + 240 * n + CASE WHEN role = 4 AND n >= 30 THEN 25200 ELSE 0 END AS BIGINT) AS t,
        CASE role WHEN 0 THEN 59.85::DOUBLE WHEN 1 THEN 59.85::DOUBLE WHEN 2 THEN 59.62::DOUBLE + (user_id % 150) * 0.003::DOUBLE + (u - 0.5::DOUBLE) * 0.002::DOUBLE
          WHEN 3 THEN 59.80::DOUBLE + leg * 0.012::DOUBLE WHEN 4 THEN 59.85::DOUBLE WHEN 5 THEN 59.85::DOUBLE WHEN 6 THEN CASE WHEN n % 2 = 0 THEN 59.8::DOUBLE ELSE 35.9::DOUBLE END
          ELSE 59.70::DOUBLE + (u - 0.5::DOUBLE) * 0.0004::DOUBLE END AS lat,
        CASE role WHEN 0 THEN CASE WHEN n < 24 THEN 24.70::DOUBLE - (24 - n) * 0.0265::DOUBLE ELSE 24.70::DOUBLE + (n - 24) * 0.00486::DOUBLE END
          WHEN 1 THEN 24.70::DOUBLE + n * 0.00486::DOUBLE WHEN 2 THEN 24.80::DOUBLE + (0.5::DOUBLE - u) * 0.002::DOUBLE
          WHEN 3 THEN 24.765::DOUBLE + (CASE WHEN leg % 2 = 0 THEN k ELSE 7 - k END) * 0.00928::DOUBLE
          WHEN 4 THEN CASE WHEN n < 30 THEN 24.79::DOUBLE - (30 - n) * 0.0221::DOUBLE ELSE 24.95::DOUBLE + (n - 30) * 0.0221::DOUBLE END
          WHEN 5 THEN 24.30::DOUBLE + n * 0.0298::DOUBLE WHEN 6 THEN CASE WHEN n % 2 = 0 THEN 24.8::DOUBLE ELSE 14.5::DOUBLE END ELSE 24.801::DOUBLE + (u - 0.5::DOUBLE) * 0.0004::DOUBLE END AS lon,
        CASE role WHEN 0 THEN CASE WHEN n < 24 THEN 12::DOUBLE ELSE 2.2::DOUBLE END WHEN 1 THEN 2.2::DOUBLE WHEN 2 THEN 0.4::DOUBLE WHEN 3 THEN 4.2::DOUBLE WHEN 4 THEN 10::DOUBLE WHEN 5 THEN 13.5::DOUBLE WHEN 6 THEN 8::DOUBLE ELSE 0.1::DOUBLE END AS sog,
        CASE WHEN role IN (2, 7) THEN (CAST(floor(value * 7) AS BIGINT) % 360)::DOUBLE WHEN role = 3 THEN CASE WHEN leg % 2 = 0 THEN 90::DOUBLE ELSE 270::DOUBLE END ELSE 90::DOUBLE + (u - 0.5::DOUBLE) END AS cog,
        CASE WHEN role = 7 THEN 'Moored' ELSE 'Under way using engine' END AS nav_status FROM ev""",
    "legs0": "SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, t - lag(t) OVER w AS dt FROM pos WINDOW w AS (PARTITION BY mmsi ORDER BY t)",
    "legs1": "SELECT *, HAV(lat0,lon0,lat,lon) AS leg_m FROM legs0",
    "legs": "SELECT *, CASE WHEN dt > 0 THEN leg_m / 1852 / (dt / 3600.0::DOUBLE) END AS leg_kn FROM legs1",
    "segd": "SELECT *, CAST(sum(CASE WHEN leg_kn > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS clean_seg FROM legs",
    "qcount": "SELECT mmsi, count(*) AS n_positions, CAST(sum(CASE WHEN leg_kn > 60 THEN 1 ELSE 0 END) AS BIGINT) AS n_impossible_legs, max(leg_kn) AS max_kn, max(clean_seg) + 1 AS n_segments FROM segd GROUP BY mmsi",
    "centre": "SELECT mmsi, clean_seg, avg(lat) AS lat, avg(lon) AS lon FROM segd GROUP BY mmsi, clean_seg",
    "apart": "SELECT a.mmsi, max(HAV(a.lat,a.lon,b.lat,b.lon)) AS sep FROM centre a JOIN centre b ON a.mmsi = b.mmsi GROUP BY a.mmsi",
    "quality": "SELECT q.*, CASE WHEN n_impossible_legs = 0 THEN 'CLEAN' WHEN n_impossible_legs >= 4 AND sep >= 200000 THEN 'PROBABLE_MMSI_COLLISION' ELSE 'SUSPECT_DECODE' END AS verdict FROM qcount q JOIN apart USING (mmsi)",
    "good": "SELECT s.* FROM segd s JOIN quality q USING (mmsi) WHERE verdict <> 'PROBABLE_MMSI_COLLISION' AND n_positions >= 2",
    "tseg0": "SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY mmsi, clean_seg ORDER BY t) > 1800 THEN 1 ELSE 0 END AS late FROM good",
    "tseg": "SELECT *, CAST(sum(late) OVER (PARTITION BY mmsi, clean_seg ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS time_seg FROM tseg0",
    "run0": "SELECT *, coalesce(sog BETWEEN 0.3 AND 5.0, false) AS slow FROM tseg",
    "run1": "SELECT *, CAST(sum(CASE WHEN slow THEN 0 ELSE 1 END) OVER (PARTITION BY mmsi, clean_seg, time_seg ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM run0",
    "run2": "SELECT *, lag(lat) OVER w AS rlat, lag(lon) OVER w AS rlon, count(*) OVER (PARTITION BY mmsi, clean_seg, time_seg, run) AS k3 FROM run1 WHERE slow WINDOW w AS (PARTITION BY mmsi, clean_seg, time_seg, run ORDER BY t)",
    "runfix": "SELECT *, HAV(rlat,rlon,lat,lon) AS rm FROM run2 WHERE k3 >= 3",
    "runs": """SELECT mmsi, clean_seg, time_seg, run, count(*) AS n, min(t) AS t0, max(t) AS t1, (max(t) - min(t))::DOUBLE AS duration_s, coalesce(sum(rm), 0) AS distance_m, avg(sog) AS mean_sog, median(sog) AS median_sog, max(sog) AS max_sog,
        CASE WHEN count(CASE WHEN cog < 360 THEN 1 END) >= 3 THEN least(1.0::DOUBLE, sqrt(pow(avg(cos(radians(CASE WHEN cog < 360 THEN cog END))), 2) + pow(avg(sin(radians(CASE WHEN cog < 360 THEN cog END))), 2))) END AS stability, avg(lat) AS lat, avg(lon) AS lon FROM runfix GROUP BY ALL""",
    "base": "SELECT mmsi, CASE WHEN count(CASE WHEN sog > 1 THEN 1 END) >= 4 THEN quantile_cont(CASE WHEN sog > 1 THEN sog END, 0.75) ELSE max(sog) END AS baseline FROM pos GROUP BY mmsi",
    "drag0": "SELECT r.*, baseline, CASE WHEN baseline >= 6 THEN 'self_referenced' ELSE 'geometric_only' END AS basis, CASE WHEN baseline >= 6 THEN median_sog / baseline END AS ratio FROM runs r LEFT JOIN base USING (mmsi) WHERE duration_s >= 1800 AND distance_m >= 3000 AND median_sog BETWEEN 0.3 AND 5.0 AND stability >= 0.94",
    "drag": """SELECT *, round(0.40::DOUBLE * least(1.0::DOUBLE, (stability - 0.94::DOUBLE) / (1 - 0.94::DOUBLE + 1e-9::DOUBLE)) + 0.35::DOUBLE * least(1.0::DOUBLE, distance_m / 30000)
        + 0.25::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce((0.55::DOUBLE - ratio) / 0.55::DOUBLE, 0.4::DOUBLE))), 3) AS score FROM drag0
        WHERE CASE WHEN basis = 'self_referenced' THEN ratio <= 0.55 ELSE stability >= 0.985 AND distance_m >= 5000 END""",
    "vert": "SELECT 24.80::DOUBLE AS vlon, 59.60::DOUBLE + (60.10::DOUBLE - 59.60::DOUBLE) * i / 28 AS vlat FROM range(0, 29) x(i)",
    "near": "SELECT mmsi, t, 6371008.8::DOUBLE * cos(radians(lat)) * abs(radians(lon - 24.80::DOUBLE)) AS dist_m FROM good WHERE lat BETWEEN 59.60 AND 60.10",
    "hit": "SELECT g.*, dist_m FROM good g JOIN near USING (mmsi, t) WHERE dist_m < 3000",
    "wide": "SELECT g.*, dist_m FROM good g JOIN near USING (mmsi, t) WHERE dist_m < 15000",
    "stopped": "SELECT DISTINCT CAST(floor(lat / 0.02::DOUBLE) AS BIGINT) AS cell_y, CAST(floor(lon / 0.02::DOUBLE) AS BIGINT) AS cell_x, mmsi FROM pos WHERE coalesce(sog, 99) <= 1.0",
    "learned": "SELECT cell_y, cell_x, count(DISTINCT mmsi) AS vessels FROM stopped GROUP BY ALL",
    "lt0": "SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY mmsi, clean_seg ORDER BY t) > 1800 THEN 1 ELSE 0 END AS late2 FROM hit",
    "lt1": "SELECT *, CAST(sum(late2) OVER (PARTITION BY mmsi, clean_seg ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ts2 FROM lt0",
    "lt2": "SELECT *, HAV(avg(lat) OVER g, avg(lon) OVER g, lat, lon) AS far, HAV(lag(lat) OVER w, lag(lon) OVER w, lat, lon) AS m FROM lt1 WINDOW g AS (PARTITION BY mmsi, clean_seg, ts2), w AS (PARTITION BY mmsi, clean_seg, ts2 ORDER BY t)",
    "lt3": "SELECT mmsi, clean_seg, ts2, count(*) AS n, (max(t) - min(t))::DOUBLE AS duration_s, avg(sog) AS mean_sog, avg(lat) AS lat, avg(lon) AS lon, max(far) AS spread_m, coalesce(sum(m), 0) AS path_m, HAV(arg_min(lat, t), arg_min(lon, t), arg_max(lat, t), arg_max(lon, t)) AS net_m, max(nav_status) AS nav FROM lt2 GROUP BY ALL HAVING count(*) >= 3",
    "lt4": "SELECT *, CASE WHEN path_m > 1 THEN net_m / path_m ELSE 0 END AS ratio FROM lt3 WHERE duration_s >= 7200 AND mean_sog <= 2.0 AND nav <> 'Moored'",
    "loit": "SELECT *, CASE WHEN n < 2 OR spread_m < 60 THEN 'BERTHED' WHEN ratio < 0.25 THEN 'HOLDING_STATION' WHEN net_m > 500 THEN 'MAKING_GROUND' ELSE 'MANOEUVRING' END AS verdict, round(least(1.0::DOUBLE, duration_s / 86400) * 0.55::DOUBLE + (1 - least(1.0::DOUBLE, mean_sog / 2)) * 0.20::DOUBLE + least(1.0::DOUBLE, net_m / 2000) * 0.25::DOUBLE, 3) AS score FROM lt4",
    "around": "SELECT l.mmsi, l.clean_seg, l.ts2, max(vessels) AS vessels FROM loit l JOIN learned c ON abs(c.cell_y - CAST(floor(l.lat / 0.02::DOUBLE) AS BIGINT)) <= 1 AND abs(c.cell_x - CAST(floor(l.lon / 0.02::DOUBLE) AS BIGINT)) <= 1 GROUP BY ALL",
    "sv0": "SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY mmsi, clean_seg ORDER BY t) > 1800 THEN 1 ELSE 0 END AS late2 FROM wide",
    "sv1": "SELECT *, CAST(sum(late2) OVER (PARTITION BY mmsi, clean_seg ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ts2 FROM sv0",
    "sv2": "SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, count(*) OVER (PARTITION BY mmsi, clean_seg, ts2) AS k12 FROM sv1 WINDOW w AS (PARTITION BY mmsi, clean_seg, ts2 ORDER BY t)",
    "svstat": "SELECT mmsi, clean_seg, ts2, (max(t) - min(t))::DOUBLE AS duration_s, avg(sog) AS mean_sog, HAV(min(lat), min(lon), max(lat), max(lon)) AS extent_m FROM sv2 WHERE k12 >= 12 GROUP BY ALL",
    "svstep": """SELECT mmsi, clean_seg, ts2, t, (degrees(atan2(sin(radians(lon - plon)) * cos(radians(lat)), cos(radians(plat)) * sin(radians(lat)) - sin(radians(plat)) * cos(radians(lat)) * cos(radians(lon - plon)))) + 360) % 360 AS brg
        FROM sv2 WHERE k12 >= 12 AND HAV(plat,plon,lat,lon) > 50""",
    "svbin": "SELECT mmsi, clean_seg, ts2, least(35, CAST(floor(brg / 10) AS INTEGER)) AS bin, count(*) AS k FROM svstep GROUP BY ALL",
    "svdom": "SELECT mmsi, clean_seg, ts2, bin * 10 + 5.0::DOUBLE AS dominant FROM svbin QUALIFY row_number() OVER (PARTITION BY mmsi, clean_seg, ts2 ORDER BY k DESC, bin) = 1",
    "svlobe": """SELECT s.*, dominant, CASE WHEN least((brg - dominant + 720) % 360, 360 - (brg - dominant + 720) % 360) <= 35 THEN 1
        WHEN least((brg - dominant - 180 + 720) % 360, 360 - (brg - dominant - 180 + 720) % 360) <= 35 THEN -1 ELSE 0 END AS lobe FROM svstep s JOIN svdom USING (mmsi, clean_seg, ts2)""",
    "svturn": "SELECT *, CASE WHEN lobe <> lag(lobe) OVER (PARTITION BY mmsi, clean_seg, ts2 ORDER BY t) THEN 1 ELSE 0 END AS turn FROM svlobe WHERE lobe <> 0",
    "svleg": "SELECT mmsi, clean_seg, ts2, CAST(sum(turn) + 1 AS BIGINT) AS legs FROM svturn GROUP BY ALL",
    "svsum": "SELECT mmsi, clean_seg, ts2, dominant, count(*) AS bearings, count(CASE WHEN lobe = 1 THEN 1 END) AS a, count(CASE WHEN lobe = -1 THEN 1 END) AS b FROM svlobe GROUP BY ALL",
    "gap0": "SELECT mmsi, clean_seg, t, lat, lon, lag(t) OVER w AS t0, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM good WINDOW w AS (PARTITION BY mmsi, clean_seg ORDER BY t)",
    "gap1": "SELECT g.*, (g.t - t0)::DOUBLE AS gap_s, EXISTS (SELECT 1 FROM hit h WHERE h.mmsi = g.mmsi AND h.t = t0) AS a_in, EXISTS (SELECT 1 FROM hit h WHERE h.mmsi = g.mmsi AND h.t = g.t) AS b_in FROM gap0 g WHERE g.t - t0 BETWEEN 3600 AND 172800",
    "gap2": "SELECT *, (SELECT min(least(HAV(plat,plon,vlat,vlon), HAV(lat,lon,vlat,vlon))) FROM vert) AS vm FROM gap1",
}


def _hav(sql: str) -> str:
    """Write out HAV(lat1,lon1,lat2,lon2)."""
    while (at := sql.find("HAV(")) >= 0:
        depth, args, start, i = 1, [], at + 4, at + 4
        while depth:
            c = sql[i]
            depth += (c == "(") - (c == ")")
            if (c == "," and depth == 1) or not depth:
                args.append(sql[start:i].strip())
                start = i + 1
            i += 1
        a, b, c, d = args
        body = f"pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)"
        sql = f"{sql[:at]}12742017.6::DOUBLE * asin(sqrt(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {body})))){sql[i:]}"
    return sql


def sql(select: str) -> str:
    """A select with the parts that it needs in front of it."""
    import re

    needed: set[str] = set()

    def need(text: str) -> None:
        for name in PARTS:
            if name not in needed and re.search(rf"(\bFROM|\bJOIN|,)\s+{name}\b", text):
                needed.add(name)
                need(PARTS[name])

    need(select)
    parts = ", ".join(f"{name} AS ({_hav(PARTS[name])})" for name in PARTS if name in needed)
    return f"WITH {parts} {_hav(select)}" if parts else _hav(select)


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = sql(oracle)
        return f

    return register


def _t(c: str, name: str | None = None):
    return F.unix_seconds(c).alias(name or "t")


def _segmented(spark: SparkSession, d: str) -> DataFrame:
    return tracks.clean_segments(adapter.tracks(spark, d))


def _good(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(positions, clean segments of usable tracks); both are read by several branches."""
    steps = Steps(spark)
    segmented = steps.put(tracks.clean_segments(adapter.tracks(spark, d)))
    positions = segmented.select(*POSITIONS.names)
    quality = track_quality(positions, segmented)
    return positions, steps.put(segmented.join(quality.where("usable AND n_positions >= 2").select("mmsi"), "mmsi", "left_semi"))


@query("track_legs", "SELECT mmsi, t, dt::DOUBLE AS dt_s, round(leg_m, 3) AS leg_m, round(leg_kn, 6) AS leg_kn FROM legs")
def track_legs(spark, d):
    return tracks.legs(adapter.tracks(spark, d)).select("mmsi", _t("ts"), "dt_s", F.round("leg_m", 3).alias("leg_m"), F.round("leg_kn", 6).alias("leg_kn"))


@query("quality_verdict", "SELECT mmsi, verdict, n_positions, n_impossible_legs, round(max_kn, 6) AS max_implied_kn, n_segments FROM quality")
def quality_verdict(spark, d):
    return track_quality(adapter.tracks(spark, d)).select("mmsi", "verdict", "n_positions", "n_impossible_legs", F.round("max_implied_kn", 6).alias("max_implied_kn"), "n_segments")


@query("clean_segments", "SELECT mmsi, clean_seg, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM segd GROUP BY ALL")
def clean_segments(spark, d):
    return _segmented(spark, d).groupBy("mmsi", "clean_seg").agg(F.count("*").alias("n"), F.min(F.unix_seconds("ts")).alias("t0"), F.max(F.unix_seconds("ts")).alias("t1"))


@query("time_segments", "SELECT mmsi, clean_seg, time_seg, count(*) AS n FROM tseg GROUP BY ALL")
def time_segments(spark, d):
    return tracks.time_segments(_good(spark, d)[1], ["mmsi", "clean_seg"]).groupBy("mmsi", "clean_seg", "time_seg").agg(F.count("*").alias("n"))


@query("slow_runs_stats", "SELECT mmsi, clean_seg, time_seg, run, n, duration_s, round(distance_m, 3) AS distance_m, round(mean_sog, 6) AS mean_sog, median_sog, round(stability, 6) AS stability FROM runs")
def slow_runs_stats(spark, d):
    s = tracks.track_stats(tracks.slow_runs(tracks.time_segments(_good(spark, d)[1], ["mmsi", "clean_seg"])), ["mmsi", "clean_seg", "time_seg", "run"])
    return s.select("mmsi", "clean_seg", "time_seg", "run", "n", "duration_s", F.round("distance_m", 3).alias("distance_m"), F.round("mean_sog", 6).alias("mean_sog"), "median_sog", F.round("cog_stability", 6).alias("stability"))


@query("transit_baseline", "SELECT mmsi, round(baseline, 6) AS baseline FROM base")
def transit_baseline(spark, d):
    return tracks.transit_baseline(adapter.tracks(spark, d)).select("mmsi", F.round("baseline", 6).alias("baseline"))


@query("drag_candidates", "SELECT mmsi, time_seg, run, basis, score FROM drag")
def drag_candidates(spark, d):
    positions, good = _good(spark, d)
    return detectors.drag_candidates(good, tracks.transit_baseline(positions), TH)[1].select("mmsi", "time_seg", "run", F.col("test_basis").alias("basis"), "score")


@query(
    "drag_detections",
    """SELECT mmsi, 't1' AS cable_id, d.t0, d.t1, basis, score, CASE WHEN basis = 'geometric_only' THEN 'LOW' WHEN score >= 0.5 THEN 'MODERATE' ELSE 'LOW' END AS confidence, CAST(floor(closest) AS BIGINT) AS closest_approach_m
    FROM drag d JOIN (SELECT r.mmsi, r.clean_seg, r.time_seg, r.run, min(HAV(r.lat, r.lon, vlat, vlon)) AS closest FROM runfix r, vert GROUP BY ALL) c USING (mmsi, clean_seg, time_seg, run)
    WHERE EXISTS (SELECT 1 FROM runfix r JOIN near x USING (mmsi, t) WHERE r.mmsi = d.mmsi AND r.clean_seg = d.clean_seg AND r.time_seg = d.time_seg AND r.run = d.run AND x.dist_m < 3000)""",
)
def drag_detections(spark, d):
    positions, good = _good(spark, d)
    routes = adapter.meridian(spark)
    out = detectors.anchor_drag(good, tracks.transit_baseline(positions), routes, TH).join(F.broadcast(routes.select("route_idx", "cable_id")), "route_idx")
    return out.select("mmsi", "cable_id", _t("start_ts", "t0"), _t("end_ts", "t1"), F.col("evidence.test_basis").alias("basis"), "score", "confidence", "evidence.closest_approach_m")


@query(
    "loiter_detections",
    "SELECT l.mmsi, l.n, l.duration_s, l.verdict, round(l.spread_m, 3) AS spread_m, l.score FROM loit l LEFT JOIN around a USING (mmsi, clean_seg, ts2) WHERE l.verdict <> 'BERTHED' AND coalesce(a.vessels, 0) < 4",
)
def loiter_detections(spark, d):
    positions, good = _good(spark, d)
    routes = adapter.meridian(spark)
    hits = corridor_join(good, routes, TH.corridor_m, detectors.FIX)
    _, found = detectors.loiter_candidates(good, hits, TH)
    normal = places.why_normal(found, detectors.SEGMENT, places.stopped_cells(positions), None)
    return found.join(normal, detectors.SEGMENT, "left_anti").select("mmsi", "n", "duration_s", "verdict", F.round("spread_m", 3).alias("spread_m"), "score")


@query(
    "survey_detections",
    """SELECT mmsi, legs, dominant, round((a + b) / bearings::DOUBLE, 6) AS share, round(least(a, b)::DOUBLE / greatest(a, b), 6) AS balance,
    round(least(1.0::DOUBLE, legs / 10::DOUBLE) * 0.45::DOUBLE + least(a, b)::DOUBLE / greatest(a, b) * 0.30::DOUBLE + least(1.0::DOUBLE, (a + b) / bearings::DOUBLE) * 0.25::DOUBLE, 3) AS score
    FROM svsum JOIN svstat USING (mmsi, clean_seg, ts2) JOIN svleg USING (mmsi, clean_seg, ts2)
    WHERE duration_s >= 10800 AND mean_sog >= 2.5 AND extent_m >= 5000 AND bearings >= 10 AND (a + b) / bearings::DOUBLE >= 0.55 AND least(a, b)::DOUBLE / greatest(a, b) >= 0.30 AND legs >= 4""",
)
def survey_detections(spark, d):
    _, good = _good(spark, d)
    found = detectors.survey_candidates(good, corridor_join(good, adapter.meridian(spark), TH.survey_buffer_m, detectors.FIX), TH)[1]
    return found.select("mmsi", "legs", "dominant", F.round("share", 6).alias("share"), F.round("balance", 6).alias("balance"), "score")


@query(
    "corridor_gaps",
    """SELECT mmsi, t0, t AS t1, gap_s, (a_in <> b_in) AS crossed, round(least(1.0::DOUBLE, gap_s / 43200) * 0.6::DOUBLE + CASE WHEN a_in <> b_in THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END, 3) AS score
    FROM gap2 WHERE a_in OR b_in OR vm <= 25000""",
)
def corridor_gaps(spark, d):
    _, good = _good(spark, d)
    routes = adapter.meridian(spark)
    out = detectors.corridor_gap(good, corridor_join(good, routes, TH.corridor_m, detectors.FIX), routes, TH)
    return out.select("mmsi", _t("start_ts", "t0"), _t("end_ts", "t1"), F.col("duration_s").alias("gap_s"), F.col("evidence.corridor_crossed").alias("crossed"), "score")


@query("corridor_hits", "SELECT mmsi, t, 0::BIGINT AS route_idx, round(dist_m, 3) AS dist_m FROM near WHERE dist_m < 15000")
def corridor_hits(spark, d):
    return corridor_join(_good(spark, d)[1], adapter.meridian(spark), TH.survey_buffer_m, detectors.FIX).select("mmsi", _t("ts"), "route_idx", F.round("dist_m", 3).alias("dist_m"))


@query("nearest_route", "SELECT mmsi, round(min(HAV(lat, lon, vlat, vlon)), 3) AS nearest_m FROM (SELECT mmsi, arg_max(lat, t) AS lat, arg_max(lon, t) AS lon FROM pos GROUP BY mmsi) p, vert GROUP BY mmsi")
def nearest(spark, d):
    return nearest_route(vessels.latest_positions(adapter.tracks(spark, d)).persist(), adapter.meridian(spark), ["mmsi"]).select("mmsi", F.round("nearest_m", 3).alias("nearest_m"))


@query("vertex_distance", "SELECT mmsi, t, round(min(HAV(lat, lon, vlat, vlon)), 3) AS vertex_m FROM pos, vert GROUP BY mmsi, t")
def vertices(spark, d):
    pairs = adapter.tracks(spark, d).select("mmsi", "ts", "lat", "lon").withColumn("route_idx", F.lit(0).cast("long"))
    return vertex_distance(pairs, adapter.meridian(spark), ["mmsi", "ts"]).select("mmsi", _t("ts"), F.round("vertex_m", 3).alias("vertex_m"))


@query("learned_cells", "SELECT * FROM learned")
def learned(spark, d):
    return places.learned_cells(places.stopped_cells(adapter.tracks(spark, d)))


@query("stopping_stats", "SELECT count(*) AS cells_tracked, count(CASE WHEN vessels >= 4 THEN 1 END) AS cells_suppressing, 0 AS seed_points FROM learned")
def stopping_stats(spark, d):
    return places.stats(places.stopped_cells(adapter.tracks(spark, d)))


@query("latest_position", "SELECT mmsi, max(t) AS t, arg_max(lat, t) AS lat, arg_max(lon, t) AS lon, arg_max(sog, t) AS sog, arg_max(nav_status, t) AS nav_status FROM pos GROUP BY mmsi")
def latest(spark, d):
    return vessels.latest_positions(adapter.tracks(spark, d)).select("mmsi", _t("ts"), "lat", "lon", "sog", "nav_status")


@query(
    "corridor_watchlist",
    """SELECT mmsi, round(sog, 1) AS sog, CAST(floor(nearest) AS BIGINT) AS nearest_m FROM (SELECT mmsi, lat, lon, sog, min(HAV(lat, lon, vlat, vlon)) AS nearest FROM (SELECT mmsi, arg_max(lat, t) AS lat, arg_max(lon, t) AS lon, arg_max(sog, t) AS sog FROM pos GROUP BY mmsi) p, vert GROUP BY ALL)
    WHERE lat BETWEEN 59.60 AND 60.10 AND 6371008.8::DOUBLE * cos(radians(lat)) * abs(radians(lon - 24.80::DOUBLE)) < 3000""",
)
def corridor_watchlist(spark, d):
    return vessels.watchlist(vessels.vessel_layer(adapter.tracks(spark, d).persist(), adapter.meridian(spark))).select("mmsi", "sog", "nearest_m")


@query("repeat_presence", "SELECT user_id AS mmsi, event_type AS cable_id, count(*) AS events, count(DISTINCT CAST(ts AS DATE)) AS days, strftime(min(ts), '%Y-%m-%d') AS first_day FROM events GROUP BY ALL HAVING count(*) >= 2")
def repeats(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("mmsi"), F.col("event_type").alias("cable_id"), F.col("ts").alias("start_ts"))
    return grading.repeat_presence(e).select("mmsi", "cable_id", "events", F.size("windows").cast("long").alias("days"), F.get("windows", F.lit(0)).alias("first_day"))


FAULTS = [("f1", "operator_notice", 1704070800, 1704078000, 59.85, 24.80, 150.0), ("f2", "passive_outage", 1704067200, 1704070800, None, None, 150.0), ("f3", "grid_capacity", 1706745600, 1706749200, 59.85, 24.80, 150.0)]


@query(
    "corroborated",
    """SELECT mmsi, count(*) AS faults, CASE WHEN bool_or(kind IN ('operator_notice', 'grid_capacity')) THEN 'HIGH' ELSE 'MODERATE' END AS confidence
    FROM (SELECT d.*, f.kind FROM drag d, (VALUES ('f1', 'operator_notice', 1704070800, 1704078000, 59.85::DOUBLE, 24.80::DOUBLE), ('f2', 'passive_outage', 1704067200, 1704070800, NULL, NULL), ('f3', 'grid_capacity', 1706745600, 1706749200, 59.85, 24.80)) f(id, kind, f0, f1, flat, flon)
      WHERE d.t0 <= f.f1 + 43200 AND f.f0 - 43200 <= d.t1 AND (flat IS NULL OR HAV(d.lat, d.lon, flat, flon) <= 150000)) GROUP BY mmsi""",
)
def corroborated(spark, d):
    positions, good = _good(spark, d)
    found = detectors.drag_candidates(good, tracks.transit_baseline(positions), TH)[1]
    found = found.select("mmsi", "start_ts", "end_ts", "lat", "lon", F.lit("anchor_drag").alias("kind"), F.lit("CHARTED").alias("positional_class"), F.lit("LOW").alias("confidence"), grading.detection_id(F.col("mmsi").cast("string"), ais.iso(F.col("start_ts"))).alias("detection_id"))
    faults = spark.createDataFrame(FAULTS, "fault_id string, kind string, t0 long, t1 long, lat double, lon double, radius_km double")
    faults = faults.select("fault_id", "kind", F.timestamp_seconds("t0").alias("start"), F.timestamp_seconds("t1").alias("end"), "lat", "lon", "radius_km", F.lit("").alias("asset"))
    out = grading.corroborate(found, faults).where("corroboration IS NOT NULL")
    return out.select("mmsi", F.size("corroboration").cast("long").alias("faults"), "confidence")


@query("detection_id", "SELECT o_orderkey, substring(sha1('drag|' || CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus), 1, 12) AS detection_id FROM orders")
def ids(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", grading.detection_id(F.lit("drag"), F.col("o_custkey").cast("string"), F.col("o_orderstatus")).alias("detection_id"))


_MMSI = "(201000000 + (o_orderkey * 7919) % 580000000)"


def _mid_values() -> str:
    return ", ".join(f"('{mid}', '{country}')" for mid, country in identity.MIDS.items())


@query(
    "mid_decode",
    f"""SELECT o_orderkey, station_class, m.mid, country AS flag, coalesce(country IN ({", ".join(f"'{c}'" for c in identity.LOW_TRANSPARENCY)}), false) AS low FROM (SELECT o_orderkey,
      CASE WHEN s LIKE '98%' THEN 'Craft associated with parent ship' WHEN s LIKE '99%' THEN 'Aid to navigation' ELSE 'Ship station' END AS station_class, CASE WHEN s LIKE '98%' OR s LIKE '99%' THEN substring(s, 3, 3) ELSE substring(s, 1, 3) END AS mid
      FROM (SELECT o_orderkey, CAST({_MMSI} AS VARCHAR) AS s FROM orders)) m LEFT JOIN (VALUES {_mid_values()}) v(mid, country) ON m.mid = v.mid""",
)
def mid_decode(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.expr(f"CAST({_MMSI} AS BIGINT)").alias("mmsi"))
    return identity.decode_mmsi(o).select("o_orderkey", "station_class", "mid", F.col("flag_from_mid").alias("flag"), F.col("low_transparency_registry").alias("low"))


@query(
    "imo_check",
    """SELECT o_orderkey, (substring(s,1,1)::INT * 7 + substring(s,2,1)::INT * 6 + substring(s,3,1)::INT * 5 + substring(s,4,1)::INT * 4 + substring(s,5,1)::INT * 3 + substring(s,6,1)::INT * 2) % 10 = substring(s,7,1)::INT AS valid
    FROM (SELECT o_orderkey, CAST(1000000 + (o_orderkey * 7919) % 8999999 AS VARCHAR) AS s FROM orders)""",
)
def imo_check(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", identity.imo_valid(F.concat(F.lit("IMO "), F.expr("CAST(1000000 + (o_orderkey * 7919) % 8999999 AS STRING)"))).alias("valid"))


@query("identity_churn", "SELECT c_nationkey AS mmsi, count(DISTINCT trim(c_mktsegment)) AS names, count(DISTINCT trim(c_mktsegment)) > 1 AS changed, min(trim(c_mktsegment)) AS name FROM customer GROUP BY ALL")
def identity_churn(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    none = F.lit(None).cast("string")
    static = c.select(F.col("c_nationkey").cast("long").alias("mmsi"), F.col("c_mktsegment").alias("name"), *[none.alias(x) for x in ("callsign", "imo", "ship_type", "destination", "cargo_type", "eta")], *[F.lit(None).cast("double").alias(x) for x in ("length", "width", "draught")], F.col("c_custkey").alias("_seq"))
    out = vessels.dossiers(static)
    return out.select(F.col("mmsi").cast("int").alias("mmsi"), F.size("names").cast("long").alias("names"), (F.size("identity_churn") > 0).alias("changed"), "name")


@query("dossier_pivots")
def dossier_pivots(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    lat, lon = F.lit(59.85), F.lit(24.8)
    out = s.select(F.col("s_suppkey"), F.explode(identity.pivots(F.col("s_suppkey"), F.lit("9074729"), F.col("s_name"), lat, lon)).alias("p"))
    return out.select("s_suppkey", "p.group", "p.label", "p.url")


@query("nav_status_decode", "SELECT o_orderkey, CASE o_orderkey % 20 WHEN 0 THEN 'Under way using engine' WHEN 1 THEN 'At anchor' WHEN 5 THEN 'Moored' ELSE 'other' END AS label, CASE WHEN o_orderkey % 20 > 15 THEN 'Unknown (' || CAST(o_orderkey % 20 AS VARCHAR) || ')' END AS unknown FROM orders")
def nav_status_decode(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", ais.nav_status(F.pmod("o_orderkey", F.lit(20))).alias("s"))
    return o.select("o_orderkey", F.when(F.col("s").isin("Under way using engine", "At anchor", "Moored"), F.col("s")).otherwise("other").alias("label"), F.when(F.col("s").startswith("Unknown"), F.col("s")).alias("unknown"))


@query("sentinel_clean", "SELECT event_id, CASE WHEN value < 102.3 THEN value END AS sog, CASE WHEN value < 360 THEN value END AS cog, CASE WHEN value < 511 THEN value END AS heading FROM events")
def sentinel_clean(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", *[ais.below(F.col("value"), s).alias(c) for c, s in (("sog", ais.SOG_NONE), ("cog", ais.COG_NONE), ("heading", ais.HEADING_NONE))])


@query("ts_unit", "SELECT event_id, CAST(1600000000 + event_id AS BIGINT) AS t FROM events")
def ts_unit(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    raw = F.lit(1600000000) + F.col("event_id")
    mixed = F.when(F.col("event_id") % 2 == 0, raw * 1000).otherwise(raw)
    return e.select("event_id", F.unix_seconds(ais.first_epoch(F.lit(5), mixed)).alias("t"))


@query("bearing_and_turn", "SELECT mmsi, t, round((degrees(atan2(sin(radians(lon - lon0)) * cos(radians(lat)), cos(radians(lat0)) * sin(radians(lat)) - sin(radians(lat0)) * cos(radians(lat)) * cos(radians(lon - lon0)))) + 360) % 360, 6) AS bearing FROM legs WHERE leg_m > 1")
def bearings(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("mmsi").orderBy("ts")
    p = adapter.tracks(spark, d).withColumns({"lat0": F.lag("lat").over(w), "lon0": F.lag("lon").over(w)})
    p = p.where(haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")) > 1)
    return p.select("mmsi", _t("ts"), F.round(initial_bearing(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")), 6).alias("bearing"))


@query("angular_difference", "SELECT event_id, round(least((value - 90 + 720) % 360, 360 - (value - 90 + 720) % 360), 6) AS diff FROM events")
def angular(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.round(angular_diff(F.col("value"), F.lit(90.0)), 6).alias("diff"))


@query("grid_cells", "SELECT mmsi, t, CAST(floor(lat / 0.02::DOUBLE) AS BIGINT) AS cell_y, CAST(floor(lon / 0.02::DOUBLE) AS BIGINT) AS cell_x FROM pos")
def grid_cells(spark, d):
    return adapter.tracks(spark, d).select("mmsi", _t("ts"), cell(F.col("lat")).alias("cell_y"), cell(F.col("lon")).alias("cell_x"))


@query("clean_strings", "SELECT p_partkey, nullif(trim(trim(trim(p_name), '@')), '') AS name FROM part")
def clean_strings(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", ais.clean_text(F.concat(F.lit(" "), F.col("p_name"), F.lit("@@@ "))).alias("name"))
