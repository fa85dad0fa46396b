"""The four track detectors, as plans over clean segments of usable tracks.

Each returns the common detection columns and a typed ``evidence`` struct.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sealane.functions.geo import angular_diff, haversine_m, initial_bearing
from sealane.operators import places
from sealane.operators.corridors import corridor_join, small, vertex_distance, vertices_within
from sealane.operators.tracks import seconds, slow_runs, stationarity, time_segments, track_payload, track_stats
from sealane.plans.config import Thresholds

#: What keeps a table that is read several times: persist(), or the caller's written steps.
Hold = Callable[[DataFrame], DataFrame]

FIX = ["mmsi", "ts"]
COMMON = ["kind", "mmsi", "clean_seg", "route_idx", "start_ts", "end_ts", "duration_s", "lat", "lon", "score", "confidence", "evidence", "track"]


def capped(confidence: Column, positional_class: Column) -> Column:
    return F.when(positional_class == "CHARTED", confidence).otherwise(F.lit("LOW"))


def _classes(routes: DataFrame) -> DataFrame:
    return routes.select("route_idx", "positional_class")


def _clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def drag_candidates(segments: DataFrame, baseline: DataFrame, th: Thresholds, hold: Hold = DataFrame.persist) -> tuple[DataFrame, DataFrame]:
    """(fixes of slow runs with a run key, statistics of the runs that look like a dragged anchor).

    All tests here are of the run alone, so routes are only joined to runs that pass them.
    """
    fixes = slow_runs(time_segments(segments, ["mmsi", "clean_seg"], gap_s=th.max_gap_for_continuity_s), band=(th.drag_min_sog, th.drag_max_sog))
    fixes = hold(fixes)
    key = ["mmsi", "clean_seg", "time_seg", "run"]
    s = track_stats(fixes, key).join(baseline, "mmsi", "left")
    s = s.where((F.col("duration_s") >= th.drag_min_duration_s) & (F.col("distance_m") >= th.drag_min_distance_m) & F.col("median_sog").between(th.drag_min_sog, th.drag_max_sog) & (F.col("cog_stability") >= th.drag_min_cog_stability))
    own = F.coalesce(F.col("baseline") >= th.drag_baseline_min_kn, F.lit(False))
    s = s.withColumn("test_basis", F.when(own, "self_referenced").otherwise("geometric_only"))
    s = s.withColumn("speed_ratio", F.when(own, F.col("median_sog") / F.col("baseline")))
    s = s.where(F.when(own, F.col("speed_ratio") <= th.drag_speed_ratio).otherwise((F.col("cog_stability") >= th.drag_strict_cog_stability) & (F.col("distance_m") >= th.drag_strict_distance_m)))
    speed = F.coalesce((F.lit(th.drag_speed_ratio) - F.col("speed_ratio")) / th.drag_speed_ratio, F.lit(0.4))
    steady = (F.col("cog_stability") - th.drag_min_cog_stability) / (1 - th.drag_min_cog_stability + 1e-9)
    score = F.lit(0.40) * F.least(F.lit(1.0), steady) + F.lit(0.35) * F.least(F.lit(1.0), F.col("distance_m") / 30000) + F.lit(0.25) * _clip(speed)
    return fixes, s.withColumn("score", F.round(score, 3))


def anchor_drag(segments: DataFrame, baseline: DataFrame, routes: DataFrame, th: Thresholds, hold: Hold = DataFrame.persist) -> DataFrame:
    fixes, runs = drag_candidates(segments, baseline, th, hold)
    key = ["mmsi", "clean_seg", "time_seg", "run"]
    fixes = fixes.join(runs.select(*key), key, "left_semi").select(*key, "ts", "lat", "lon", "sog", "cog", "nav_status")
    touched = corridor_join(fixes, routes, th.corridor_m, FIX, key).select(*key, "route_idx").distinct()
    pairs = fixes.join(touched, key)
    near = vertex_distance(pairs, routes, [*key, "ts", "lat", "lon"])
    w = W.partitionBy(*key, "route_idx").orderBy("ts")
    inside = near.withColumn("_in", F.col("vertex_m") <= th.corridor_m)
    step = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    inside = inside.withColumn("_step", F.when(F.col("_in") & F.lag("_in").over(w), step))
    by_route = inside.groupBy(*key, "route_idx").agg(F.min("vertex_m").alias("closest_m"), F.coalesce(F.sum("_step"), F.lit(0.0)).alias("inside_m"))
    out = by_route.join(runs, key).join(track_payload(fixes, key), key).join(small(_classes(routes)), "route_idx")
    level = F.when(F.col("test_basis") == "geometric_only", "LOW").when(F.col("score") >= 0.5, "MODERATE").otherwise("LOW")
    km = lambda c, digits: F.round(c / 1000, digits)
    evidence = F.struct(
        F.round("median_sog", 2).alias("median_sog_kn"), F.round("mean_sog", 2).alias("mean_sog_kn"), F.round("max_sog", 2).alias("max_sog_kn"),
        F.round("baseline", 2).alias("baseline_sog_kn"), F.round("speed_ratio", 3).alias("speed_ratio_vs_own_baseline"), "test_basis", F.round("cog_stability", 4).alias("cog_stability"),
        km(F.col("distance_m"), 2).alias("slow_run_distance_km"), F.when(F.col("inside_m") > 0, km(F.col("inside_m"), 2)).alias("in_corridor_distance_km"),
        F.col("closest_m").cast("long").alias("closest_approach_m"), F.col("n").alias("positions"), F.col("nav_statuses").alias("nav_status_reported"),
    )
    return out.select(F.lit("anchor_drag").alias("kind"), "mmsi", "clean_seg", "route_idx", "start_ts", "end_ts", "duration_s", "lat", "lon", "score", capped(level, F.col("positional_class")).alias("confidence"), evidence.alias("evidence"), "track")


def _in_reach(segments: DataFrame, hits: DataFrame, least: int, th: Thresholds, hold: Hold) -> DataFrame:
    """Time segments of those fixes of clean segments that are in reach of a route, route by route."""
    inside = segments.select(*FIX, "clean_seg", "lat", "lon", "sog", "cog", "nav_status").join(hits, FIX)
    inside = time_segments(inside, ["mmsi", "clean_seg", "route_idx"], gap_s=th.max_gap_for_continuity_s)
    n = F.count("*").over(W.partitionBy("mmsi", "clean_seg", "route_idx", "time_seg"))
    return hold(inside.withColumn("_n", n).where(F.col("_n") >= least).drop("_n"))


SEGMENT = ["mmsi", "clean_seg", "route_idx", "time_seg"]


def loiter_candidates(segments: DataFrame, hits: DataFrame, th: Thresholds, hold: Hold = DataFrame.persist) -> tuple[DataFrame, DataFrame]:
    fixes = _in_reach(segments, hits, 3, th, hold)
    s = track_stats(fixes, SEGMENT).where((F.col("duration_s") >= th.loiter_min_duration_s) & (F.col("mean_sog") <= th.loiter_max_sog))
    s = s.join(stationarity(fixes, SEGMENT), SEGMENT)
    only = lambda *labels: F.size(F.array_except("nav_statuses", F.array(*[F.lit(x) for x in labels]))) == 0
    s = s.where(F.col("verdict") != "BERTHED").where(~((F.size("nav_statuses") > 0) & only("Moored")))
    s = s.where(~(F.array_contains("nav_statuses", "At anchor") & (F.col("verdict") == "HOLDING_STATION") & (F.col("net_m") < 500)))
    score = F.least(F.lit(1.0), F.col("duration_s") / 86400) * 0.55 + (1 - F.least(F.lit(1.0), F.col("mean_sog") / 2)) * 0.20 + F.least(F.lit(1.0), F.col("net_m") / 2000) * 0.25
    return fixes, s.withColumn("score", F.round(score, 3))


def loiter(segments: DataFrame, hits: DataFrame, routes: DataFrame, th: Thresholds, cells: DataFrame | None = None, seeds: DataFrame | None = None, hold: Hold = DataFrame.persist) -> DataFrame:
    fixes, s = loiter_candidates(segments, hits, th, hold)
    s = hold(s)
    if cells is not None or seeds is not None:
        s = s.join(places.why_normal(s, SEGMENT, cells, seeds).select(*SEGMENT), SEGMENT, "left_anti")
    close = vertex_distance(fixes, routes, SEGMENT[:2] + ["time_seg"]).groupBy(*SEGMENT).agg(F.min("vertex_m").alias("closest_m"))
    out = s.join(close, SEGMENT).join(track_payload(fixes, SEGMENT), SEGMENT)
    still = F.struct(F.col("n").alias("positions"), F.round("spread_m", 1).alias("spread_m"), F.round("net_m", 1).alias("net_displacement_m"), F.round("drift_ratio", 3).alias("drift_ratio"), "verdict")
    evidence = F.struct(F.round("mean_sog", 2).alias("mean_sog_kn"), F.round(F.col("duration_s") / 3600, 2).alias("hours"), F.col("closest_m").cast("long").alias("closest_approach_m"), F.col("n").alias("positions"), F.col("nav_statuses").alias("nav_status_reported"), still.alias("stationarity"))
    return _low(out, "loiter", evidence)


def _low(out: DataFrame, kind: str, evidence: Column) -> DataFrame:
    return out.select(F.lit(kind).alias("kind"), "mmsi", "clean_seg", "route_idx", "start_ts", "end_ts", "duration_s", "lat", "lon", "score", F.lit("LOW").alias("confidence"), evidence.alias("evidence"), "track")


def survey_legs(fixes: DataFrame, keys: list[str] | None = None, tolerance: float = 35.0) -> DataFrame:
    """(keys, bearings, legs, dominant, share, balance) of each segment's courses between its fixes.

    The dominant course is the centre of the fullest 10-degree bin, the first on a tie; lobes are
    courses within ``tolerance`` degrees of it or of its opposite, and a leg ends where the lobe changes.
    """
    keys = keys or SEGMENT
    w = W.partitionBy(*keys).orderBy("ts")
    before = F.lag("lat").over(w), F.lag("lon").over(w)
    steps = fixes.withColumn("_m", haversine_m(*before, F.col("lat"), F.col("lon"))).withColumn("_brg", initial_bearing(*before, F.col("lat"), F.col("lon"))).where(F.col("_m") > 50)
    bins = steps.withColumn("_bin", F.least(F.lit(35), F.floor(F.col("_brg") / 10)).cast("int")).groupBy(*keys, "_bin").agg(F.count("*").alias("_k"))
    top = bins.groupBy(*keys).agg(F.max_by("_bin", F.struct("_k", -F.col("_bin"))).alias("_bin")).select(*keys, (F.col("_bin") * 10 + 5.0).alias("dominant"))
    lobe = F.when(angular_diff(F.col("_brg"), F.col("dominant")) <= tolerance, 1).when(angular_diff(F.col("_brg"), F.pmod(F.col("dominant") + 180, F.lit(360.0))) <= tolerance, -1).otherwise(0)
    marked = steps.join(top, keys).withColumn("_lobe", lobe)
    counts = marked.groupBy(*keys, "dominant").agg(F.count("*").alias("bearings"), F.count_if(F.col("_lobe") == 1).alias("_a"), F.count_if(F.col("_lobe") == -1).alias("_b"))
    turned = marked.where("_lobe != 0").withColumn("_turn", F.coalesce(F.col("_lobe") != F.lag("_lobe").over(w), F.lit(False)))
    legs = turned.groupBy(*keys).agg((F.count_if("_turn") + 1).alias("legs"))
    out = counts.join(legs, keys, "left")
    return out.select(*keys, "bearings", "dominant", F.coalesce("legs", F.lit(0)).alias("legs"), ((F.col("_a") + F.col("_b")) / F.col("bearings")).alias("share"), F.coalesce(F.least("_a", "_b") / F.nullif(F.greatest("_a", "_b"), F.lit(0)), F.lit(0.0)).alias("balance"))


def survey_candidates(segments: DataFrame, hits: DataFrame, th: Thresholds, hold: Hold = DataFrame.persist) -> tuple[DataFrame, DataFrame]:
    """(fixes in reach, statistics of the segments that look like a survey)."""
    fixes = _in_reach(segments, hits, 12, th, hold)
    s = track_stats(fixes, SEGMENT).where((F.col("duration_s") >= th.survey_min_duration_s) & (F.col("mean_sog") >= th.survey_min_sog))
    box = fixes.groupBy(*SEGMENT).agg(haversine_m(F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")).alias("extent_m"))
    s = s.join(box, SEGMENT).where(F.col("extent_m") >= th.survey_min_extent_m).join(survey_legs(fixes, tolerance=th.survey_reciprocal_tolerance_deg), SEGMENT)
    s = s.where((F.col("bearings") >= 10) & (F.col("share") >= th.survey_min_lobe_share) & (F.col("balance") >= th.survey_min_lobe_balance) & (F.col("legs") >= th.survey_min_legs))
    score = F.least(F.lit(1.0), F.col("legs") / 10) * 0.45 + F.col("balance") * 0.30 + F.least(F.lit(1.0), F.col("share")) * 0.25
    return fixes, s.withColumn("score", F.round(score, 3))


def survey_pattern(segments: DataFrame, hits: DataFrame, routes: DataFrame, th: Thresholds, hold: Hold = DataFrame.persist) -> DataFrame:
    fixes, s = survey_candidates(segments, hits, th, hold)
    s = s.join(track_payload(fixes, SEGMENT), SEGMENT)
    evidence = F.struct("legs", F.col("dominant").alias("primary_course_deg"), F.pmod(F.col("dominant") + 180, F.lit(360.0)).alias("reciprocal_course_deg"), F.round("share", 3).alias("lobe_share"), F.round("balance", 3).alias("lobe_balance"), F.round(F.col("duration_s") / 3600, 2).alias("hours"), F.round("mean_sog", 2).alias("mean_sog_kn"), F.round(F.col("extent_m") / 1000, 2).alias("pattern_extent_km"), F.lit(th.survey_buffer_m).alias("buffer_m"))
    return _low(s, "survey_pattern", evidence)


def corridor_gap(segments: DataFrame, hits: DataFrame, routes: DataFrame, th: Thresholds, hold: Hold = DataFrame.persist) -> DataFrame:
    """One detection for each route near either end of a long silence inside a clean segment.

    Only fixes at the ends of a silence meet the routes; silences with no end in a corridor look for
    routes with a vertex within ``gap_max_entry_dist_m``.
    """
    w = W.partitionBy("mmsi", "clean_seg").orderBy("ts")
    numbered = segments.select("mmsi", "clean_seg", "ts", "lat", "lon", "sog", "cog", F.row_number().over(w).alias("_k"), *[F.lag(c).over(w).alias(f"{c}0") for c in ("ts", "lat", "lon")])
    numbered = hold(numbered.withColumn("gap_s", seconds(F.col("ts")) - seconds(F.col("ts0"))))
    gaps = hold(numbered.where(F.col("gap_s").between(th.gap_min_s, th.gap_max_s)).select("mmsi", "clean_seg", "ts0", "ts", "lat0", "lon0", "lat", "lon", "gap_s", "_k"))
    # Twelve numbered fixes around each silence, fetched for the silences alone.
    asked = gaps.select("mmsi", "clean_seg", F.col("ts").alias("_gap"), F.explode(F.sequence(F.col("_k") - 6, F.col("_k") + 5)).alias("_k"))
    point = F.struct("ts", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), F.round("sog", 1).alias("sog"), F.round("cog", 1).alias("cog"))
    excerpts = asked.join(numbered.select("mmsi", "clean_seg", "_k", "ts", "lat", "lon", "sog", "cog"), ["mmsi", "clean_seg", "_k"]).groupBy("mmsi", F.col("_gap").alias("ts")).agg(F.array_sort(F.collect_list(point)).alias("track"))
    gaps = gaps.drop("_k").join(excerpts, ["mmsi", "ts"])
    key = ["mmsi", "ts"]
    sides = hits.groupBy(*FIX).agg(F.array_sort(F.collect_set("route_idx")).alias("routes"))
    none = F.array().cast("array<bigint>")
    gaps = gaps.join(sides.select("mmsi", F.col("ts").alias("ts0"), F.col("routes").alias("before")), ["mmsi", "ts0"], "left").join(sides.select(*FIX, F.col("routes").alias("after")), FIX, "left")
    gaps = gaps.withColumns({"before": F.coalesce("before", none), "after": F.coalesce("after", none)}).withColumn("near", F.array_union("before", "after"))
    inside, outside = gaps.where(F.size("near") > 0), gaps.where(F.size("near") == 0)
    ends = outside.select(*key, "lat", "lon").unionByName(outside.select(*key, F.col("lat0").alias("lat"), F.col("lon0").alias("lon")))
    close = vertices_within(ends, routes, th.gap_max_entry_dist_m, key).select(*key, "route_idx").distinct()
    whole = inside.withColumn("route_idx", F.explode("near")).unionByName(outside.join(close, key), allowMissingColumns=True)
    crossed = ((F.size("before") > 0) != (F.size("after") > 0)) | ((F.size("before") > 0) & (F.size("after") > 0) & (F.col("before") != F.col("after")))
    span = haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    whole = whole.withColumns({"crossed": crossed, "span_m": span})
    score = F.round(F.least(F.lit(1.0), F.col("gap_s") / 43200) * 0.6 + F.when(F.col("crossed"), 0.4).otherwise(0.1), 3)
    evidence = F.struct(F.round(F.col("gap_s") / 3600, 2).alias("gap_hours"), F.round(F.col("span_m") / 1000, 2).alias("reappearance_distance_km"), F.round(F.col("span_m") / 1852 / (F.col("gap_s") / 3600), 2).alias("implied_mean_speed_kn"), F.col("crossed").alias("corridor_crossed"), F.array(F.round("lon0", 5), F.round("lat0", 5)).alias("last_seen"), F.array(F.round("lon", 5), F.round("lat", 5)).alias("next_seen"))
    return whole.select(F.lit("corridor_gap").alias("kind"), "mmsi", "clean_seg", "route_idx", F.col("ts0").alias("start_ts"), F.col("ts").alias("end_ts"), F.col("gap_s").alias("duration_s"), ((F.col("lat0") + F.col("lat")) / 2).alias("lat"), ((F.col("lon0") + F.col("lon")) / 2).alias("lon"), score.alias("score"), F.lit("LOW").alias("confidence"), evidence.alias("evidence"), "track")
