"""What happens to detections after they are found: ids, order, repeats, faults, external events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealane.functions.ais import iso
from sealane.functions.geo import haversine_m
from sealane.operators.corridors import nearest_route
from sealane.operators.order import ROWS_A_PART, numbered

CONFIDENCE = {"LOW": 0, "MODERATE": 1, "HIGH": 2}
KIND_ORDER = ["corridor_gap", "anchor_drag", "loiter", "survey_pattern"]
SLACK_HOURS = 12
STRONG = ("operator_notice", "grid_capacity")
FAULT_RADIUS_KM = 150.0
#: Kinds of external events and what they become.
EVENT_KINDS = {"GAP": "gfw_ais_off", "LOITERING": "gfw_loitering", "ENCOUNTER": "gfw_encounter"}


def rank(confidence: Column) -> Column:
    return F.when(confidence == "HIGH", 2).when(confidence == "MODERATE", 1).otherwise(0)


def detection_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)


def with_ids(found: DataFrame) -> DataFrame:
    parts = [F.col("kind"), F.col("mmsi").cast("string"), F.col("cable_id"), iso(F.col("start_ts")), iso(F.col("end_ts"))]
    return found.withColumn("detection_id", detection_id(*parts))


def with_quality(found: DataFrame, quality: DataFrame) -> DataFrame:
    """Attach the track's verdict; detections on tracks that are not clean are LOW."""
    q = quality.select("mmsi", F.col("verdict").alias("track_quality"))
    out = found.join(q, "mmsi", "left")
    return out.withColumn("confidence", F.when(F.coalesce(F.col("track_quality") != "CLEAN", F.lit(False)), "LOW").otherwise(F.col("confidence")))


def ordered(found: DataFrame, rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """Adds ord: strongest first, then earliest; ties in the order of finding."""
    kind = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind"))
    keys = {"strength": -rank(F.col("confidence")), "score": -F.col("score"), **{c: F.col(c) for c in ("start_ts", "mmsi", "clean_seg")}, "kind": kind, "route_idx": F.col("route_idx")}
    return numbered(found, keys, "ord", rows_a_part=rows_a_part)


def repeat_presence(found: DataFrame) -> DataFrame:
    """(mmsi, cable_id, events, windows) for hulls with two or more detections on one cable."""
    some = found.where("cable_id IS NOT NULL AND cable_id != ''")
    out = some.groupBy("mmsi", "cable_id").agg(F.count("*").alias("events"), F.array_sort(F.collect_set(F.date_format("start_ts", "yyyy-MM-dd"))).alias("windows"))
    return out.where("events >= 2")


def flag_repeat_presence(found: DataFrame) -> DataFrame:
    """Adds repeat_presence; on charted geometry a repeat makes a LOW detection MODERATE."""
    out = found.join(repeat_presence(found).select("mmsi", "cable_id", F.struct("events", "windows").alias("repeat_presence")), ["mmsi", "cable_id"], "left")
    lift = F.col("repeat_presence").isNotNull() & (F.col("positional_class") == "CHARTED") & (F.col("confidence") == "LOW")
    return out.withColumn("confidence", F.when(lift, "MODERATE").otherwise(F.col("confidence")))


def fault_matches(found: DataFrame, faults: DataFrame) -> DataFrame:
    """(detection_id, fault columns, distance_km): faults near a detection in time and, if placed, space.

    Windows are widened by SLACK_HOURS on both sides and overlaps include their ends.  Both sides
    are joined on the days that they touch, so the join has an equality key and no fault table has
    to be small.
    """
    slack = F.expr(f"INTERVAL {SLACK_HOURS} HOURS")
    days = lambda a, b: F.explode(F.sequence(F.to_date(a), F.to_date(b)))
    f = faults.select("*", (F.col("start") - slack).alias("_f0"), (F.col("end") + slack).alias("_f1")).withColumn("_day", days(F.col("_f0"), F.col("_f1")))
    d = found.select("detection_id", "kind", "start_ts", "end_ts", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).withColumn("_day", days(F.col("start_ts"), F.col("end_ts")))
    pairs = d.join(f.withColumnRenamed("kind", "fault_kind"), "_day").where((F.col("start_ts") <= F.col("_f1")) & (F.col("_f0") <= F.col("end_ts")))
    pairs = pairs.withColumn("distance_km", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), haversine_m(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")) / 1000))
    pairs = pairs.where("distance_km IS NULL OR distance_km <= coalesce(radius_km, 150.0)")
    return pairs.dropDuplicates(["detection_id", "fault_id"]).select("detection_id", F.col("kind").alias("detection_kind"), "fault_id", "fault_kind", "asset", "start", "end", F.round("distance_km", 1).alias("distance_km"))


def corroborate(found: DataFrame, faults: DataFrame) -> DataFrame:
    """Adds corroboration and regrades: what independent faults say outweighs the track alone.

    On charted geometry a dragged anchor with a strong fault is HIGH and all else MODERATE; on
    display geometry a strong fault makes it MODERATE and a weak one LOW.
    """
    hits = fault_matches(found, faults).groupBy("detection_id").agg(
        F.array_sort(F.collect_list(F.struct("fault_id", "fault_kind", "asset", "start", "end", "distance_km"))).alias("corroboration"), F.max(F.col("fault_kind").isin(*STRONG)).alias("_strong")
    )
    out = found.join(hits, "detection_id", "left")
    charted = F.col("positional_class") == "CHARTED"
    level = F.when(F.col("_strong") & charted & (F.col("kind") == "anchor_drag"), "HIGH").when(F.col("_strong") | charted, "MODERATE").otherwise("LOW")
    out = out.withColumn("confidence", F.when(F.col("corroboration").isNotNull(), level).otherwise(F.col("confidence")))
    return out.drop("_strong")


def external_detections(events: DataFrame, routes: DataFrame, corridor_m: float) -> DataFrame:
    """Detections from external events (event_id, kind, ssvid, lat, lon, start, end, hours) near a route."""
    placed = events.where(F.col("kind").isin(*EVENT_KINDS) & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("start").isNotNull())
    near = nearest_route(placed, routes, ["event_id"]).where(F.col("nearest_m") <= corridor_m)
    out = placed.join(near, "event_id").join(routes.select("route_idx", "cable_id", F.col("name").alias("cable_name"), "positional_class"), "route_idx")
    mapped = F.create_map(*[F.lit(x) for pair in EVENT_KINDS.items() for x in pair])
    out = out.withColumns({"mmsi": F.substring("ssvid", 1, 9).try_cast("long"), "gfw_kind": F.element_at(mapped, F.col("kind")), "_h": F.coalesce("hours", F.lit(0.0))})
    score = F.round(F.least(F.lit(1.0), F.when(F.col("_h") / 24 != 0, F.col("_h") / 24).otherwise(0.3)), 3)
    identity = detection_id(F.col("gfw_kind"), F.col("mmsi").cast("string"), F.col("cable_id"), iso(F.col("start")))
    return out.select(identity.alias("detection_id"), F.col("gfw_kind").alias("kind"), "mmsi", "cable_id", "cable_name", "positional_class", "route_idx", F.col("start").alias("start_ts"), F.coalesce("end", "start").alias("end_ts"), (F.col("_h") * 3600).alias("duration_s"), "lat", "lon", score.alias("score"), F.lit("LOW").alias("confidence"), F.round("nearest_m", 0).cast("long").alias("distance_to_route_m"))
