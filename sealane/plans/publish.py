"""Outputs: the archive, published JSON and GeoJSON, retention and the change digest."""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealane.functions.ais import iso
from sealane.operators import places, polygons, vessels
from sealane.plans import scratch
from sealane.plans.config import Settings
from sealane.sources import readers

KEEP = {"ignoreNullFields": "false"}


def archive(positions: DataFrame, path: str) -> None:
    """Append positions under their day; sorted by entity so that file statistics help lookups."""
    dated = positions.withColumn("date", F.to_date("ts"))
    dated.repartition("date").sortWithinPartitions("mmsi", "ts").write.mode("append").partitionBy("date").parquet(path)


def prune(spark: SparkSession, path: str, keep_days: int, today: date | None = None) -> list[str]:
    """Delete day folders older than ``keep_days``; returns their names."""
    first = (today or datetime.now(timezone.utc).date()) - timedelta(days=keep_days)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, gone = root.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith("date=") and name[5:] < first.isoformat():
            fs.delete(entry.getPath(), True)
            gone.append(name)
    return gone


def published(detections: DataFrame, most: int, static: DataFrame | None = None) -> DataFrame:
    """The strongest detections, one JSON text each in ``value``, in their order."""
    rows = detections.orderBy(F.col("ord").asc_nulls_last(), "detection_id").limit(most)
    rows = with_vessels(rows, static) if static is not None else rows
    rows = rows.withColumns({"start_ts": iso(F.col("start_ts")), "end_ts": iso(F.col("end_ts")), "evidence": F.parse_json("evidence") if "evidence" in rows.columns else F.lit(None)})
    return rows.select(F.to_json(F.struct(*rows.columns), KEEP).alias("value"))


def envelope(detections: DataFrame, positions: DataFrame, routes: DataFrame, settings: Settings, start: datetime, end: datetime, cells: DataFrame | None = None) -> dict:
    """The published detection document; its size is bounded by ``max_detections_published``."""
    seen = positions.agg(F.count_distinct("mmsi").alias("v"), F.count("*").alias("p")).first()
    lines = routes.agg(F.count("*").alias("r"), F.count_if(F.col("positional_class") == "CHARTED").alias("c")).first()
    rows = [json.loads(r.value) for r in published(detections, settings.max_detections_published).collect()]
    stats = places.stats(cells).first().asDict() | {"learn_threshold": places.LEARN_VESSELS} if cells is not None else {}
    text = lambda t: t.strftime("%Y-%m-%dT%H:%M:%SZ")
    return {
        "schema_version": 1, "generated_at": text(datetime.now(timezone.utc)), "window": {"start": text(start), "end": text(end)}, "area": {"name": settings.name, "bbox": list(settings.bbox)}, "warnings": [],
        "counts": {"detections": detections.count(), "vessels_observed": seen.v, "positions_observed": seen.p, "routes": lines.r, "routes_charted": lines.c},
        "thresholds": vars(settings.thresholds), "suppression": stats, "detections": rows,
    }


def features(rows: DataFrame, lon: str, lat: str) -> DataFrame:
    """One GeoJSON Point feature for each row, as JSON text."""
    rest = [c for c in rows.columns if c not in (lon, lat)]
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, 5), F.round(lat, 5)).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*rest).alias("properties")), KEEP).alias("value"))


def route_features(routes: DataFrame) -> DataFrame:
    """One GeoJSON LineString feature for each route, with its own vertices to 4 digits."""
    line = F.transform("display_line" if "display_line" in routes.columns else "line", lambda p: F.array(F.round(p["lon"], 4), F.round(p["lat"], 4)))
    shape = F.struct(F.lit("LineString").alias("type"), line.alias("coordinates"))
    return routes.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct("cable_id", "name", "positional_class", "source").alias("properties")), KEEP).alias("value"))


def corridor_features(routes: DataFrame, width_m: float) -> DataFrame:
    """One GeoJSON feature for each route's corridor, simplified; its parts on both sides of the antimeridian are apart.

    Outlines of bends tighter than the corridor lie over themselves: fill them by the nonzero rule.
    """
    rings = polygons.corridor_polygons(routes, width_m, polygons.tolerance_deg(width_m))
    parts = F.transform(polygons.turns("ring"), lambda ring: F.array(F.transform(ring, lambda p: F.array(F.round(p["lon"], 4), F.round(p["lat"], 4)))))
    shape = F.struct(F.lit("MultiPolygon").alias("type"), parts.alias("coordinates"))
    rows = rings.select("route_idx", shape.alias("geometry")).join(routes.select("route_idx", "cable_id", "name", "positional_class"), "route_idx")
    about = F.struct("cable_id", "name", "positional_class", F.lit("nonzero").alias("fill"), F.lit(width_m).alias("width_m"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), "geometry", about.alias("properties")), KEEP).alias("value"))


def layer(rows: DataFrame, path: str) -> None:
    """Write features or records (column value), one a line, in as many files as there are tasks."""
    rows.select("value").write.mode("overwrite").text(path)


def records(rows: DataFrame) -> DataFrame:
    """Each row as a line of JSON, times as ISO text and nulls kept."""
    times = {c: iso(F.col(c)) for c, kind in rows.dtypes if kind == "timestamp"}
    rows = rows.withColumns(times) if times else rows
    return rows.select(F.to_json(F.struct(*rows.columns), KEEP).alias("value"))


def document(spark: SparkSession, path: str, value: dict) -> None:
    """Write a small JSON document in one go: readers see the old one or the new one."""
    jvm = spark._jvm
    target, fresh = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.next")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps(value, separators=(",", ":")).encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(fresh, target)


def read_document(spark: SparkSession, path: str) -> dict | None:
    """A JSON document, or None where there is none."""
    if not scratch.children(spark, path):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first().value)


#: What each kind of detection is called, what harmless things look the same, and what it does not show.
TEXTS = {
    "anchor_drag": ("Slow steady run over a cable", ["towing or being towed", "trawling", "slow steaming in bad weather or before a pilot"], "A slow track shows no anchor on the bottom."),
    "loiter": ("Long stay over a cable", ["waiting for a berth or orders", "fishing", "machinery trouble", "work on the cable itself"], "Staying is lawful nearly everywhere."),
    "survey_pattern": ("Parallel lines over a cable", ["hydrographic or fishery survey", "search", "mine clearance", "cable route survey"], "Lines say nothing of what is looked for."),
    "corridor_gap": ("Silence near a cable", ["out of reach of receivers", "a receiver that was down", "a crowded channel"], "Coastal receivers cannot tell silence from distance."),
    "gfw_ais_off": ("Transponder off, by satellite", ["satellite revisit", "equipment fault"], "A third party's finding, published with delay."),
    "gfw_loitering": ("Loitering, by satellite", ["transfer at sea", "waiting"], "A third party's finding, published with delay."),
    "gfw_encounter": ("Meeting at sea, by satellite", ["bunkering", "crew change"], "A third party's finding, published with delay."),
}


def worded(detections: DataFrame) -> DataFrame:
    """Adds summary, benign_explanations and caveat, in words that name kind, cable, length and strength."""
    kinds = lambda k: F.create_map(*[F.lit(x) for kind, texts in TEXTS.items() for x in (kind, texts[k])])
    of = lambda table: F.try_element_at(table, F.col("kind"))
    hours = F.format_string("%.1f h", F.coalesce("duration_s", F.lit(0.0)) / 3600)
    summary = F.concat(F.coalesce(of(kinds(0)), F.col("kind")), F.lit(": "), F.coalesce("cable_name", F.lit("no cable named")), F.lit(", "), hours, F.lit(", score "), F.format_string("%.3f", "score"))
    return detections.withColumns({"summary": summary, "benign_explanations": of(kinds(1)), "caveat": of(kinds(2))})


def with_vessels(detections: DataFrame, static: DataFrame) -> DataFrame:
    """Adds ``vessel``, the dossier of each detection's identity; identities that have said nothing have one of their digits."""
    named = detections.where("mmsi IS NOT NULL").select("mmsi").distinct()
    known = named.join(static.drop("_seq"), "mmsi", "left")
    about = vessels.dossiers(readers.with_arrival(known, "source", "name", "callsign", "imo"))
    about = about.select("mmsi", F.struct(*[c for c in about.columns if c != "mmsi"]).alias("vessel"))
    return detections.join(about, "mmsi", "left")


def change_digest(detections: DataFrame, watch: DataFrame) -> str:
    """SHA-256 over the detections and watched identities, whatever the row order.

    Rows are hashed where they are and only a sum of hashes in two moduli comes together, so no task
    holds the table.
    """
    def part(df: DataFrame) -> str:
        row = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns)), KEEP), 256).alias("h"))
        words = [F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("long")).alias(f"s{k}") for k in range(8)]
        return "|".join(str(x) for x in row.agg(F.count("*"), *words).first())

    import hashlib

    return hashlib.sha256(f"{part(detections)}#{part(watch.select('mmsi'))}".encode()).hexdigest()


class NothingObserved(RuntimeError):
    """No positions at all: what was published before stays."""


def guard(positions: DataFrame) -> DataFrame:
    if positions.isEmpty():
        raise NothingObserved("no positions in the window")
    return positions
