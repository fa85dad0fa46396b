"""A whole run: from landed feeds to published files.

Everything stands under ``data_dir``: ``landed/<source>``, ``positions`` and ``static`` (the archive),
``cables`` (GeoJSON, sidecars and landing points), ``ports``, ``faults.json``, ``alerts/<country>``,
``events/<KIND>``, ``places`` (learned cells) and ``incidents.json``.  What is not there is left out
with a warning.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealane.operators import grading, places, vessels
from sealane.plans import engine, publish, scratch
from sealane.plans.config import Settings
from sealane.plans.incremental import Kept
from sealane.sources import readers, registry, routes
from sealane.sources.schema import FAULTS, STATIC, empty

#: Fixes of a vessel in the window under which detectors are unlikely to find anything.
FEW_FIXES = 3
ROUTES = "cable_id string, name string, positional_class string, source string, line array<struct<lon:double,lat:double>>, display_line array<struct<lon:double,lat:double>>, owners string, rfs string, length_km double, stated_accuracy_m double"
FAULT_TIMES = [("start", "timestamp"), ("end", "timestamp")]


@dataclass
class Outcome:
    """How a run ended: 0, or 2 where nothing was observed and what was published before stays."""

    code: int
    counts: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    changed: bool = False


def _there(spark: SparkSession, path: str) -> bool:
    return bool(scratch.children(spark, path))


def _names(spark: SparkSession, path: str) -> list[str]:
    return sorted(s.getPath().getName() for s in scratch.children(spark, path))


def route_set(spark: SparkSession, settings: Settings) -> DataFrame:
    """All routes of the area: those of the cables folder with their sidecars and the metadata table beside it."""
    cables = f"{settings.data_dir}/cables"
    found = empty_routes(spark)
    if any(n.endswith(("geojson", ".json")) and not n.endswith(".meta.json") and not n.startswith("landing-points") for n in _names(spark, cables)):
        found = routes.folder_routes(spark, cables, settings.bbox)
    if _there(spark, f"{settings.data_dir}/cable-metadata.json"):
        meta = spark.read.schema("id string, owners string, rfs string, length string").json(f"{settings.data_dir}/cable-metadata.json", multiLine=True)
        found = routes.with_metadata(found, meta)
    return routes.assembled(found)


def empty_routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ROUTES)


def seeds(spark: SparkSession, settings: Settings) -> DataFrame | None:
    """Ports and landing points as places where vessels stop."""
    parts = []
    for path, radius, label in ((f"{settings.data_dir}/ports", places.PORT_M, "port"), (f"{settings.data_dir}/cables/landing-points.geojson", places.LANDING_M, "cable landing")):
        if _there(spark, path):
            points = routes.landing_points(spark, path)
            parts.append(points.select("lat", "lon", F.lit(radius).alias("radius_m"), F.concat(F.lit(f"{label}: "), F.coalesce("name", F.lit(label))).alias("label")))
    return reduce(DataFrame.unionByName, parts) if parts else None


def all_faults(spark: SparkSession, settings: Settings) -> DataFrame:
    """Faults that operators have told and outage alerts by country, one below the other."""
    kinds = dict(FAULT_TIMES)
    out = empty(spark, FAULTS).select(*[F.col(f.name).cast(kinds.get(f.name, f.dataType.simpleString())).alias(f.name) for f in FAULTS])
    if _there(spark, f"{settings.data_dir}/faults.json"):
        out = out.unionByName(readers.faults(spark, f"{settings.data_dir}/faults.json").select(*out.columns))
    for country in _names(spark, f"{settings.data_dir}/alerts"):
        out = out.unionByName(readers.outage_alerts(spark, f"{settings.data_dir}/alerts/{country}", country).select(*out.columns))
    return out


def archive_static(static: DataFrame, folder: str, stamp: str) -> None:
    """Add a run's vessel data under names that sort by time."""
    spark = static.sparkSession
    part = f"{folder}/.{stamp}"
    static.write.mode("overwrite").parquet(part)
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for k, name in enumerate(n for n in _names(spark, part) if n.endswith(".parquet")):
        fs.rename(jvm.org.apache.hadoop.fs.Path(f"{part}/{name}"), jvm.org.apache.hadoop.fs.Path(f"{folder}/{stamp}-{k:05d}.parquet"))
    scratch.delete(spark, part)


def prune_static(spark: SparkSession, folder: str, most: int = 400) -> list[str]:
    """Delete all but the newest files of vessel data, by the list that readers use; returns names."""
    if not _there(spark, folder):
        return []
    stay, gone = {p.rsplit("/", 1)[-1] for p in readers.newest_files(spark, folder, most)}, []
    for name in _names(spark, folder):
        if name.endswith(".parquet") and name not in stay:
            scratch.delete(spark, f"{folder}/{name}")
            gone.append(name)
    return gone


def events(spark: SparkSession, settings: Settings, lines: DataFrame) -> DataFrame | None:
    """Detections of landed external events near a route."""
    kinds = [k for k in _names(spark, f"{settings.data_dir}/events") if k in grading.EVENT_KINDS]
    if not kinds:
        return None
    rows = reduce(DataFrame.unionByName, [readers.external_events(spark, f"{settings.data_dir}/events/{k}", k) for k in kinds])
    return grading.external_detections(rows, lines, settings.thresholds.corridor_m)


def run(spark: SparkSession, settings: Settings, now: datetime | None = None, window_days: int | None = None) -> Outcome:
    """Collect, archive, learn, detect, grade and publish; see the module for where things stand."""
    now = now or datetime.now(timezone.utc)
    start = now - timedelta(days=window_days or settings.window_days)
    data, site, out = settings.data_dir, settings.site_data_dir, Outcome(0)
    landed = {n: f"{data}/landed/{n}" for n in settings.sources if _there(spark, f"{data}/landed/{n}")}
    out.warnings += [f"{n}: nothing has landed" for n in settings.sources if n not in landed]
    fresh, said = registry.collected(spark, landed, start, now, settings.bbox)
    publish.archive(fresh, f"{data}/positions")
    archive_static(said, f"{data}/static", now.strftime("%Y%m%dT%H%M%S"))

    if not any(n.startswith("date=") for n in _names(spark, f"{data}/positions")):
        return Outcome(2, warnings=[*out.warnings, "no positions at all; what was published stays"])
    positions = readers.archive_positions(spark, f"{data}/positions", start)
    static = readers.archive_static(spark, f"{data}/static") if _there(spark, f"{data}/static") else empty(spark, STATIC)
    if positions.isEmpty():
        return Outcome(2, warnings=[*out.warnings, "no positions in the window; what was published stays"])

    kept = Kept(spark, f"{data}/places")
    cells = kept.write(places.merged(kept.read(), places.stopped_cells(positions)))
    lines = route_set(spark, settings)
    found = engine.run(positions, lines, settings.thresholds, cells, seeds(spark, settings))
    counts = found.counts
    if not counts["routes"]:
        out.warnings.append("no cable geometry, so no corridors and no detections; vessels are published all the same")
    if counts["vessels_observed"] and counts["positions_observed"] / counts["vessels_observed"] < FEW_FIXES:
        out.warnings.append("few fixes of each vessel in the window: detectors need tracks, so expect little until the archive fills")
    faults = found.steps.put(all_faults(spark, settings))
    detections = found.steps.put(publish.worded(engine.evaluate(found.detections, faults, events(spark, settings, lines))), published=F.count(F.lit(1)))
    layer = found.steps.put(vessels.vessel_layer(positions, lines), in_corridor_now=F.count_if("in_corridor")) if counts["routes"] else found.steps.put(vessels.latest_positions(positions).withColumns({"in_corridor": F.lit(False), "nearest_m": F.lit(None).cast("bigint")}), in_corridor_now=F.lit(0).cast("long") * F.count(F.lit(1)))
    named = layer.join(readers.first_values(readers.with_arrival(static, "source", "name"), "_seq"), "mmsi", "left")

    publish.layer(publish.route_features(lines), f"{site}/cables.geojsonl")
    publish.layer(publish.corridor_features(lines, settings.thresholds.corridor_m), f"{site}/corridors.geojsonl")
    if _there(spark, f"{data}/cables/landing-points.geojson"):
        publish.layer(publish.features(routes.landing_points(spark, f"{data}/cables/landing-points.geojson", settings.bbox), "lon", "lat"), f"{site}/landing-points.geojsonl")
    publish.layer(publish.features(named.withColumn("ts", publish.iso(F.col("ts"))), "lon", "lat"), f"{site}/vessels.geojsonl")
    publish.layer(publish.records(found.quality.where("verdict != 'CLEAN'")), f"{site}/track-quality.jsonl")
    publish.layer(publish.records(faults), f"{site}/faults.jsonl")

    text = lambda t: t.strftime("%Y-%m-%dT%H:%M:%SZ")
    watched = vessels.watchlist(named, vessels.WATCHLIST)
    rows = [publish.json.loads(r.value) for r in publish.records(publish.with_vessels(watched, static).orderBy(F.coalesce("sog", F.lit(99.0)), F.coalesce("nearest_m", F.lit(0)), "mmsi")).collect()]
    publish.document(spark, f"{site}/watchlist.json", {"generated_at": text(now), "count": counts["in_corridor_now"], "note": "Latest fixes inside a corridor. Being there is no finding: routes cross lanes, anchorages and fishing grounds.", "vessels": rows})
    best = [publish.json.loads(r.value) for r in publish.published(detections, settings.max_detections_published, static).collect()]
    stats = places.stats(cells).first().asDict() | {"learn_threshold": places.LEARN_VESSELS}
    named_counts = {k: counts[k] for k in ("vessels_observed", "positions_observed", "routes", "routes_charted", "in_corridor_now")}
    publish.document(spark, f"{site}/detections.json", {
        "schema_version": 1, "generated_at": text(now), "window": {"start": text(start), "end": text(now)}, "area": {"name": settings.name, "bbox": list(settings.bbox)}, "warnings": out.warnings,
        "counts": {"detections": len(best), **named_counts}, "thresholds": vars(settings.thresholds), "suppression": stats, "detections": best,
    })
    publish.layer(publish.records(places.exported(cells)), f"{site}/stopping-places.jsonl")
    if (incidents := publish.read_document(spark, f"{data}/incidents.json")) is not None:
        publish.document(spark, f"{site}/incidents.json", incidents)

    digest = publish.change_digest(detections.drop("vessel"), named.where("in_corridor"))
    before = publish.read_document(spark, f"{site}/summary.json") or {}
    out.counts, out.changed = counts, before.get("digest") != digest
    publish.document(spark, f"{site}/summary.json", {"generated_at": text(now), "digest": digest, "changed": out.changed, "counts": counts, "top": [{k: d.get(k) for k in ("detection_id", "kind", "mmsi", "cable_name", "confidence", "score", "summary")} for d in best[:25]]})
    publish.prune(spark, f"{data}/positions", settings.retain_days, now.date())
    prune_static(spark, f"{data}/static")
    found.release()
    return out


def doctor(spark: SparkSession, settings: Settings) -> list[tuple[str, bool, str]]:
    """(what, whether it is well, remark) of what a run would find."""
    out = []
    for name in settings.sources:
        known, there = name in registry.SOURCES, _there(spark, f"{settings.data_dir}/landed/{name}")
        out.append((f"source {name}", known and there, "" if known and there else "nothing has landed" if known else "no source is called that"))
    n = route_set(spark, settings).count()
    out.append(("routes", n > 0, f"{n} in the area"))
    days = [x for x in _names(spark, f"{settings.data_dir}/positions") if x.startswith("date=")]
    out.append(("archive", bool(days), f"{len(days)} days, {days[0][5:]} to {days[-1][5:]}" if days else "empty"))
    for file in ("faults.json", "incidents.json"):
        out.append((file, _there(spark, f"{settings.data_dir}/{file}"), ""))
    return out
