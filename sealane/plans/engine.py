"""From positions and routes to graded detections: one plan over all tracks."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealane.operators import detectors, grading
from sealane.operators.corridors import corridor_join, small
from sealane.operators.quality import track_quality
from sealane.operators.tracks import clean_segments, transit_baseline
from sealane.plans.config import Thresholds
from sealane.plans.scratch import Steps

PUBLIC = ["detection_id", "kind", "mmsi", "cable_id", "cable_name", "positional_class", "cable_source", "start_ts", "end_ts", "duration_s", "lat", "lon", "confidence", "score", "evidence", "track", "track_quality", "ord"]


class Found(NamedTuple):
    detections: DataFrame
    quality: DataFrame
    steps: Steps

    @property
    def counts(self) -> dict[str, int]:
        """Fixes, vessels, routes and detections by kind, counted while the run wrote them: no job of their own."""
        return self.steps.counts

    def release(self) -> None:
        """Delete what the run has written on its way; neither table can be read after that."""
        self.steps.release()


def prepared(positions: DataFrame) -> DataFrame:
    """NaN as null, and one fix for each (mmsi, ts)."""
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in ("lat", "lon", "sog", "cog")}
    return positions.withColumns(clean).where("lat IS NOT NULL AND lon IS NOT NULL AND mmsi IS NOT NULL").dropDuplicates(["mmsi", "ts"])


def run(positions: DataFrame, routes: DataFrame, th: Thresholds | None = None, cells: DataFrame | None = None, seeds: DataFrame | None = None) -> Found:
    """Detections of all four kinds, with quality, ids and order."""
    found = detect(positions, routes, th, cells, seeds)
    return found._replace(detections=grading.ordered(found.detections).select(*PUBLIC))


def detect(positions: DataFrame, routes: DataFrame, th: Thresholds | None = None, cells: DataFrame | None = None, seeds: DataFrame | None = None) -> Found:
    """What :func:`run` gives, not in order but with clean_seg and route_idx.

    Tracks are segmented once.  The routes meet the positions once, at the wider reach; the corridor
    itself is a filter of that.  A detector adds no shuffle of positions but those on mmsi.  What
    several detectors read is written once, so neither work nor plans pile up; see ``Found.release``.
    """
    th, steps = th or Thresholds(), Steps(positions.sparkSession)
    fixes = steps.put(prepared(positions), positions_observed=F.count(F.lit(1)))
    segmented = steps.put(clean_segments(fixes, th.impossible_kn))
    quality = steps.put(track_quality(fixes, segmented, th.impossible_kn), vessels_observed=F.count(F.lit(1)), vessels_unusable=F.count_if(~F.col("usable")), tracks_suspect=F.count_if(F.col("verdict") != "CLEAN"))
    good = steps.put(segmented.join(quality.where("usable AND n_positions >= 2").select("mmsi"), "mmsi", "left_semi"))
    baseline = steps.put(transit_baseline(fixes))
    routes = steps.put(routes, routes=F.count(F.lit(1)), routes_charted=F.count_if(F.col("positional_class") == "CHARTED"))
    reach = steps.put(corridor_join(good, routes, max(th.survey_buffer_m, th.corridor_m), detectors.FIX))
    near, wide = reach.where(F.col("dist_m") < th.corridor_m), reach.where(F.col("dist_m") < th.survey_buffer_m)
    parts = [
        detectors.corridor_gap(good, near, routes, th, hold=steps.put),
        detectors.anchor_drag(good, baseline, routes, th, hold=steps.put),
        detectors.loiter(good, near, routes, th, cells, seeds, hold=steps.put),
        detectors.survey_pattern(good, wide, routes, th, hold=steps.put),
    ]
    parts = [p.withColumn("evidence", F.to_json("evidence", {"ignoreNullFields": "false"})).select(*detectors.COMMON) for p in parts]
    found = reduce(DataFrame.unionByName, [steps.put(p) for p in parts])
    named = routes.select("route_idx", "cable_id", F.col("name").alias("cable_name"), "positional_class", F.col("source").alias("cable_source"))
    found = grading.with_ids(grading.with_quality(found.join(small(named), "route_idx"), quality))
    kinds = {kind: F.count_if(F.col("kind") == kind) for kind in grading.KIND_ORDER}
    return Found(steps.put(found.select(*[c for c in PUBLIC if c != "ord"], "clean_seg", "route_idx"), detections=F.count(F.lit(1)), **kinds), quality, steps)


def evaluate(found: DataFrame, faults: DataFrame | None = None, external: DataFrame | None = None) -> DataFrame:
    """Repeats, then external events, then faults: the order decides what regrades what."""
    out = grading.flag_repeat_presence(found)
    if external is not None:
        out = out.unionByName(external, allowMissingColumns=True)
    return out if faults is None else grading.corroborate(out, faults)
