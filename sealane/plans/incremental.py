"""Detections kept up to date over a moving window: only identities whose fixes have changed are looked at again."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sealane.operators import grading, places
from sealane.plans import engine, publish, scratch
from sealane.plans.config import Thresholds
from sealane.sources import readers


class Kept:
    """Detections as a table in versions, of which the last whole one counts.

    A version is there once Spark's mark of success is, so readers never see half of one; the one
    before stays for those who still read it, older ones go.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        names = (s.getPath().getName() for s in scratch.children(self.spark, self.path))
        return sorted(int(n[2:]) for n in names if n.startswith("v="))

    def _whole(self, version: int) -> bool:
        return any(s.getPath().getName() == "_SUCCESS" for s in scratch.children(self.spark, f"{self.path}/v={version}"))

    def read(self, back: int = 0) -> DataFrame | None:
        """The last whole version or the one ``back`` versions before it; None if there is none."""
        whole = [v for v in self._versions() if self._whole(v)]
        return self.spark.read.parquet(f"{self.path}/v={whole[-1 - back]}") if len(whole) > back else None

    def write(self, rows: DataFrame) -> DataFrame:
        versions = self._versions()
        rows.write.parquet(f"{self.path}/v={max(versions, default=0) + 1}")
        for v in [v for v in versions if self._whole(v)][:-1]:
            scratch.delete(self.spark, f"{self.path}/v={v}")
        return self.read()


def changed_identities(fresh: DataFrame, archive: DataFrame, since: datetime, before: datetime | None) -> DataFrame:
    """(mmsi) of fresh fixes, and of archived ones that the window has left behind since it began at ``before``."""
    some = fresh.select("mmsi")
    if before is not None and before < since:
        some = some.unionByName(archive.where((F.col("ts") >= F.lit(before)) & (F.col("ts") < F.lit(since))).select("mmsi"))
    return some.where("mmsi IS NOT NULL").distinct()


def redetect(kept: Kept, positions: DataFrame, changed: DataFrame, routes: DataFrame, th: Thresholds | None = None) -> DataFrame:
    """Replace the detections of ``changed`` identities by those of their fixes in ``positions``, the whole window.

    Detections, baselines and quality are of one identity each, so the others' stand as they are.
    What depends on many identities (learned stopping places, repeats, order, faults) is not stored
    but worked out on reading, see :func:`current`.
    """
    changed = changed.persist()
    found = engine.detect(positions.join(changed, "mmsi", "left_semi"), routes, th)
    rows, before = found.detections, kept.read()
    if before is not None:
        rows = before.join(changed, "mmsi", "left_anti").unionByName(rows)
    try:
        return kept.write(rows)
    finally:
        found.release()
        changed.unpersist()


def step(kept: Kept, archive: str, fresh: DataFrame, since: datetime, routes: DataFrame, th: Thresholds | None = None, before: datetime | None = None) -> DataFrame:
    """Archive ``fresh`` fixes and bring the detections of the window from ``since`` on up to date.

    A step that runs twice archives its fixes twice, which the archive's reader drops, and writes
    the same detections again.  ``before`` is where the last step's window began.  Spark drops what a
    step's jobs have left (broadcasts, shuffles) as the driver's garbage is collected, so that is
    done here and does not pile up from step to step.
    """
    fresh = fresh.persist()
    publish.archive(fresh, archive)
    whole = fresh.sparkSession.read.parquet(archive)
    changed = changed_identities(fresh, whole.where(F.col("date") >= F.lit((before or since).date())), since, before)
    try:
        return redetect(kept, readers.archive_positions(fresh.sparkSession, archive, since), changed, routes, th)
    finally:
        fresh.unpersist()
        scratch.collect(fresh.sparkSession)


def current(kept: Kept, cells: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame | None:
    """The kept detections in order, without loiterers where stopping is normal by now."""
    rows = kept.read()
    if rows is None:
        return None
    if cells is not None or seeds is not None:
        normal = places.why_normal(rows.where("kind = 'loiter'").select("detection_id", "lat", "lon"), ["detection_id"], cells, seeds)
        rows = rows.join(normal.select("detection_id", F.lit("loiter").alias("kind")), ["detection_id", "kind"], "left_anti")
    return grading.ordered(rows).select(*engine.PUBLIC)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(detection_id, change): ``new``, ``gone`` or ``regraded`` (another score or confidence), by id."""
    a, b = (df.select("detection_id", F.struct("score", "confidence").alias(name)) for df, name in ((before, "a"), (after, "b")))
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") != F.col("b"), "regraded")
    return a.join(b, "detection_id", "full").select("detection_id", change.alias("change")).where("change IS NOT NULL")


def follow(positions: DataFrame, kept: Kept, archive: str, checkpoint: str, since: datetime, routes: DataFrame, th: Thresholds | None = None, every: str | None = None) -> StreamingQuery:
    """Run :func:`step` on each batch of a stream of fixes; with ``every`` None, on what there is now."""
    writer = positions.writeStream.foreachBatch(lambda batch, _: step(kept, archive, batch, since, routes, th) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
