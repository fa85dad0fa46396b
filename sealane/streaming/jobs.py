"""Structured Streaming forms: landing messages to the archive and learning stopping places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sealane.operators import places
from sealane.sources import feed
from sealane.sources.readers import messages, stream_positions

LATE = "2 hours"
SESSION_GAP = "30 minutes"


def landed_messages(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of JSON-lines files that a collector lands."""
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(path)


def deduplicated(rows: DataFrame, late: str = LATE) -> DataFrame:
    """One fix for each (mmsi, ts); state is dropped once the watermark has passed."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["mmsi", "ts"])


def to_archive(raw: DataFrame, path: str, checkpoint: str, every: str | None = "30 minutes") -> StreamingQuery:
    """Append decoded positions to the day-partitioned archive; with ``every`` None, what is there now."""
    rows = deduplicated(stream_positions(messages(raw))).withColumn("date", F.to_date("ts"))
    writer = rows.writeStream.format("parquet").partitionBy("date").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def session_counts(rows: DataFrame, gap: str = SESSION_GAP, late: str = LATE) -> DataFrame:
    """Fixes of each vessel's sessions: a new one starts after more than ``gap`` without a fix."""
    return rows.withWatermark("ts", late).groupBy("mmsi", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max("sog").alias("max_sog"))


def learn_places(rows: DataFrame, state_path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Add each batch's stopped vessels to the learned cells; re-run batches add nothing new."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        places.stopped_cells(batch).write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")

    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def learned_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The distinct (cell_y, cell_x, mmsi) of all batches."""
    return spark.read.parquet(state_path).select("cell_y", "cell_x", "mmsi").distinct()


def drain(spark: SparkSession, folder: str, archive: str, checkpoint: str, rows_a_batch: int = feed.ROWS_A_BATCH, most_s: float = 180.0) -> int:
    """One bounded run over a landed feed: at most ``rows_a_batch`` envelopes and about ``most_s`` seconds go to the archive.

    Returns the number of envelopes read.  The next run goes on where this one has ended; what a
    stopped run had not committed is read again, and only once kept.
    """
    query = to_archive(feed.stream_feed(spark, folder, rows_a_batch), archive, checkpoint, every=None)
    if not query.awaitTermination(most_s):
        query.stop()
    return sum(p["numInputRows"] for p in query.recentProgress)
