"""Stopping places learned as state: who has stopped in which cell, kept by Spark between batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sealane.functions.geo import cell
from sealane.operators.places import STOPPED_SOG

#: Parts of a cell's identities, so that a busy port is not one task's.
SHARES = 16
GROWN = "cell_y bigint, cell_x bigint, share int, vessels bigint"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Stopped(StatefulProcessor):
    """For a share of a cell's identities: the set of those seen so far, and how many they are."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "mmsi bigint", "once boolean")
        self.size = handle.getValueState("size", "vessels bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        before = self.size.get()[0] if self.size.exists() else 0
        size = before
        for mmsi in {r.mmsi for r in rows}:
            if not self.seen.containsKey((mmsi,)):
                self.seen.updateValue((mmsi,), (True,))
                size += 1
        if size > before:
            self.size.update((size,))
            yield Row(cell_y=key[0], cell_x=key[1], share=key[2], vessels=size)

    def close(self) -> None:
        pass


def growth(positions: DataFrame) -> DataFrame:
    """(cell_y, cell_x, share, vessels): a row for each share of a cell that a batch has added identities to.

    The state is monotone, so late and repeated fixes change nothing that a batch over all rows
    would not have, whatever the order of batches.  Rows without an identity or a place are left out.
    """
    stopped = positions.where((F.coalesce("sog", F.lit(99.0)) <= STOPPED_SOG) & F.col("mmsi").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    keyed = stopped.select(cell(F.col("lat")).alias("cell_y"), cell(F.col("lon")).alias("cell_x"), F.pmod(F.xxhash64("mmsi"), F.lit(SHARES)).cast("int").alias("share"), "mmsi")
    return keyed.groupBy("cell_y", "cell_x", "share").transformWithState(Stopped(), outputStructType=GROWN, outputMode="Append", timeMode="None")


def learn(positions: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append what grows to the table at ``path``; with ``every`` None, what the source gives one run.

    Sets of identities need the RocksDB state store, which the session must name in
    spark.sql.streaming.stateStore.providerClass; it is set here for the query's start only.
    """
    spark, name = positions.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        writer = growth(positions).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def learn_all(positions: DataFrame, path: str, checkpoint: str) -> None:
    """Learn batch after batch until nothing that has landed is unread.

    A landed feed gives :func:`learn` without ``every`` one bounded batch a run, however much there
    is; here one query goes on through all of them.
    """
    query = learn(positions, path, checkpoint, every="0 seconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def learned(spark: SparkSession, path: str) -> DataFrame:
    """(cell_y, cell_x, vessels) of all batches so far: shares only grow, so each one's largest size counts."""
    shares = spark.read.schema(GROWN).parquet(path).groupBy("cell_y", "cell_x", "share").agg(F.max("vessels").alias("vessels"))
    return shares.groupBy("cell_y", "cell_x").agg(F.sum("vessels").alias("vessels"))
