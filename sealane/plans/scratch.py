"""Folders for what a job writes on its way, in the place that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's spark.checkpoint.dir; in local mode without one, under a temporary one."""
    return f"{_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or _own.get(spark.sparkContext.applicationId)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="sealane-")
    return root


#: In local mode, the temporary folder of each application.
_own: dict[str, str] = {}


class Steps:
    """Tables that a job stands on while it goes on: written once, so that neither the work nor the plan before them is done again.

    They are checkpoints in the shared folder, which outlive lost executors and keep how their rows
    are partitioned and sorted.  ``release`` deletes them; without it Spark's cleaner does, where
    the session has that set.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []
        self.counts: dict[str, int] = {}

    def put(self, df: DataFrame, **counts: Column) -> DataFrame:
        """Write ``df``; ``counts`` are aggregates of its rows, taken while they pass and kept by name."""
        context, seen = self.spark.sparkContext, Observation() if counts else None
        if seen is not None:
            df = df.observe(seen, *[c.alias(name) for name, c in counts.items()])
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(_root(self.spark))
        done = df.checkpoint(eager=True)
        if seen is not None:
            self.counts |= seen.get
        file = done._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            self.paths.append(file.get())
        return done

    def release(self) -> None:
        while self.paths:
            delete(self.spark, self.paths.pop())


def collect(spark: SparkSession) -> None:
    """Collect the driver's garbage, of which Spark learns what finished jobs no longer need."""
    gc.collect()
    spark._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def children(spark: SparkSession, path: str) -> list:
    """File statuses of what stands in a folder; none where there is no folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return list(fs.listStatus(where)) if fs.exists(where) else []
