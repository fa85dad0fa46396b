"""Helpers that the text operators share."""

from __future__ import annotations

import contextlib
import functools
import gc
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

#: A key that holds at least one row in HOT_SHARE is hot; so there are HOT_SHARE hot keys at most.
HOT_SHARE = 1000

#: Spark's switch for deleting a write's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset (tests in local mode) a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="sealane-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    The files outlive lost executors.  Spark keeps how they are partitioned and sorted; its cleaner
    removes them once nothing refers to them if spark.cleaner.referenceTracking.cleanCheckpoints is
    set.  Tables that a job itself can delete go to a :class:`Shelf`.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def _shuffles_go_at_once(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile deletes its shuffle files as it ends; nothing reads them again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


class Shelf:
    """Tables written as Parquet to the shared folder, which the job deletes as soon as it is done with them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/shelf-{uuid.uuid4().hex}"
        self.paths, self.puts = {}, 0

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.puts += 1
        path = f"{self.folder}/{name.replace(' ', '-')}-{self.puts}"
        with _shuffles_go_at_once(self.spark):
            df.write.parquet(path)
        self.collect()
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables."""
        for name in names:
            for path in self.paths.pop(name, []):
                delete(self.spark, path)
        self.collect()

    def collect(self) -> None:
        """Let Spark's cleaner remove the shuffle files of jobs that are done, which it does after a collection of the driver's memory only."""
        gc.collect()
        self.spark._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow; a worker that has done its task gives back what Arrow still holds, as it idles beside the next stages."""

    @functools.wraps(run)
    def out(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lookup(left: DataFrame, right: DataFrame, on: list[str], size: str, total: int, how: str = "left") -> DataFrame:
    """Join ``left`` to the unique rows of ``right`` on ``on`` without one task per hot key.

    ``right[size]`` counts the rows of ``left`` that have the key and ``total`` all of them.  Keys
    with at least one row in HOT_SHARE are HOT_SHARE at most, so these rows of ``right`` are
    broadcast whatever the table's size; all other keys go through an ordinary shuffle join, where
    no key can hold more than that share.
    """
    least = max(2, -(-total // HOT_SHARE))
    hot = right.where(F.col(size) >= least)
    if (right.agg(F.max(size)).first()[0] or 0) < least:
        return left.join(right, on, how).select(*left.columns, *[c for c in right.columns if c not in on])
    marked = left.join(F.broadcast(hot.select(*on, F.struct(*[c for c in right.columns if c not in on]).alias("_hot"))), on, "left")
    rest = [c for c in right.columns if c not in on]
    found = marked.where(F.col("_hot").isNotNull()).select(*left.columns, *[F.col(f"_hot.{c}").alias(c) for c in rest])
    other = marked.where(F.col("_hot").isNull()).drop("_hot").join(right.where(F.col(size) < least), on, how)
    return found.unionByName(other.select(*left.columns, *rest))


def components(links: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, root): for every node of ``links(a, b)`` the smallest node that it reaches.

    Alternating large-star and small-star steps on edges (high, low).  The large star puts the
    higher end of an edge onto the smallest neighbour of the lower end; the small star joins all
    lower neighbours of a node to the smallest of them.  Each edge gives one edge, so the table never
    grows, and long chains are halved and not walked: the rounds grow with the logarithm of the
    nodes (at most its square).  It ends after the first round in which no edge changes, whatever
    the number of rounds; then every edge leads to its component's smallest node.  Each round's
    table goes to the shelf and the one before is deleted.
    """
    names = iter(f"edges {k}" for k in itertools.count())
    last = next(names)
    edges = shelf.put(last, links.where("a != b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct())
    changed = True

    def star(moved: DataFrame) -> DataFrame:
        nonlocal last
        before, last = last, next(names)
        out = shelf.put(last, moved.groupBy("high", "low").agg(F.max("changed").alias("changed")))
        shelf.drop(before)
        return out

    while changed:
        least = lambda: edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))  # noqa: B023, E731
        moved = edges.join(least().withColumnRenamed("node", "low"), "low", "left")
        edges = star(moved.select("high", F.coalesce("least", "low").alias("low"), F.col("least").isNotNull().alias("changed")))
        moved = edges.join(least().withColumnRenamed("node", "high"), "high")
        alone = F.col("low") == F.col("least")
        edges = star(moved.select(F.when(alone, F.col("high")).otherwise(F.col("low")).alias("high"), F.col("least").alias("low"), (F.col("changed") | ~alone).alias("changed")))
        changed = edges.agg(F.max("changed")).first()[0]
        edges = edges.select("high", "low")
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
