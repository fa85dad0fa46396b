"""Exact deduplication: a tree of merges over sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealane.llm.common import WS, documents, durable, lookup, text_or_empty

#: Runs that are merged at once in a round.
FAN_IN = 8
KEY = ["digest", "sha", "n_bytes"]


def digests(docs: DataFrame) -> DataFrame:
    """(row, doc_id, run, digest, sha, n_bytes) of each row; whitespace runs count as one space."""
    text = F.regexp_replace(text_or_empty(), WS, " ")
    small = docs.select("doc_id", text.alias("t")).select(
        "doc_id",
        F.xxhash64("t").alias("digest"),
        F.unhex(F.sha2(F.col("t"), 256)).alias("sha"),
        F.octet_length("t").cast("long").alias("n_bytes"),
    )
    return durable(small.select(F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("run"), *small.columns))


def merge_runs(rows: DataFrame, n_runs: int) -> DataFrame:
    """(digest, sha, n_bytes, keep, group_size): one global run, in segments by digest.

    Each input partition is a run.  FAN_IN is a power of two and a round of the tree is as many
    binomial rounds at once: runs whose numbers differ in the next three bits only exchange their
    entries and are merged together (a merge of eight ways).  The exchange sends a digest's entries
    of those runs to one place, after each task has reduced its own.  ``keep`` is a struct, so Spark plans sort-based aggregation: both sides of the exchange
    are sorted runs that are merged in order.  The 64-bit digest orders the runs; two entries are
    one group only if the SHA-256 and the length agree too, which is verified at every level.
    The keeper is the smallest (doc_id, row), null ids last.
    """
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))
    runs = rows.select("run", *KEY, first.alias("keep"), F.lit(1).cast("long").alias("group_size"))
    while True:
        n_runs = -(-n_runs // FAN_IN)
        runs = (
            runs.withColumn("run", F.floor(F.col("run") / FAN_IN).cast("int")).groupBy("run", *KEY).agg(F.min("keep").alias("keep"), F.sum("group_size").alias("group_size"))
        )
        if n_runs <= 1:
            return runs.drop("run")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``.

    Null texts count as empty, and empty texts are equal to each other.  A null doc_id is larger
    than any other.  Of repeated rows with one doc_id exactly one is kept.  Other columns of
    ``docs`` are not read, whatever their names.  An empty table gives an empty result.
    """
    return _decided(digests(docs)).drop("row")


def _decided(rows: DataFrame) -> DataFrame:
    total = rows.count()
    groups = durable(merge_runs(rows, rows.rdd.getNumPartitions()))
    joined = lookup(rows.select("row", "doc_id", *KEY), groups, KEY, "group_size", total)
    return joined.select(
        "row",
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops; columns stay as they are, whatever their names.

    A row is known by its doc_id and text.  Where a keeper's own row is repeated (the same doc_id
    and an equal text), one of these rows stays.  An empty table gives an empty result.
    """
    lost = durable(_decided(digests(docs)).where("NOT kept").select(F.col("doc_id").alias("id"), "text_sha256", F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("twin")).distinct())
    rows = docs.select(F.struct(*docs.columns).alias("d"), F.sha2(F.regexp_replace(text_or_empty(), WS, " "), 256).alias("sha"))
    same = F.col("d.doc_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("text_sha256"))
    left = rows.join(lost, same, "left_anti").select("d.*")
    twins = lost.where("twin")
    if twins.isEmpty():
        return left
    once = rows.join(twins, same, "left_semi").groupBy("d.doc_id", "sha").agg(F.first("d").alias("d"))
    return left.unionByName(once.select("d.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
