"""What keeps the text operators inside their limits on larger tables."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sealane.llm import common, ngram_join, secrets_scan


def shuffle_files(spark):
    return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark, monkeypatch):
    """a shelf's write deletes its shuffle files itself; no collection of the driver's memory has to find them."""
    monkeypatch.setattr(common.Shelf, "collect", lambda self: None)
    before, shelf = shuffle_files(spark), common.Shelf(spark)
    table = shelf.put("sums", spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")))
    assert shuffle_files(spark) <= before
    assert table.count() == 7 and table.agg(F.sum("s")).first()[0] == 499_500
    assert spark.conf.get(common.CLEANUP, "false") == "false"  # the caller's own writes are left alone
    with pytest.raises(Exception):  # noqa: B017
        shelf.put("bad", spark.range(3).select(F.raise_error(F.lit("no"))))
    assert spark.conf.get(common.CLEANUP, "false") == "false"


def test_sets_that_share_many_keys_meet_once(spark, monkeypatch):
    """sets that share hundreds of keys, or one alone, are all compared, but few times each."""
    rng, keys = random.Random(3), {v: set() for v in range(14)}
    for v in range(12):
        keys[v] = {k for k in range(300) if rng.random() < 0.6}
    keys[12], keys[13] = {1000, *range(2000, 2100)}, {1000, *range(3000, 3100)}
    rows = [(v, 100, 0, [k * 7919 % 10007 for k in ks], ([0] * 8, None)) for v, ks in keys.items()]
    index = spark.createDataFrame(rows, "node long, n int, first int, keys array<long>, signature struct<parity:array<long>,counts:array<short>>")
    v = "struct<node:bigint,n:int>"
    roots, made, meet = spark.createDataFrame([], f"node {v}, root {v}"), [], ngram_join.meetings

    def meetings(*args):
        made.append(meet(*args).count())
        return meet(*args)

    monkeypatch.setattr(ngram_join, "meetings", meetings)
    found = sorted((r.a.node, r.b.node) for r in ngram_join.across(index, roots, common.Shelf(spark), 80).collect())
    assert found == [*itertools.combinations(range(12), 2), (12, 13)]
    assert sum(made) < 3 * len(found)


def test_pipeline_sends_small_batches(spark, tmp_path):
    """a batch of long documents is bounded in bytes, not in rows alone."""
    docs = spark.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 10_000).alias("text"))
    stage = corpus_pipeline.in_small_batches(lambda _, d, __: d.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long"))
    before = spark.conf.get(corpus_pipeline.BATCH)
    try:
        sizes = [r.n for r in stage(spark, docs, "").collect()]
    finally:
        spark.conf.set(corpus_pipeline.BATCH, before)
    assert len(sizes) > 4 and max(sizes) < 2 * corpus_pipeline.BATCH_BYTES


def test_secret_network_learns_from_all_texts(spark):
    """every window of every candidate of every text is labelled, not 20 of each of 3,000 texts; the scan runs on such a fit."""
    texts = [(i, " ".join(f"see item-{i}-{k}.12345 now" for k in range(25)) + f" password=abc{i}defgh99 and {'Ab3' * 40}") for i in range(40)]
    docs = spark.createDataFrame([*texts, (None, None), (None, texts[0][1])], "doc_id long, text string")
    rows = secrets_scan.labelled_findings(docs).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in rows} == {False: 41 * (25 + 3), True: 41}
    assert secrets_scan.labelled_findings(spark.range(3_001).select("id", F.lit("token=abcdefgh1234").alias("text"))).count() == 3_001
    network = secrets_scan.fit(docs)
    x, y = secrets_scan.made_findings(400, seed=77)
    p = network.probability(x)
    assert (p[y] >= network.threshold).mean() >= 0.9 and np.median(p[y]) > np.median(p[~y])
    out = secrets_scan.secret_scan(docs, network)
    assert out.count() == 42 and out.where("n_assign = 1").count() == 41


def test_whole_sets_are_checked_in_parts(spark):
    """each job shuffles a part of the sets alone, and together they check every pair."""
    sets = spark.createDataFrame([(v, 10, list(range(v, v + 10))) for v in range(20)], "node long, n int, shingles array<long>")
    end = lambda x: F.struct(F.col(x).alias("node"), F.lit(10).alias("n")).alias(x)
    pairs = spark.createDataFrame(list(itertools.combinations(range(20), 2)), "a long, b long").select(end("a"), end("b"))
    shelf = common.Shelf(spark)
    found = sorted((r.a.node, r.b.node) for r in ngram_join.verified(pairs, sets, shelf, 80).collect())
    assert found == [(v, v + 1) for v in range(19)] and len(shelf.paths["links"]) == ngram_join.PARTS**2
