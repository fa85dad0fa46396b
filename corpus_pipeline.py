"""A corpus pipeline of text operators; each stage's rows are written as Parquet and read again.

The stages: toxic documents go, copies go, one document of each group of near copies stays, sources
are mixed to their target weights (a document may then come twice), and the mix is packed into
sequences.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sealane.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from sealane.llm.common import delete, documents, labels, shared_folder

#: Near copies have a Jaccard index of 80 % on shingles of five words; op7's 90 % on three bind that query only.
NEAR_PERCENT, NEAR_SHINGLE = 80, 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores 0.5 or more for toxicity go, each judged by itself.

    Null ids and repeated ids are judged by their own text; a null or empty text is scored like any
    other.  Texts of any length are scored whole.  An empty table, or one without labels, loses nothing.
    """
    return toxicity.without_toxic(docs, labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space the row with the smallest doc_id stays, null ids last.

    Null texts count as empty and are copies of each other.  Of repeated rows with one id one stays.
    Texts of any length and other columns, whatever their names, pass unchanged.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard index of 80 % or more on five-word shingles the smallest doc_id stays, null ids last.

    Links chain.  Rows without words are in no group and stay; rows of one id are each judged by
    their own text.  An empty table stays empty.
    """
    return ngram_join.one_of_each(docs, NEAR_PERCENT, NEAR_SHINGLE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each source's documents in proportion to its weight; a document may come twice or not at all.

    A null source is a source, the last one; null texts have no size.  Rows of one id are told apart
    by a hash of source and text.  An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1,024 tokens; only longer documents are cut.

    A null text is empty and is its end token alone.  The last stage: it returns pieces and not the
    columns of documents.  An empty table gives none.
    """
    return packing.pack(docs, packing.tokenizer_path())


#: Bytes of an Arrow batch between Spark and Python: whole documents go through the workers of several stages,
#: and an executor holds a batch of each worker several times.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    (name, in_small_batches(stage))
    for name, stage in [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard_join", drop_near_copies), ("source_mixing", mix), ("best_fit_packing", pack)]
]

#: Toxicity is scored by a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages keep of ``documents``."""
    root, docs, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            delete(spark, before)
        before = path
    return docs
