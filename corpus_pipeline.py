"""A training corpus in five stages, each over all that the one before kept.

Rows that a stage rejects are gone for the stages that follow; all but the last
return the columns of ``documents``.  Each result is written to the shared folder
and read again, so a lost executor repeats no more than its tasks of one stage.

Null and empty texts go at the first stage; an empty table passes through all of
them.  Null and repeated ids are rows like others; of equal near duplicates one
stays, else the one with the smallest id.  Other columns are passed on, whatever
they are called.

The stages set the session's ``spark.sql.execution.arrow.maxBytesPerBatch`` to
``BATCH_BYTES``: each task holds a batch of texts that goes to Python several times
beside the executor's heap, and Spark's own bound is 64 MB.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodemap.llm import bpe, decontaminate, jaccard, quality, toxicity
from lodemap.llm.shared import stored, table

#: Bytes of an Arrow batch that goes to Python, about; it holds one row at least.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.near_duplicates(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("decoded")


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", not_in_benchmark),
    ("BPE encoding and decoding", encoded),
]

#: Perplexities, a fitted classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
