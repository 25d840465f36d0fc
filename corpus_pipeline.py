"""A corpus from raw documents to batches: quality filter, one document per near-duplicate class, repeated spans out, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courierworks.llm import dedup, jaccard, packing, quality
from courierworks.llm.common import documents, small_batches, stage, table
from courierworks.session import prepare


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (operator 9); it is fitted on the labels of the documents it gets."""
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates (operator 7)."""
    small_batches(spark)
    return jaccard.one_per_class(docs)


def repeats_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that also start earlier (operator 2); n_chars follows the text."""
    small_batches(spark)
    small_batches(spark)
    return dedup.strip_documents(docs).withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket and batch of every document (operator 4)."""
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [("quality", good_quality), ("jaccard", one_of_each), ("suffix_dedup", repeats_removed), ("packing", packed)]

ORACLE_SQL = None  # the classifier and the tokenizer have no SQL; tests/llm/test_pipeline.py holds run() against plain code


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each result is written to the shared folder and read back."""
    prepare(spark)
    docs = documents(spark, sf_dir)
    for _, work in STAGES:
        docs = stage(work(spark, docs, sf_dir))
    return docs
