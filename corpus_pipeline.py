"""The training-data pipeline: from raw documents to packed batches.

STAGES are (name, function) pairs. Each function takes (spark, docs, sf_dir) and works on all
documents that the stage before it kept; all but the last return documents again, so a stage can
also be run by itself on any table of documents with doc_id, text and source, whatever its other
columns are called. A stage decides on narrow rows first, stores its decisions in the shared folder
and deletes what it needed to make them. `run` writes every stage's documents there as Parquet,
reads them back for the next one, and deletes the documents of the stage before.

For all stages: null and repeated ids are rows like others, null texts are read as empty, no
documents give no rows, texts of any length are read whole, and labels may be an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listings_spark.llm import copies, mixing, packing, secrets, stages, toxicity
from listings_spark.llm.common import delete, settled, shared_folder, small_batches, stored_at, table

ORACLE_SQL = None  # no stage but the last two could be told in SQL; tests use brute force


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, fitted on the labelled ones among them, does not call toxic.

    Each row is judged by its text, so equal texts stay or go together. Without labels
    nothing is toxic and all rows stay; labels of one kind only say that kind of every text.
    """
    small_batches(spark)
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id (null first).

    Of rows that share id and group, the one with the least hash of all its columns stays; of
    wholly equal rows one stays. Null, empty and blank texts are one group.
    """
    small_batches(spark)

    def decide() -> DataFrame:
        rows = stages.keyed(docs, "text")
        kept = copies.near_copies(rows).filter("doc_id = component_id")
        return kept.groupBy(F.col("doc_id").alias(stages.KEY)).agg(
            F.lit(1).alias("times"), F.count("*").alias("alike")
        )

    return stages.apply_times(docs, settled(spark, "kept", decide))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked. Null texts stay null."""
    small_batches(spark)
    return secrets.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never.

    Rows are told apart by all their columns, the source among them; a null source is a source of
    its own. Wholly equal rows draw one by one, and stand for one another.
    """

    def decide() -> DataFrame:
        mixed = mixing.mix(stages.keyed(docs, "text", "source"))
        return mixed.groupBy(F.col("doc_id").alias(stages.KEY)).agg(
            F.sum("copies").alias("times"), F.count("*").alias("alike")
        )

    return stages.apply_times(docs, settled(spark, "taken", decide))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket, batch and slot of every document; repeated rows each have their own slot."""
    return settled(spark, "packed", lambda: packing.pack(docs))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
        docs = stored_at(stage(spark, docs, sf_dir), path)
        if before:
            delete(spark, before)
        before = path
    return docs
