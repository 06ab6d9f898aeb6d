"""The registered queries of the training-data operators and their SQL twins.

Each query runs its operator over the whole table with production parameters and keeps the
columns of its contract.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listings_spark.llm import (
    divergence,
    embeddings,
    mixing,
    packing,
    pieces,
    secrets,
    sharding,
    simhash,
    sketches,
    suffix,
    toxicity,
    twins,
    warc,
    whitening,
)
from listings_spark.llm.common import shared_folder, small_batches, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return sketches.fingerprints(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.page_records(warc.read_archive(spark, folder))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.near_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", simhash.hex_print(F.col("print")).alias("fingerprint"), "component_id"
    )


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding, op2_packing, op3_mixing, op4_sketches, op5_toxicity, op6_warc, op7_simhash, op8_embeddings, op9_secrets, op10_suffix,
        op11_pieces, op12_whitening, op13_divergence,
    )
}

# Without a twin: op2 (dynamic programming), op4 and op7 (hashes that the other engine lacks), op5
# (training), op9 (positions of matches). Tests hold these against brute force.
ORACLES = {
    "op1_sharding": twins.SHARDING,
    "op3_mixing": twins.MIXING,
    "op6_warc": twins.WARC,
    "op8_embeddings": twins.EMBEDDINGS,
    "op10_suffix": twins.SUFFIX,
    "op13_divergence": twins.DIVERGENCE,
}
