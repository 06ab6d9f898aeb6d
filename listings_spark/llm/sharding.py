"""Contiguous shards of near-equal byte size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listings_spark.llm.common import stored, whole
from listings_spark.llm.prefix import prefix_sums


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Cut the documents, in order of `doc_id`, into `shards` runs of near-equal bytes.

    A document counts the UTF-8 bytes of its text plus one. Its middle byte in the global order
    decides its shard, so each cut is off its equal target by half a document at most.

    Null text: size 1 and the checksum of no bytes. Null ids come last. Rows that share an id
    are ordered by checksum and size; wholly equal rows are interchangeable but each gets a slot
    of its own. A document larger than a target can leave shards without rows. Empty input: no
    rows. Other columns of `docs` are ignored.
    """
    sized = stored(
        docs.select(
            "doc_id",
            (F.octet_length(whole()).cast("long") + 1).alias("size"),
            F.crc32(whole()).alias("text_crc32"),
        ),
        "sizes",
    )
    total = sized.agg(F.sum("size")).first()[0] or 1
    placed = prefix_sums(
        sized.withColumn("one", F.lit(1).cast("long")),
        [F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size")],
        {"before": "size", "position": "one"},
    )
    shard = F.expr(f"least({shards - 1}, ((2 * before + size) * {shards}) div {2 * total})")
    cut = stored(placed.withColumn("shard", shard.cast("int")), "shards")
    first = cut.groupBy("shard").agg(F.min("position").alias("first"))  # a row per shard
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("position") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
