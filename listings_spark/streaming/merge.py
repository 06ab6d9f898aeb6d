"""Structured Streaming forms of the merge and of classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from listings_spark import constants as K
from listings_spark.functions.cascade import classify
from listings_spark.plans.state import apply_in_order, apply_log


def write_commits(log: DataFrame, path: str) -> None:
    """Append the commits of one run as one file.

    A stream takes files by the time they were written, which says nothing about files written
    together; one file for each call keeps the order of calls. A run holds at most the results and
    rechecks of its searches, so it fits a task. Call it in commit order: the merge refuses a
    commit older than one it has merged.
    """
    log.coalesce(1).write.mode("append").parquet(path)


def log_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """Commit log as a stream of parquet files."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def merge_stream(
    log: DataFrame,
    base: str,
    checkpoint: str,
    threshold: int = K.CLOSURE_CONFIRMATIONS,
    **trigger,
) -> StreamingQuery:
    """Merge each micro-batch into published state.

    Inside a batch commits apply in run order. A batch that is replayed after a failure finds
    its commits already merged and changes nothing. A late commit ends the query with its state
    as it was.
    """

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        apply_log(batch, base, threshold)

    return (
        log.writeStream.foreachBatch(merge_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def merge_stream_in_order(
    log: DataFrame,
    base: str,
    checkpoint: str,
    expected: DataFrame | None = None,
    delay: int = 0,
    threshold: int = K.CLOSURE_CONFIRMATIONS,
    **trigger,
) -> StreamingQuery:
    """Merge a stream whose commits arrive in any order (`state.apply_in_order`).

    Files may hold any commits, in any number of files and tasks. After the stream has ended, one
    call of `apply_in_order` with `last` on no rows merges what still waits.
    """

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        apply_in_order(batch, base, expected, delay, threshold)

    return (
        log.writeStream.foreachBatch(merge_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def classify_stream(listings: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Stateless classification of a stream of raw listings into parquet."""
    return (
        classify(listings)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
