"""The append-only run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listings_spark import constants as K

RUN_COLUMNS = (
    "id", "run_seq", "search_slug", "status", "started_at", "finished_at", "duration_ms",
    "found_count", "accepted_count", "excluded_count", "warning_count", "error_code",
    "error_message",
)
COUNTS = ("found_count", "accepted_count", "excluded_count", "warning_count")


def run_rows(runs: DataFrame) -> DataFrame:
    """Run rows in stored form: failures count nothing and carry bounded error texts."""
    failed = F.col("status") == "failed"
    return runs.select(
        *[F.col(c) for c in RUN_COLUMNS if c not in (*COUNTS, "error_code", "error_message")],
        *[F.when(failed, 0).otherwise(F.col(c)).cast("int").alias(c) for c in COUNTS],
        F.when(failed, F.substring("error_code", 1, K.MAX_ERROR_CODE)).alias("error_code"),
        F.when(failed, F.substring("error_message", 1, K.MAX_ERROR_MESSAGE)).alias(
            "error_message"
        ),
    ).select(*RUN_COLUMNS)


def append_runs(runs: DataFrame, path: str) -> None:
    """Append run rows, partitioned by run date."""
    rows = run_rows(runs).withColumn("run_date", F.to_date("finished_at"))
    rows.write.mode("append").partitionBy("run_date").parquet(path)


def new_commits(rows: DataFrame, log: DataFrame, key: str = "run_seq") -> DataFrame:
    """Rows whose commit is not in the log yet; replays of a commit change nothing."""
    return rows.join(log.select(key).distinct(), key, "left_anti")
