"""Shared helpers of the training-data operators: tables, stored results, sessions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listings_spark.sources.session import ensure_checkpoint_dir

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This session's folder inside `spark.checkpoint.dir`, which all executors share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


_scratch: list[str] = []  # folders of results that are being built, innermost last


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage with files that survive lost executors, fixes whatever the plan decided by
    sampling (range bounds), and gives later joins real sizes to plan with.
    """
    folder = _scratch[-1] if _scratch else shared_folder(df.sparkSession)
    return stored_at(df, f"{folder}/{name}-{uuid.uuid4().hex}")


def stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored result of `build`, with all tables deleted that it stored on the way."""
    folder = f"{shared_folder(spark)}/{name}-parts-{uuid.uuid4().hex}"
    _scratch.append(folder)
    try:
        made = build()
        _scratch.pop()
        try:
            return stored(made, name)
        finally:
            _scratch.append(folder)
    finally:
        _scratch.pop()
        delete(spark, folder)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete what `stored` wrote in this session; call it when results have been written."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for entry in system.listStatus(folder):
        system.delete(entry.getPath(), True)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that long texts do not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def text_slices(texts: list, most: int = 1 << 21):
    """(start, texts) of runs of about `most` characters or bytes, so that work on a batch stays small."""
    start, held = 0, 0
    for nth, text in enumerate(texts, 1):
        held += len(text)
        if held >= most or nth == len(texts):
            yield start, texts[start:nth]
            start, held = nth, 0


def whole(text: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def word_count(text: str = "text") -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def uniform(*parts: Column, seed: int = 0) -> Column:
    """A reproducible number in (0, 1) from the md5 of the parts."""
    tag = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    drawn = F.conv(F.substring(F.md5(tag), 1, 12), 16, 10).cast("double")
    return (drawn + 0.5) / float(1 << 48)
