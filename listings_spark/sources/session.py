"""Session helpers: local test sessions and the shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "listings", cpus: str | None = None) -> SparkSession:
    """Session for tests and local benchmarks; clusters bring their own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LISTINGS_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to executors that do not have it installed.

    Python functions are sent by reference, so workers must be able to import them.
    """
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="listings-package-")  # of the driver; Spark copies the file
    archive = shutil.make_archive(
        f"{folder}/{package.name}", "zip", root_dir=package.parent, base_dir=package.name
    )
    spark.sparkContext.addPyFile(archive)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; fall back to a local one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = context.getConf().get("spark.checkpoint.dir")
    if not shared:
        shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="listings-checkpoint-")
    context.setCheckpointDir(shared)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row work enough tasks when a scan has fewer partitions than cores.

    Large inputs already have more partitions and pass unchanged, without a shuffle. Use it on
    plain scans, where counting partitions runs no job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """Deal rows out evenly to a few tasks a core, for CPU-heavy row work behind a join.

    Joins and scans put narrow rows into as many tasks as their bytes need, however much work each
    row is. The number is explicit, so Spark does not merge the tasks again. Call it while rows are
    narrow.
    """
    session = df.sparkSession
    shuffled = int(session.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(3 * session.sparkContext.defaultParallelism, shuffled))
