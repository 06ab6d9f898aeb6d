"""Verifiable table snapshots: a copy and a one-row manifest with an order-free digest."""

from __future__ import annotations

import hashlib
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from listings_spark.sources import tables
from listings_spark.sources.session import ensure_checkpoint_dir

FORMAT_VERSION = 1
TREE_DEPTH = 2  # 256 buckets
RETENTION_POLICY = "calendar-days"
MAX_RETENTION_DAYS = 3650
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"  # to the microsecond, as the tables hold it
TABLES = ("searches", "runs", "listings", "provenance")


def table_digest(df: DataFrame, name: str = "table") -> DataFrame:
    """Row count and order-free digest of a table, one aggregation.

    Every row is hashed over all its columns, each written with its length in bytes, so that no
    two different rows read alike and null differs from empty text. Two halves of the hash are
    summed, so neither row order nor partitioning matters and repeated rows still count.
    """

    return df.agg(F.lit(name).alias("table"), *_digest(df))


def _digest(df: DataFrame) -> list[Column]:
    """Aggregates: row count and both sums of the row hashes."""

    def written(name: str) -> Column:
        column = F.col(f"`{name}`")
        flat = isinstance(df.schema[name].dataType, (ArrayType, MapType, StructType))
        text = F.to_json(column, {"ignoreNullFields": "false"}) if flat else column.cast("string")
        return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("N"))

    code = F.sha2(F.concat_ws(",", *[written(c) for c in df.columns]), 256)

    def half(start: int) -> Column:
        return F.sum(F.conv(F.substring(code, start, 16), 16, 10).cast("decimal(38,0)"))

    return [
        F.count("*").alias("row_count"),
        half(1).cast("string").alias("digest_high"),
        half(17).cast("string").alias("digest_low"),
    ]


def digest_tree(df: DataFrame, key: str, depth: int = TREE_DEPTH) -> DataFrame:
    """(level, node, row_count, digest): a tree of digests over buckets of hashed keys.

    A bucket is named by the first `depth` hex digits of the md5 of its key (null: of nothing), a
    node above by fewer; the root has no digits. Leaves hash their rows free of order, nodes
    hash their children. The table is aggregated once; what lies above has 16 ** depth rows or fewer.
    """
    ensure_checkpoint_dir(df.sparkSession)
    bucket = F.substring(F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 1, depth)
    level = df.groupBy(bucket.alias("_node")).agg(*_digest(df)).select(
        F.col("_node").alias("node"), "row_count",
        F.sha2(F.concat_ws(":", "row_count", "digest_high", "digest_low"), 256).alias("digest"),
    ).withColumn("level", F.lit(depth)).checkpoint()
    tree = level
    for above in range(depth - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.concat_ws(":", "node", "digest")))
        level = level.groupBy(F.substring("node", 1, above).alias("node")).agg(
            F.sum("row_count").alias("row_count"), F.sha2(F.array_join(children, ","), 256).alias("digest")
        ).withColumn("level", F.lit(above))
        tree = tree.unionByName(level)
    return tree.select("level", "node", "row_count", "digest")


def write_tree(tree: DataFrame, path: str) -> None:
    """Store a tree, one folder a level."""
    tree.write.partitionBy("level").parquet(path)


def damaged_buckets(spark: SparkSession, expected: str, actual: str, depth: int = TREE_DEPTH) -> DataFrame:
    """(node, expected_rows, actual_rows) of the buckets in which two stored trees differ.

    Goes down from the root and reads below differing nodes only; equal trees end there. A bucket that
    one side lacks has null rows on that side.
    """

    ensure_checkpoint_dir(spark)
    schema = "node string, row_count long, digest string, level int"
    sides = [spark.read.schema(schema).parquet(path) for path in (expected, actual)]
    suspects = None
    for level in range(depth + 1):
        left, right = (
            side.filter(F.col("level") == level).select("node", F.col("row_count").alias(f"{name}_rows"), F.col("digest").alias(name))
            for side, name in zip(sides, ("expected", "actual"), strict=True)
        )
        if suspects is not None:
            parents = suspects.select(F.col("node").alias("_parent"))
            left, right = (
                side.join(parents, F.substring("node", 1, level - 1) == F.col("_parent"), "left_semi")
                for side in (left, right)
            )
        suspects = left.join(right, "node", "full").filter(~F.col("expected").eqNullSafe(F.col("actual"))).select(
            "node", "expected_rows", "actual_rows"
        ).checkpoint()
        if suspects.isEmpty():
            break
    return suspects


def schema_revision(df: DataFrame) -> str:
    """Fingerprint of names and types."""
    text = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    return hashlib.sha256(text.encode()).hexdigest()


def _contents(state: dict[str, DataFrame]) -> DataFrame:
    parts = None
    for name, df in state.items():
        row = table_digest(df, name).withColumn("schema_revision", F.lit(schema_revision(df)))
        parts = row if parts is None else parts.unionByName(row)
    return parts


def _overall(contents: DataFrame) -> DataFrame:
    """One row over the few table digests of a snapshot."""
    entry = F.concat_ws(
        ":", "table", "row_count", "digest_high", "digest_low", "schema_revision",
    )
    joined = F.array_join(F.array_sort(F.collect_list(entry)), ",")
    return contents.agg(
        F.sha2(joined, 256).alias("sha256"), F.sum("row_count").alias("row_count")
    )


def _collected(state: dict[str, DataFrame]) -> datetime | None:
    runs = state["runs"].filter("status = 'success'").agg(F.max("finished_at").alias("t"))
    return runs.first()["t"]


def create_snapshot(
    state: dict[str, DataFrame],
    base: str,
    *,
    created_at: datetime,
    retention_days: int,
    run_id: str,
    run_attempt: int = 1,
    previous_key: str | None = None,
) -> str:
    """Copy the state tables and write their manifest; returns the snapshot key.

    The manifest is written last, so an interrupted snapshot has none and is not valid. An
    existing snapshot is never overwritten.
    """
    if not 1 <= retention_days <= MAX_RETENTION_DAYS:
        raise ValueError(f"retention_days must be between 1 and {MAX_RETENTION_DAYS}")
    if run_attempt < 1:
        raise ValueError("run_attempt must be positive")
    spark = state["runs"].sparkSession
    key = f"{created_at:%Y%m%dT%H%M%S.%fZ}-run-{run_id}-attempt-{run_attempt}"
    folder = f"{base}/{key}"
    if tables.read_if_present(spark.read.text, folder) is not None:
        raise ValueError(f"snapshot already exists: {key}")
    if previous_key is not None:
        manifests = tables.read_if_present(
            lambda _: load_manifest(spark, base, previous_key), previous_key
        )
        before = None if manifests is None else manifests.first()
        if before is None:
            raise ValueError(f"previous snapshot does not exist: {previous_key}")
        if before["created_at"] > created_at:
            raise ValueError("the previous snapshot cannot be newer than the new one")
    collected = _collected(state)
    if collected is not None and collected > created_at:
        raise ValueError("the collection time cannot follow the snapshot")
    for name, df in state.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    copied = {name: spark.read.parquet(f"{folder}/{name}") for name in state}
    retention = F.struct(
        F.lit(RETENTION_POLICY).alias("policy"), F.lit(retention_days).alias("days"),
        F.lit(created_at + timedelta(days=retention_days)).cast("timestamp_ntz").alias(
            "retain_until"
        ),
    )
    manifest = _overall(_contents(copied)).select(
        F.lit(FORMAT_VERSION).alias("format_version"),
        F.lit(key).alias("key"), "sha256", "row_count",
        F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
        F.lit(collected).cast("timestamp_ntz").alias("collected_at"),
        F.lit(previous_key).cast("string").alias("previous_key"),
        retention.alias("retention"),
        F.struct(F.lit(run_id).alias("run_id"), F.lit(run_attempt).alias("run_attempt")).alias(
            "source"
        ),
    )
    manifest.write.mode("errorifexists").option("timestampNTZFormat", TIME_FORMAT).json(
        f"{folder}/manifest"
    )
    return key


MANIFEST = (
    "format_version int, key string, sha256 string, row_count bigint, created_at timestamp_ntz,"
    " collected_at timestamp_ntz, previous_key string,"
    " retention struct<policy:string, days:int, retain_until:timestamp_ntz>,"
    " source struct<run_id:string, run_attempt:int>"
)


def load_manifest(spark: SparkSession, base: str, key: str = "*") -> DataFrame:
    """Manifest of one snapshot, or of all of them."""
    reader = spark.read.schema(MANIFEST).option("timestampNTZFormat", TIME_FORMAT)
    return reader.json(f"{base}/{key}/manifest")


def verify_snapshot(spark: SparkSession, base: str, key: str) -> DataFrame:
    """One row naming what disagrees with the manifest; an empty list means verified."""
    copied = {name: spark.read.parquet(f"{base}/{key}/{name}") for name in TABLES}
    actual = _overall(_contents(copied)).select(F.struct("sha256", "row_count")).scalar()
    collected = _collected(copied)
    manifest = load_manifest(spark, base, key)
    return manifest.withColumn("_actual", actual).select(
        "key",
        F.array_compact(
            F.array(
                F.when(F.col("key") != key, F.lit("key")),
                F.when(F.col("sha256") != F.col("_actual.sha256"), F.lit("digest")),
                F.when(F.col("row_count") != F.col("_actual.row_count"), F.lit("size")),
                F.when(
                    ~F.col("collected_at").eqNullSafe(
                        F.lit(collected).cast("timestamp_ntz")
                    ),
                    F.lit("collection_time"),
                ),
            )
        ).alias("problems"),
    )


def manifest_violations(manifests: DataFrame) -> DataFrame:
    """Manifests with the rules they break, including the history chain."""
    earlier = manifests.select(
        F.col("key").alias("_key"), F.col("created_at").alias("_created")
    )
    joined = manifests.join(earlier, F.col("previous_key") == F.col("_key"), "left")
    days = F.col("retention.days")

    def when(condition, name):
        return F.when(F.coalesce(condition, F.lit(False)), F.lit(name))

    due = F.col("created_at") + F.make_dt_interval(days)
    return joined.select(
        "key",
        F.array_compact(
            F.array(
                when(F.col("format_version") != FORMAT_VERSION, "format_version"),
                when(F.col("collected_at") > F.col("created_at"), "collected_after_creation"),
                when(~days.between(1, MAX_RETENTION_DAYS), "retention_days"),
                when(F.col("retention.policy") != RETENTION_POLICY, "retention_policy"),
                when(F.col("retention.retain_until") != due, "retain_until"),
                when(~F.col("sha256").rlike("^[0-9a-f]{64}$"), "digest_shape"),
                when(F.col("previous_key") == F.col("key"), "previous_is_self"),
                when(
                    F.col("previous_key").isNotNull() & F.col("_key").isNull(),
                    "previous_missing",
                ),
                when(F.col("_created") > F.col("created_at"), "previous_is_newer"),
            )
        ).alias("violations"),
    )
