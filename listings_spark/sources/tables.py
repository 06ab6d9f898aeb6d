"""Whole-table replacement: a new version folder, then one line in the version log.

Parquet has no row-level merge, so merged tables are written as a new version. The version log
is a small table that Spark appends one row to after the data is complete; its file appears
at once when that write commits. Readers take the highest logged version, so they see the old
or the new state and never a mixture. There is one writer at a time.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSIONS = "_versions"
QUARANTINE = "_quarantine"


class BrokenState(ValueError):
    """A publication with more broken rows than allowed; no version was logged."""


def read_if_present(reader, path: str) -> DataFrame | None:
    """Result of `reader(path)`, or null when nothing has been written there."""
    try:
        return reader(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def current_version(spark: SparkSession, base: str) -> int | None:
    """Highest complete version, null before the first write."""
    log = read_if_present(spark.read.schema("version bigint").json, f"{base}/{VERSIONS}")
    return None if log is None else log.agg(F.max("version")).first()[0]


def version_path(base: str, version: int) -> str:
    """Folder of one version."""
    return f"{base}/v{version:08d}"


def read_current(spark: SparkSession, base: str) -> DataFrame:
    """The table of the current version."""
    version = current_version(spark, base)
    if version is None:
        raise ValueError(f"no version has been written to {base}")
    return spark.read.parquet(version_path(base, version))


def replace_table(df: DataFrame, base: str, **layout) -> int:
    """Write a whole new version; a failed write leaves readers unaffected."""
    return publish({"": df}, base, **layout)


def publish(
    tables: dict[str, DataFrame],
    base: str,
    partition_by: dict[str, tuple[str, ...]] | None = None,
    sort_by: dict[str, tuple[str, ...]] | None = None,
) -> int:
    """Replace several tables that belong together in one step.

    Sorting within files lets readers skip row groups by the sorted columns.
    """
    spark = next(iter(tables.values())).sparkSession
    version = (current_version(spark, base) or 0) + 1
    for name, df in tables.items():
        order = (sort_by or {}).get(name, ())
        parts = (partition_by or {}).get(name, ())
        rows = df.sortWithinPartitions(*parts, *order) if order else df
        folder = version_path(base, version) + (f"/{name}" if name else "")
        # A folder left by a writer that died before logging its version is overwritten.
        rows.write.mode("overwrite").partitionBy(*parts).parquet(folder)
    entry = spark.createDataFrame([(version,)], "version bigint").coalesce(1)
    entry.write.mode("append").json(f"{base}/{VERSIONS}")
    return version


def read_published(spark: SparkSession, base: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """Tables of the current version, all from the same version; empty before the first."""
    version = current_version(spark, base)
    if version is None:
        return {}
    folder = version_path(base, version)
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


BUCKET = "state_bucket"


def bucket_of(key: str, buckets: int) -> Column:
    """Bucket of a row by a hash of its key."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, base: str) -> dict:
    """What the current version holds: its number of buckets and, for every table, the version
    that each filled bucket was last written in. Empty before the first publication."""
    log = read_if_present(
        spark.read.schema("version bigint, manifest string").json, f"{base}/{VERSIONS}"
    )
    newest = None if log is None else log.agg(F.max_by("manifest", "version")).first()[0]
    return json.loads(newest) if newest else {}


def broken_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that gives null is broken."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    )


def _written(
    rows: DataFrame, order: list[str], folder: str, rules: dict[str, Column] | None
) -> tuple[int, DataFrame | None]:
    """Write the rows that break no rule; how many were set aside, counted in the same pass, and which."""
    flagged, observation = rows, None
    if rules:
        observation = Observation()
        flagged = rows.withColumn("violations", broken_rules(rules))
    sorted_ = flagged.repartitionByRange(*order).sortWithinPartitions(*order)
    if observation:
        # Behind the exchange, so that sampling the ranges counts nothing.
        sorted_ = (
            sorted_.observe(observation, F.count_if(F.size("violations") > 0).alias("broken"))
            .filter(F.size("violations") == 0).drop("violations")
        )
    sorted_.write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
    broken = observation.get["broken"] if observation else 0
    return broken, flagged.filter(F.size("violations") > 0).drop(BUCKET) if broken else None


def publish_buckets(
    tables: dict[str, DataFrame],
    base: str,
    key: str,
    touched: list[int],
    buckets: int,
    sort_by: dict[str, tuple[str, ...]] | None = None,
    whole: dict[str, DataFrame] | None = None,
    rules: dict[str, dict[str, Column]] | None = None,
    allowed: int = 0,
) -> int:
    """Replace the touched buckets of several tables in one step; all others keep their files.

    `tables` hold the whole new content of the touched buckets; tables in `whole` are replaced. A
    version's folder has only what that version wrote; the version log says where every bucket
    lives and what columns a table has, so readers see one state and never a mixture. Buckets
    written before a column was added read it as null. Large buckets are written by several tasks.

    Rows that break `rules` are set aside in the quarantine with the names of these rules. With more
    than `allowed` of them no version is logged and readers see the state before.
    """
    spark = next(iter(tables.values())).sparkSession
    before = manifest(spark, base)
    version = (current_version(spark, base) or 0) + 1
    held = {name: dict(where) for name, where in before.get("tables", {}).items()}
    schemas, aside = dict(before.get("schemas", {})), 0
    for name, df in tables.items():
        folder = f"{version_path(base, version)}/{name}"
        order = [BUCKET, *(sort_by or {}).get(name, ())]
        rows = df.withColumn(BUCKET, bucket_of(key, buckets))
        broken, rest = _written(rows, order, folder, (rules or {}).get(name))
        if rest is not None:
            entry = rest.select(
                F.lit(version).cast("bigint").alias("version"), F.lit(name).alias("table"),
                F.col(key).cast("string").alias("key"), "violations",
                F.to_json(F.struct(*[c for c in df.columns])).alias("row"),
            )
            entry.write.mode("append").json(f"{base}/{QUARANTINE}")
        aside += broken
        written = spark.read.schema(rows.schema).parquet(folder).select(BUCKET).distinct().collect()
        filled = {r[0] for r in written}  # one number for each touched bucket at most
        where = held.setdefault(name, {})
        for bucket in touched:
            where.pop(str(bucket), None)
        where.update({str(b): version for b in filled})
        schemas[name] = df.schema.jsonValue()
    if aside > allowed:
        raise BrokenState(f"{aside} rows break the rules of {base}, {allowed} are allowed")
    for name, df in (whole or {}).items():
        df.write.mode("overwrite").parquet(f"{version_path(base, version)}/{name}")
    text = json.dumps({
        "buckets": buckets, "tables": held, "schemas": schemas,
        "whole": {**before.get("whole", {}), **dict.fromkeys(whole or {}, version)},
    })
    entry = spark.createDataFrame([(version, text)], "version bigint, manifest string").coalesce(1)
    entry.write.mode("append").json(f"{base}/{VERSIONS}")
    return version


def read_quarantine(spark: SparkSession, base: str) -> DataFrame | None:
    """Rows set aside by publications: version, table, key, violations, row; null if there are none.

    A version that was refused and written again is listed for each attempt.
    """
    shape = "version bigint, table string, key string, violations array<string>, row string"
    return read_if_present(spark.read.schema(shape).json, f"{base}/{QUARANTINE}")


def read_buckets(
    spark: SparkSession, base: str, name: str, now: dict, only: list[int] | None = None
) -> DataFrame | None:
    """A table of the state that manifest `now` describes, or some of its buckets; null if empty."""
    held = now.get("tables", {}).get(name, {})
    chosen = held if only is None else {b: v for b, v in held.items() if int(b) in set(only)}
    paths = [
        f"{version_path(base, v)}/{name}/{BUCKET}={b}" for b, v in sorted(chosen.items())
    ]
    schema = now.get("schemas", {}).get(name)
    reader = spark.read.schema(StructType.fromJson(schema)) if schema else spark.read
    if paths:
        return reader.parquet(*paths)
    return spark.createDataFrame([], StructType.fromJson(schema)) if schema else None


def read_whole(spark: SparkSession, base: str, name: str, now: dict) -> DataFrame | None:
    """A table that every version holds whole; null before the first publication."""
    version = now.get("whole", {}).get(name)
    return None if version is None else spark.read.parquet(f"{version_path(base, version)}/{name}")


def drop_old_versions(spark: SparkSession, base: str, keep: int = 2) -> list[int]:
    """Delete version folders that none of the last `keep` versions refers to."""
    log = spark.read.schema("version bigint, manifest string").json(f"{base}/{VERSIONS}")
    rows = log.orderBy(F.desc("version")).limit(keep).collect()
    used = {r["version"] for r in rows}
    for row in rows:
        told = json.loads(row["manifest"] or "{}")
        used.update(told.get("whole", {}).values())
        for held in told.get("tables", {}).values():
            used.update(held.values())
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    dropped = []
    for entry in files.listStatus(root):
        name = entry.getPath().getName()
        if name[0] == "v" and name[1:].isdigit() and int(name[1:]) not in used:
            files.delete(entry.getPath(), True)
            dropped.append(int(name[1:]))
    return sorted(dropped)
