"""Reports on the run log: totals at every level in one pass, and observations with the run before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_HOURS = 24
LEVELS = ("grp", "search_slug", "status")
SUMMED = ("found_count", "accepted_count", "excluded_count", "warning_count")


def run_totals(runs: DataFrame, searches: DataFrame, nested: bool = False) -> DataFrame:
    """Totals of the run log for all combinations of group, search and status.

    With `nested` only the levels all, group, group and search, and all three. `level` is the
    grouping id: a set bit (group 4, search 2, status 1) means that the column is summed over,
    which tells a total from a group whose value is null. Runs of unknown searches have no group.

    Rows are combined at the finest level first, so the expansion into levels works on few rows
    and a search that holds most runs is added up before the shuffle. No runs: the grand total of
    a rollup is not made up; there are no rows.
    """
    finest = runs.groupBy("search_slug", "status").agg(
        F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in SUMMED],
        F.max("duration_ms").alias("longest_ms"), F.max("finished_at").alias("last_at"),
    )
    groups = searches.select(F.col("slug").alias("search_slug"), "grp").dropDuplicates(["search_slug"])
    leveled = finest.join(groups, "search_slug", "left")
    by = leveled.rollup(*LEVELS) if nested else leveled.cube(*LEVELS)
    return by.agg(
        F.grouping_id().alias("level"), F.sum("runs").alias("runs"), *[F.sum(c).alias(c) for c in SUMMED],
        F.max("longest_ms").alias("longest_ms"), F.max("last_at").alias("last_at"),
    ).filter(F.col("runs").isNotNull())


def with_run_before(
    rows: DataFrame, runs: DataFrame, at: str, search: str = "search_slug", hours: int = SLICE_HOURS,
    name: str = "run",
) -> DataFrame:
    """Each row with the latest run of its search that finished at or before it (null if there is none).

    One union, one sort and a last-value pass instead of a join of ranges. The history of a search
    is cut into slices of `hours`: every slice starts from the last run of the slices before
    it, which is found on one row a slice, so a search that holds most rows is many tasks' work.

    Of runs that finish together the one with the greatest id counts. Rows without search or time
    have no run; runs without either are never found. Repeated rows stay; columns of any names
    stay as they are, `name` is added.
    """

    def slice_of(time: Column) -> Column:
        return F.floor(F.unix_micros(time.cast("timestamp")) / F.lit(hours * 3_600_000_000)).cast("long")

    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    nested = rows.select(row.alias("row"))
    key, time = F.col(f"row.`{search}`"), F.col(f"row.`{at}`")
    timed = key.isNotNull() & time.isNotNull()
    found = F.struct(*[F.col(f"`{c}`") for c in runs.columns])
    kept = runs.filter(F.col("search_slug").isNotNull() & F.col("finished_at").isNotNull())
    kind = kept.select(found.alias("run")).schema["run"].dataType
    events = nested.filter(timed).select(
        key.alias("key"), time.alias("at"), F.lit(None).cast("string").alias("id"), "row",
        F.lit(None).cast(kind).alias("run"),
    ).unionByName(
        kept.select(
            F.col("search_slug").alias("key"), F.col("finished_at").alias("at"), F.col("id").alias("id"),
            F.lit(None).cast(nested.schema["row"].dataType).alias("row"), found.alias("run"),
        )
    ).withColumn("slice", slice_of(F.col("at")))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        events.groupBy("key", "slice")
        .agg(F.max_by("run", F.when(F.col("run").isNotNull(), F.struct("at", "id"))).alias("last"))
        .select("key", "slice", F.last("last", ignorenulls=True).over(before).alias("carried"))
    )
    # Runs come before rows of their time.
    inside = Window.partitionBy("key", "slice").orderBy("at", F.col("row").isNotNull(), "id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    met = (
        events.withColumn("met", F.last("run", ignorenulls=True).over(inside))
        .filter(F.col("row").isNotNull())
        .join(carried, ["key", "slice"])
        .select("row", F.coalesce("met", "carried").alias("run"))
    )
    never = nested.filter(~timed).select("row", F.lit(None).cast(kind).alias("run"))
    return met.unionByName(never).select("row.*", F.col("run").alias(name))
