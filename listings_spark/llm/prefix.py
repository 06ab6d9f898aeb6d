"""Global running totals without gathering an order in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listings_spark.llm.common import stored


def prefix_sums(
    df: DataFrame, order: list[Column], sums: dict[str, str], group: str | None = None
) -> DataFrame:
    """Add exclusive running totals over `order`, for each value of `group` by itself.

    `sums` maps new names to long columns. Rows are dealt by ranges of (group, order), so a hot
    group is cut into many partitions; one row of totals per partition and group carries the
    sums onward, and only rows of one partition are ordered together. Pass narrow frames: each
    row is shuffled twice. Rows equal in the whole order are interchangeable.
    """
    by = [F.col(group).asc_nulls_last()] if group else []
    placed = stored(
        df.repartitionByRange(*by, *order)
        .sortWithinPartitions(*by, *order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "placed",
    ).withColumn("_part", F.shiftright("_at", 33))
    keys = ["_part", *([group] if group else [])]
    earlier = Window.orderBy("_part")
    if group:
        earlier = Window.partitionBy(group).orderBy("_part")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*keys)
        .agg(*[F.sum(c).alias(n) for n, c in sums.items()])
        .select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_s_{n}") for n in sums],
        )
    )
    inside = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    run = placed.select(
        "*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_r_{n}") for n, c in sums.items()]
    )
    match = F.col("_part") == F.col("_k0")
    if group:
        match = match & F.col(group).eqNullSafe(F.col("_k1"))
    return run.join(starts, match).select(
        *df.columns, *[(F.col(f"_s_{n}") + F.col(f"_r_{n}")).alias(n) for n in sums]
    )
