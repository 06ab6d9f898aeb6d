"""Total orders, top-k per group and result pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listings_spark import constants as K
from listings_spark.sources.session import ensure_checkpoint_dir

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def with_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Number rows 1..n in a total order without moving them through one task.

    Rows are range-partitioned and sorted; the sorted pieces are checkpointed so that
    piece numbers stay fixed; only the piece sizes are summed up centrally, and their number
    is the number of partitions.
    """
    ensure_checkpoint_dir(df.sparkSession)
    pieces = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .checkpoint()
    )
    # monotonically_increasing_id keeps the partition number above 33 row bits.
    piece = F.shiftright("_at", 33)
    sizes = pieces.groupBy(piece.alias("_piece")).agg(F.count("*").alias("_size"))
    starts = sizes.select(
        "_piece",
        F.coalesce(
            F.sum("_size").over(
                Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_start"),
    )
    return (
        pieces.withColumn("_piece", piece)
        .join(F.broadcast(starts), "_piece")
        .withColumn(
            name, F.col("_start") + (F.col("_at") - F.shiftleft("_piece", 33)) + F.lit(1)
        )
        .drop("_piece", "_start", "_at")
    )


def publication_order() -> list[Column]:
    """Company, title, location; the id makes the order total. Case folds for A-Z only."""

    def folded(name: str) -> Column:
        return F.translate(F.col(name), ASCII_UPPER, ASCII_UPPER.lower()).asc()

    return [folded("company"), folded("title"), F.col("location").asc(), F.col("listing_id").asc()]


def directory_order() -> list[Column]:
    """Newest first; ids compare as strings."""
    return [F.col("first_seen_at").desc(), F.col("listing_id").desc()]


def column_order(column: str = "first_seen_at", descending: bool = True) -> list[Column]:
    """One chosen column, then the id."""
    if column not in ("company", "title", "location", "first_seen_at"):
        raise ValueError(f"cannot sort by {column}")
    chosen = F.col(column)
    return [chosen.desc() if descending else chosen.asc(), F.col("listing_id").desc()]


def open_listings(listings: DataFrame) -> DataFrame:
    """Listings that are open."""
    return listings.filter(F.col("status") == "open")


def latest_per_type(listings: DataFrame, limit: int = K.PREVIEW_LIMIT) -> DataFrame:
    """Newest open listings of each employment type; each task keeps only its own top rows."""
    newest = Window.partitionBy("employment_type").orderBy(*directory_order())
    return (
        open_listings(listings)
        .withColumn("rank", F.row_number().over(newest))
        .filter(F.col("rank") <= limit)
    )


def result_page(df: DataFrame, order: list[Column], index: int = 0, size: int = 10) -> DataFrame:
    """One zero-based page of a total order, with ranks."""
    if size not in K.PAGE_SIZES:
        raise ValueError(f"page size must be one of {K.PAGE_SIZES}")
    if index < 0:
        raise ValueError("page index starts at zero")
    # Spark keeps a top-k per task, or sorts by ranges where the page lies too deep for that.
    rows = df.orderBy(*order).offset(index * size).limit(size)
    # At most one page of rows is numbered here.
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) + index * size)


def write_ordered(df: DataFrame, path: str, order: list[tuple[str, bool]]) -> None:
    """Write files sorted by an order, so that a page by key reads the row groups at its key."""
    by = [F.desc(c) if descending else F.asc(c) for c, descending in order]
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(path)


def page_after(
    df: DataFrame, order: list[tuple[str, bool]], last: dict | None = None, size: int = 10
) -> DataFrame:
    """The next page behind the row with the values `last`, in a total order of (column, descending).

    Unlike an offset, depth costs nothing: the key is a filter that reaches the scan. Nulls come first
    in rising and last in falling columns. Without `last` it is the first page.
    """
    if size not in K.PAGE_SIZES:
        raise ValueError(f"page size must be one of {K.PAGE_SIZES}")
    rows = df
    if last is not None:
        missing = [c for c, _ in order if c not in last]
        if missing:
            raise ValueError(f"the key lacks {', '.join(missing)}")
        behind = F.lit(False)
        for nth in range(len(order) - 1, -1, -1):
            name, descending = order[nth]
            column, value = F.col(name), last[name]
            if value is None:
                further, same = F.lit(False) if descending else column.isNotNull(), column.isNull()
            elif descending:
                further, same = (column < F.lit(value)) | column.isNull(), column == F.lit(value)
            else:
                further, same = column > F.lit(value), column == F.lit(value)
            behind = further | (same & behind)
            if nth == 0:  # alone it bounds row groups
                rows = rows.filter(further | same)
        rows = rows.filter(behind)
    return rows.orderBy(*[F.desc(c) if descending else F.asc(c) for c, descending in order]).limit(size)


def page_count(df: DataFrame, size: int = 10) -> DataFrame:
    """Number of pages, at least one."""
    pages = F.ceil(F.count("*") / F.lit(size))
    return df.agg(F.greatest(pages, F.lit(1)).cast("bigint").alias("pages"))
