"""Directory read: one plan from stored listings to a page of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listings_spark.functions import urls as U
from listings_spark.operators import directory as V
from listings_spark.operators import ordering as O

SHOWN = (
    "listing_id", "company", "title", "location", "link", "category", "industries",
    "employment_type", "start_date", "first_seen_at",
)


def checked_links(listings: DataFrame) -> DataFrame:
    """Listings whose published link is the address of their own id; any other fails the read."""
    agrees = U.link_matches_identity(F.col("link"), F.col("listing_id")) & (
        F.col("link") == U.listing_link(F.col("listing_id"))
    )
    problem = F.concat(F.lit("invalid listing address: "), F.col("listing_id"))
    return listings.withColumn(
        "link", F.when(agrees, F.col("link")).otherwise(F.raise_error(problem))
    )


def directory(
    listings: DataFrame,
    *,
    sort: str = "first_seen_at",
    descending: bool = True,
    page: int = 0,
    size: int = 10,
    **filters,
) -> DataFrame:
    """One page of open listings after filters, in the chosen order."""
    rows = O.open_listings(listings).select(*SHOWN)
    rows = V.matches(rows, **filters)
    paged = O.result_page(rows, O.column_order(sort, descending), page, size)
    return checked_links(paged)
