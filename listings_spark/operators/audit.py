"""Full-state availability audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listings_spark import constants as K


def outcomes(checks: DataFrame) -> DataFrame:
    """Outcome per listing from (public_status, closed_notice, detail_status, identity_ok).

    A gone page or an explicit closure notice proves unavailability; availability needs both
    pages and a recognisable identity; everything else proves nothing.
    """
    public_gone = F.col("public_status").isin(*K.GONE_STATUSES)
    detail_gone = F.col("detail_status").isin(*K.GONE_STATUSES)
    public_ok = F.col("public_status") == 200
    outcome = (
        F.when(public_gone, "unavailable")
        .when(~public_ok, "inconclusive")
        .when(F.col("closed_notice"), "unavailable")
        .when(detail_gone, "unavailable")
        .when((F.col("detail_status") == 200) & F.col("identity_ok"), "available")
        .otherwise("inconclusive")
    )
    return checks.withColumn("outcome", F.coalesce(outcome, F.lit("inconclusive")))


def conflicts(available: DataFrame, unavailable: DataFrame) -> DataFrame:
    """Ids reported both available and unavailable; an audit with any must not be applied."""
    return available.select("listing_id").intersect(unavailable.select("listing_id"))


def apply_audit(
    listings: DataFrame, provenance: DataFrame, audited: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """State after an audit; `audited` is (listing_id, outcome, observed_at), one row per id.

    Available listings reopen and all their links are reset; unavailable listings go together
    with their links; run history stays.
    """
    found = audited.select("listing_id", "outcome", F.col("observed_at").alias("_checked"))
    gone = found.filter(F.col("outcome") == "unavailable").select("listing_id")
    good = found.filter(F.col("outcome") == "available").select("listing_id", "_checked")
    joined = listings.join(gone, "listing_id", "left_anti").join(good, "listing_id", "left")
    checked = F.col("_checked").isNotNull()
    effective = F.greatest("last_seen_at", "_checked")
    reopened = checked & (F.col("status") == "closed")
    kept = joined.select(
        *[F.col(c) for c in listings.columns if c not in ("last_seen_at", "updated_at", "status")],
        F.when(checked, effective).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(reopened, F.greatest("updated_at", effective))
        .otherwise(F.col("updated_at"))
        .alias("updated_at"),
        F.when(checked, "open").otherwise(F.col("status")).alias("status"),
    ).select(*listings.columns)
    links = provenance.join(gone, "listing_id", "left_anti").join(good, "listing_id", "left")
    reset = links.select(
        *[F.col(c) for c in provenance.columns
          if c not in ("unavailable_confirmations", "active")],
        F.when(checked, 0).otherwise(F.col("unavailable_confirmations")).alias(
            "unavailable_confirmations"
        ),
        (checked | F.col("active")).alias("active"),
    ).select(*provenance.columns)
    return kept, reset


def summary(listings: DataFrame, audited: DataFrame) -> DataFrame:
    """One row: checked, available, deleted, reopened and inconclusive listings."""
    rows = audited.join(listings.select("listing_id", "status"), "listing_id", "left")
    stored = F.col("status").isNotNull()
    return rows.agg(
        F.count("*").alias("checked"),
        F.count_if(F.col("outcome") == "available").alias("available"),
        F.count_if((F.col("outcome") == "unavailable") & stored).alias("deleted"),
        F.count_if((F.col("outcome") == "available") & (F.col("status") == "closed")).alias(
            "reopened"
        ),
        F.count_if(F.col("outcome") == "inconclusive").alias("inconclusive"),
    )


def inconclusive_ids(audited: DataFrame) -> DataFrame:
    """Ids the audit could not decide, in id order."""
    return (
        audited.filter(F.col("outcome") == "inconclusive").select("listing_id").orderBy("listing_id")
    )
