"""Data-quality reports and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listings_spark import constants as K
from listings_spark.functions import arrays as A
from listings_spark.functions import text as X
from listings_spark.functions import urls as U


def _broken(condition: Column) -> Column:
    return F.count_if(~F.coalesce(condition, F.lit(False)))


def _report(table: DataFrame, name: str, rules: dict[str, Column]) -> DataFrame:
    """Rows (table, rule, violations) from one aggregation."""
    counts = table.agg(*[_broken(c).alias(rule) for rule, c in rules.items()])
    pairs = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("violations")) for rule in rules
    ])
    return counts.select(F.lit(name).alias("table"), F.explode(pairs).alias("p")).select(
        "table", "p.*"
    )


def run_rules() -> dict[str, Column]:
    """Constraints of the run log."""
    counts = ("duration_ms", "found_count", "accepted_count", "excluded_count", "warning_count")
    rules = {"run_status": F.col("status").isin(*K.RUN_STATUSES)}
    rules.update({f"{c}_nonnegative": F.col(c) >= 0 for c in counts})
    return rules


def listing_rules() -> dict[str, Column]:
    """Constraints of stored listings."""
    return {
        "employment_type": F.col("employment_type").isin(*K.EMPLOYMENT_TYPES),
        "listing_status": F.col("status").isin(*K.LISTING_STATUSES),
        "category": F.col("category").isin(*K.CATEGORIES),
        "seen_at_order": F.col("last_seen_at") >= F.col("first_seen_at"),
    }


def stored_listing_rules() -> dict[str, Column]:
    """The constraints that a published table of listings must meet; categories are free text there."""
    return {name: rule for name, rule in listing_rules().items() if name != "category"}


def provenance_rules() -> dict[str, Column]:
    """Constraints of search-to-listing links."""
    return {
        "confirmations_nonnegative": F.col("unavailable_confirmations") >= 0,
        "link_seen_at_order": F.col("last_seen_at") >= F.col("first_seen_at"),
    }


def constraint_report(listings: DataFrame, provenance: DataFrame, runs: DataFrame) -> DataFrame:
    """Violations of every table constraint, one pass per table."""
    return (
        _report(listings, "listings", listing_rules())
        .unionByName(_report(provenance, "provenance", provenance_rules()))
        .unionByName(_report(runs, "runs", run_rules()))
    )


def record_violations(with_start_date: bool = False) -> Column:
    """Names of the bounds a raw record breaks; texts and places are measured as cleaned."""

    def text_rule(name: str, longest: int) -> list[Column]:
        cleaned = X.clean_text(F.col(name))
        return [
            F.when(cleaned == "", F.lit(f"{name}.required")),
            F.when(F.length(cleaned) > longest, F.lit(f"{name}.length")),
        ]

    def optional_rule(name: str, longest: int) -> Column:
        return F.when(F.length(F.col(name)) > longest, F.lit(f"{name}.length"))

    start = [optional_rule("start_date", K.MAX_START_DATE)] if with_start_date else []

    numeric = F.col("listing_id").rlike(f"^[0-9]{{1,{K.MAX_ID_DIGITS}}}$")
    return F.array_compact(
        F.concat(F.array(
            F.when(~F.coalesce(numeric, F.lit(False)), F.lit("listing_id.pattern")),
            *text_rule("company", K.MAX_COMPANY),
            *text_rule("title", K.MAX_TITLE),
        ), A.list_violations(F.col("locations")), F.array(
            F.when(F.length("link") > K.MAX_URL, F.lit("link.length")),
            F.when(
                ~U.link_matches_identity(F.col("link"), F.col("listing_id")),
                F.lit("link.identity"),
            ),
            optional_rule("description", K.MAX_DESCRIPTION),
            F.when(
                F.length(X.clean_text(F.col("industries"))) > K.MAX_INDUSTRIES,
                F.lit("industries.length"),
            ),
            *start,
        ))
    )


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent."""
    keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def fk_report(
    listings: DataFrame, provenance: DataFrame, runs: DataFrame, searches: DataFrame
) -> DataFrame:
    """Orphan counts of all four references."""
    links = [
        ("runs.search_slug", runs, "search_slug", searches, "slug"),
        ("provenance.search_slug", provenance, "search_slug", searches, "slug"),
        ("provenance.listing_id", provenance, "listing_id", listings, "listing_id"),
        ("provenance.last_seen_run_id", provenance, "last_seen_run_id", runs, "id"),
    ]
    report = None
    for name, child, key, parent, parent_key in links:
        # Few distinct keys may carry most rows, so rows are counted per key before the join.
        counted = child.groupBy(key).agg(F.count("*").alias("_n"))
        row = orphans(counted, key, parent, parent_key).agg(
            F.lit(name).alias("reference"), F.coalesce(F.sum("_n"), F.lit(0)).alias("orphans")
        )
        report = row if report is None else report.unionByName(row)
    return report


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def reconcile(published: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows on one side only, duplicates counted; no rows means exact equality.

    One aggregation over both sides instead of two set differences.
    """
    columns = recomputed.columns
    both = recomputed.withColumn("_n", F.lit(1)).unionByName(
        published.select(*columns).withColumn("_n", F.lit(-1))
    )
    return (
        both.groupBy(*columns)
        .agg(F.sum("_n").alias("_n"))
        .filter(F.col("_n") != 0)
        .withColumn("side", F.when(F.col("_n") > 0, "missing").otherwise("unexpected"))
        .withColumn("n", F.abs("_n"))
        .drop("_n")
    )
