"""Directory reads: facets, filters, statistics, run roll-ups and search health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listings_spark import constants as K
from listings_spark.functions import arrays as A
from listings_spark.functions import text as X

SEARCHED = ("company", "title", "category", "industries", "employment_type", "location")


def facets(listings: DataFrame) -> DataFrame:
    """Distinct (facet, value) pairs in one scan; repeats are removed before the shuffle."""
    pairs = F.concat(
        F.array(
            F.struct(F.lit("company").alias("facet"), F.col("company").alias("value")),
            F.struct(F.lit("category").alias("facet"), F.col("category").alias("value")),
        ),
        F.transform(
            A.countries(F.col("location")),
            lambda c: F.struct(F.lit("country").alias("facet"), c.alias("value")),
        ),
    )
    found = listings.select(F.explode(pairs).alias("pair")).select("pair.*").distinct()
    fixed = listings.sparkSession.createDataFrame(
        [("employment_type", t) for t in K.EMPLOYMENT_TYPES], "facet string, value string"
    )
    return found.unionByName(fixed)


def matches(
    listings: DataFrame,
    *,
    query: str = "",
    company: str | None = None,
    country: str | None = None,
    category: str | None = None,
    employment_type: str | None = None,
) -> DataFrame:
    """Filtered listings; a requested value that no listing has is ignored.

    One job asks for all requested values at once and returns one row; the filters are then plain
    and reach the scan.
    """
    tests: list[Column] = []
    if query.strip():
        tests.append(X.text_search([F.col(c) for c in SEARCHED], query))
    if employment_type in K.EMPLOYMENT_TYPES:
        tests.append(F.col("employment_type") == employment_type)
    wanted = {}
    if company:
        wanted["company"] = F.col("company") == company
    if country:
        wanted["country"] = F.array_contains(A.countries(F.col("location")), country)
    if category:
        wanted["category"] = F.col("category") == category
    if wanted:
        offered = listings.agg(*[F.bool_or(test).alias(name) for name, test in wanted.items()]).first()
        tests += [test for name, test in wanted.items() if offered[name]]
    out = listings
    for test in tests:
        out = out.filter(test)
    return out


def type_counts(listings: DataFrame) -> DataFrame:
    """Listings per employment type, zero where a type has none."""
    counted = listings.groupBy("employment_type").agg(F.count("*").alias("n"))
    types = listings.sparkSession.createDataFrame(
        [(t,) for t in K.EMPLOYMENT_TYPES], "employment_type string"
    )
    return types.join(counted, "employment_type", "left").select(
        "employment_type", F.coalesce("n", F.lit(0)).alias("n")
    )


def last_success(runs: DataFrame) -> DataFrame:
    """Time of the last successful run; a later failure does not make data look fresher."""
    return runs.filter(F.col("status") == "success").agg(
        F.max("finished_at").alias("last_success_at")
    )


def state_stats(listings: DataFrame, runs: DataFrame, searches: DataFrame) -> DataFrame:
    """One row of state statistics, one aggregation per table."""
    ran = runs.agg(
        F.struct(
            F.count_if(F.col("status") == "success").alias("ok"),
            F.count_if(F.col("status") == "failed").alias("failed"),
            F.max(F.when(F.col("status") == "success", F.col("finished_at"))).alias("last"),
        )
    ).scalar()
    enabled = searches.agg(F.count_if(F.col("enabled"))).scalar()
    return (
        listings.agg(
            F.count("*").alias("total"), F.count_if(F.col("status") == "open").alias("open")
        )
        .withColumn("closed", F.col("total") - F.col("open"))
        .withColumn("configured_searches", enabled)
        .withColumn("_ran", ran)
        .select(
            "total", "open", "closed", "configured_searches",
            F.col("_ran.ok").alias("successful_runs"),
            F.col("_ran.failed").alias("failed_runs"),
            F.col("_ran.last").alias("last_success_at"),
        )
    )


def run_rollup(runs: DataFrame, counters: DataFrame, batch: Column) -> DataFrame:
    """Sums and status per batch of runs; only successful runs contribute counts."""
    ok = F.col("status") == "success"

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(ok, F.col(name))), F.lit(0)).alias(name)

    changes = ("new_count", "updated_count", "closed_count", "reopened_count")
    return (
        runs.join(counters.select("run_seq", *changes), "run_seq", "left")
        .groupBy(batch.alias("batch"))
        .agg(
            F.count_if(ok).alias("successful_searches"),
            F.count_if(~ok).alias("failed_searches"),
            *[total(c) for c in ("found_count", "accepted_count", "excluded_count",
                                 "warning_count", *changes)],
        )
        .withColumn(
            "status",
            F.when(F.col("successful_searches") == 0, "failed")
            .when(F.col("failed_searches") > 0, "partial")
            .otherwise("success"),
        )
    )


def search_health(runs: DataFrame, searches: DataFrame) -> DataFrame:
    """Latest run of each enabled search; searches that never ran drop out."""
    shown = ("status", "finished_at", "found_count", "accepted_count", "excluded_count",
             "error_code")
    latest = runs.groupBy("search_slug").agg(
        F.max_by(F.struct(*shown), F.struct("finished_at", "id")).alias("run")
    )
    enabled = searches.filter("enabled").select("slug")
    return enabled.join(latest, enabled["slug"] == latest["search_slug"]).select("slug", "run.*")


def registry_health(searches: DataFrame, health: DataFrame) -> DataFrame:
    """Every configured search with its limits and last outcome."""
    limits = F.concat_ws("/", "max_pages", "max_results", "max_rechecks")
    outcome = F.concat_ws("/", "found_count", "accepted_count")
    state = health.select("slug", "status", "found_count", "accepted_count")
    return searches.join(state, "slug", "left").select(
        "slug", F.col("location").alias("scope"),
        F.when(F.col("enabled"), "yes").otherwise("no").alias("enabled"),
        limits.alias("limits"),
        F.coalesce("status", F.lit("never-run")).alias("last"),
        F.when(F.col("status").isNotNull(), outcome).otherwise("-/-").alias("found_accepted"),
    )
