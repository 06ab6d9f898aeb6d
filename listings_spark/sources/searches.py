"""Search definitions and their stored registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listings_spark import constants as K
from listings_spark.functions import text as X


def effective_searches(
    searches: DataFrame,
    slug: str | None = None,
    max_pages: int | None = None,
    max_results: int | None = None,
    max_rechecks: int | None = None,
) -> DataFrame:
    """Enabled searches with overrides applied.

    Fails when a limit is out of its bounds or results exceed page capacity.
    """
    chosen = searches.filter("enabled")
    if slug:
        chosen = chosen.filter(F.col("slug") == slug.lower())
    pages = F.lit(max_pages) if max_pages else F.col("max_pages")
    results = F.lit(max_results) if max_results else F.least("max_results", pages * K.PAGE_SIZE)
    rechecks = F.lit(max_rechecks) if max_rechecks is not None else F.col("max_rechecks")
    limited = chosen.withColumns(
        {"_pages": pages, "_results": results, "_rechecks": rechecks}
    )

    def refused(reason: str) -> Column:
        text = F.concat(F.lit("search "), F.col("slug"), F.lit(f": {reason}"))
        return F.raise_error(text).cast("boolean")

    # In a filter, so that it holds whichever columns are read.
    within = (
        F.when(~F.col("_pages").between(1, K.MAX_PAGES), refused("page limit is out of bounds"))
        .when(~F.col("_results").between(1, K.MAX_RESULTS), refused("result limit is out of bounds"))
        .when(~F.col("_rechecks").between(0, K.MAX_RECHECKS), refused("recheck limit is out of bounds"))
        .when(
            F.col("_results") > F.col("_pages") * K.PAGE_SIZE,
            refused("effective result limit exceeds page capacity"),
        )
        .otherwise(F.lit(True))
    )
    return limited.filter(within).withColumns(
        {
            "max_pages": F.col("_pages").cast("int"),
            "max_results": F.col("_results").cast("int"),
            "max_rechecks": F.col("_rechecks").cast("int"),
        }
    ).drop("_pages", "_results", "_rechecks")


def company_list() -> Column:
    """Company names of a search as stored: cleaned, the first spelling of each name."""
    cleaned = F.transform(F.coalesce("company_names", F.array().cast("array<string>")), X.clean_text)
    keys = F.transform(cleaned, X.fold_key)
    return F.filter(cleaned, lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def search_violations(columns=()) -> Column:
    """Names of the bounds a search definition breaks.

    `columns` are those of the table; company lists, notes and the place id are optional.
    """

    def when(condition: Column, name: str) -> Column:
        return F.when(condition, F.lit(name))

    optional = []
    if "company_names" in columns:
        names = F.col("company_names")
        lengths = F.transform(names, lambda n: F.coalesce(F.length(X.clean_text(n)), F.lit(0)))
        optional += [
            when(F.size(names) > K.MAX_COMPANY_NAMES, "company_names.size"),
            when(F.exists(lengths, lambda n: ~n.between(1, K.MAX_COMPANY)), "company_names.length"),
        ]
    if "geo_id" in columns:
        optional.append(when(~F.col("geo_id").rlike("^[0-9]{1,30}$"), "geo_id.pattern"))
    if "notes" in columns:
        optional.append(when(F.length(X.clean_text(F.col("notes"))) > K.MAX_NOTES, "notes.length"))
    return F.array_compact(
        F.array(
            when(~F.col("slug").rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$"), "slug.pattern"),
            when(F.length("slug") > 100, "slug.length"),
            when((F.length("name") < 1) | (F.length("name") > 200), "name.length"),
            when((F.length("keywords") < 2) | (F.length("keywords") > 300), "keywords.length"),
            when((F.length("location") < 1) | (F.length("location") > 200), "location.length"),
            when(~F.col("date_posted").isin(*K.DATE_POSTED), "date_posted.value"),
            when(~F.col("workplace").isin(*K.WORKPLACES), "workplace.value"),
            when(~F.col("max_pages").between(1, K.MAX_PAGES), "max_pages.range"),
            when(~F.col("max_results").between(1, K.MAX_RESULTS), "max_results.range"),
            when(F.col("max_results") > F.col("max_pages") * K.PAGE_SIZE, "max_results.pages"),
            when(~F.col("max_rechecks").between(0, K.MAX_RECHECKS), "max_rechecks.range"),
            when(
                X.normalized_key(F.col("name")).isin("example", "example search"),
                "name.placeholder",
            ),
            *optional,
        )
    )


def case_fold(value: Column) -> Column:
    """Caseless form for identity comparison."""
    return F.lower(F.upper(value))


def query_identity(columns) -> Column:
    """Identity of the query a search makes; two searches may not share one."""
    parts = [
        case_fold(F.col("keywords")), case_fold(F.col("location")),
        F.coalesce(F.col("geo_id"), F.lit("")) if "geo_id" in columns else F.lit(""),
        F.col("workplace"), F.col("date_posted"),
    ]
    if "company_names" in columns:
        parts.append(
            F.array_join(F.array_sort(F.transform("company_names", X.fold_key)), ",")
        )
    return F.concat_ws("|", *parts)


def sync_searches(state: DataFrame, configured: DataFrame, now: Column) -> DataFrame:
    """Stored registry after a sync: new and changed searches overwritten, missing disabled.

    Every configured row is stamped, changed or not.
    """
    fields = ("name", "keywords", "location", "enabled", "config_hash")
    old, new = state.alias("o"), configured.alias("n")
    present = F.col("n.slug").isNotNull()
    merged = old.join(new, F.col("o.slug") == F.col("n.slug"), "full_outer")
    chosen = [
        F.when(present, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
        for c in fields if c != "enabled"
    ]
    return merged.select(
        F.coalesce("n.slug", "o.slug").alias("slug"), *chosen,
        (present & F.coalesce("n.enabled", F.lit(False))).alias("enabled"),
        now.alias("updated_at"),
    )
