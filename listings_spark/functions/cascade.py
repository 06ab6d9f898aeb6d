"""The accept-or-reject rule cascade, one projection without joins or shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listings_spark import constants as K
from listings_spark.functions import arrays as A
from listings_spark.functions import geo as G
from listings_spark.functions import temporal as D
from listings_spark.functions import text as X


def employment_type(
    title_key: Column, internship=K.INTERNSHIP_PHRASES, new_grad=K.NEW_GRAD_PHRASES
) -> Column:
    """Internship phrases win over new-grad phrases; neither gives null."""
    return F.when(X.contains_any(title_key, internship), F.lit("internship")).when(
        X.contains_any(title_key, new_grad), F.lit("new-grad")
    )


def is_senior(title_key: Column, phrases=K.SENIORITY_PHRASES) -> Column:
    """Whether a title names an excluded seniority."""
    return X.contains_any(title_key, phrases)


def first_category(key: Column, categories=K.CATEGORY_PHRASES) -> Column:
    """First category in configured order with a phrase in the key, else null."""
    branches = None
    for name, phrases in categories.items():
        test = X.contains_any(key, phrases)
        branches = F.when(test, F.lit(name)) if branches is None else branches.when(
            test, F.lit(name)
        )
    return branches


def category_of(
    title_key: Column, body_key: Column | None = None, categories=K.CATEGORY_PHRASES
) -> Column:
    """Category of the title, then of the body, then the generic one, else "unknown"."""
    found = [first_category(title_key, categories)]
    whole = title_key
    if body_key is not None:
        found.append(first_category(body_key, categories))
        whole = F.concat_ws(" ", title_key, body_key)
    generic = F.when(X.contains_any(whole, K.OTHER_TECH_PHRASES), F.lit("other-tech"))
    return F.coalesce(*found, generic, F.lit("unknown"))


def fallback_allowed(title_key: Column) -> Column:
    """Whether the body may define the category of a title that names no field."""

    words = F.array_except(F.split(title_key, " "), X.string_array(K.TITLE_NOISE_WORDS))
    words = F.filter(words, lambda w: ~w.rlike("^[0-9]*$"))
    return F.size(F.array_except(words, X.string_array(K.FALLBACK_TITLE_WORDS))) == 0


def cycle_rejection(
    cycle: Column, posted_at: Column, target: int, minimum_posted_at: Column
) -> Column:
    """Reason a cycle is refused, null when it passes."""
    return (
        F.when(cycle == str(target), None)
        .when(cycle != "unknown", F.format_string(K.REASON_OTHER_CYCLE, cycle))
        .when(
            ~D.posting_is_eligible(posted_at, minimum_posted_at),
            F.lit(K.REASON_UNKNOWN_CYCLE % target),
        )
    )


def classify(
    listings: DataFrame,
    *,
    target: int = K.TARGET_CYCLE,
    minimum_posted_at: Column | None = None,
    internship=K.INTERNSHIP_PHRASES,
    new_grad=K.NEW_GRAD_PHRASES,
    seniority=K.SENIORITY_PHRASES,
    categories=K.CATEGORY_PHRASES,
) -> DataFrame:
    """Add `clean_title`, `geo` and `decision` to raw listings.

    Needs `title`, `description`, `locations` (array) and `posted_at`. `decision` is a struct
    (include, category, employment_type, exclusion_reason). The first failing check names
    the reason; the early checks leave category and type undecided.
    """
    minimum = D.policy_date() if minimum_posted_at is None else minimum_posted_at
    title = F.col("_title")
    keyed = X.bind(listings, clean_title=X.normalize_title(F.col("title")))
    keyed = X.bind(keyed, _title=X.normalized_key(F.col("clean_title")))
    keyed = keyed.withColumn("_type", employment_type(title, internship, new_grad))
    early = F.when(F.col("_type").isNull(), F.lit(K.REASON_NO_TYPE)).when(
        is_senior(title, seniority), F.lit(K.REASON_SENIORITY)
    )
    keyed = X.bind(
        keyed, _early=early, _title_category=F.when(early.isNull(), category_of(title, None, categories))
    )
    # The body is read only where no earlier check has decided, so rejected listings never
    # pay for markup removal or body scans.
    body_text = X.html_to_text(F.when(F.col("_early").isNull(), F.col("description")))
    keyed = X.bind(keyed, _text=body_text, geo=G.resolve_locations(F.col("locations")))
    keyed = X.bind(keyed, _body=X.normalized_key(F.col("_text")))
    category = F.when(
        (F.col("_title_category") == "unknown") & fallback_allowed(title),
        category_of(F.lit(""), F.col("_body"), categories),
    ).otherwise(F.col("_title_category"))
    keyed = X.bind(keyed, _category=category)
    undecided = F.coalesce(
        F.col("_early"), F.when(F.col("_category") == "unknown", F.lit(K.REASON_NO_ROLE))
    )
    cycle = D.resolve_cycle(title, F.col("_body"), F.col("_type"), target)
    keyed = X.bind(keyed, _early=undecided, _cycle=F.when(undecided.isNull(), cycle))
    late = F.coalesce(
        cycle_rejection(F.col("_cycle"), F.col("posted_at"), target, minimum),
        G.geo_rejection(F.col("geo")),
    )
    open_yet = F.col("_early").isNull()
    keyed = X.bind(keyed, _reason=F.coalesce(F.col("_early"), F.when(open_yet, late)))
    decision = F.struct(
        F.col("_reason").isNull().alias("include"),
        F.when(open_yet, F.col("_category")).otherwise(F.lit("unknown")).alias("category"),
        F.when(open_yet, F.col("_type")).alias("employment_type"),
        F.col("_reason").alias("exclusion_reason"),
    )
    return keyed.withColumn("decision", decision).drop(
        "_title", "_type", "_early", "_title_category", "_text", "_body", "_category",
        "_cycle", "_reason",
    )


def discovered(classified: DataFrame) -> DataFrame:
    """Accepted records in stored form, before lifecycle columns."""
    display = A.display_list(F.col("geo.locations"))
    return (
        classified.filter(F.col("decision.include"))
        .withColumn("_display", display)
        .filter(
            (F.col("_display") != "")
            & (F.length("_display") <= K.MAX_LOCATION)
            & (F.col("clean_title") != "")
        )
        .withColumn("title", F.col("clean_title"))
        .withColumn("location", F.col("_display"))
        .withColumn("category", F.col("decision.category"))
        .withColumn("employment_type", F.col("decision.employment_type"))
        .drop("clean_title", "geo", "decision", "_display", "locations", "description")
    )
