"""From search-result cards to records: dedup, quotas, admission and evidence.

A search may hold a large share of all cards. Cards are reduced per (search, listing) with
map-side aggregation first; what is ordered per search afterwards is either page totals (at
most ten rows a search) or a top-k with a constant bound, which every task applies to its own
rows before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listings_spark import constants as K
from listings_spark.functions import temporal as D
from listings_spark.functions import text as X

PAIR = ["search_slug", "listing_id"]


def _pick(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in (*keys, *order)]
    chosen = df.groupBy(*keys).agg(pick(F.struct(*order, *rest)).alias("_row"))
    return chosen.select(*keys, "_row.*")


def first_cards(cards: DataFrame) -> DataFrame:
    """First card of each listing in a search, in arrival order."""
    return _pick(cards, PAIR, ["page", "pos"], F.min)


def last_records(records: DataFrame, position: str = "pos") -> DataFrame:
    """Last record of each listing in one outcome."""
    return _pick(records, PAIR, [position], F.max)


def page_totals(cards: DataFrame, eligible: Column) -> DataFrame:
    """Cards, new ids and newly eligible ids of every result page."""
    sizes = cards.groupBy("search_slug", "page").agg(F.count("*").alias("cards"))
    firsts = cards.groupBy(*PAIR).agg(
        F.min("page").alias("first_page"),
        F.min(F.when(eligible, F.col("page"))).alias("first_eligible"),
    )
    marks = F.array(
        F.struct(F.col("first_page").alias("page"), F.lit(1).alias("new"), F.lit(0).alias("ok")),
        F.struct(
            F.col("first_eligible").alias("page"), F.lit(0).alias("new"), F.lit(1).alias("ok")
        ),
    )
    counted = (
        firsts.select("search_slug", F.explode(marks).alias("m"))
        .filter(F.col("m.page").isNotNull())
        .groupBy("search_slug", F.col("m.page").alias("page"))
        .agg(F.sum("m.new").alias("new_ids"), F.sum("m.ok").alias("new_eligible"))
    )
    return sizes.join(counted, ["search_slug", "page"], "left").select(
        "search_slug", "page", "cards",
        F.coalesce("new_ids", F.lit(0)).alias("new_ids"),
        F.coalesce("new_eligible", F.lit(0)).alias("new_eligible"),
    )


def read_pages(totals: DataFrame, searches: DataFrame, first_page: int = 1) -> DataFrame:
    """Pages a search really reads.

    Reading ends before the first empty or fully repeated page, after the page that fills the
    quota of eligible ids, and at the page limit.
    """
    by_page = Window.partitionBy("search_slug").orderBy("page")
    so_far = by_page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = by_page.rowsBetween(Window.unboundedPreceding, -1)
    limits = searches.select(
        F.col("slug").alias("search_slug"), "max_pages", "max_results"
    )
    return (
        totals.withColumn("_gap", F.col("page") - first_page + 1 - F.row_number().over(by_page))
        .withColumn("_fewest", F.min("new_ids").over(so_far))
        .withColumn("eligible_before", F.coalesce(F.sum("new_eligible").over(earlier), F.lit(0)))
        .join(limits, "search_slug")
        .filter(
            (F.col("_gap") == 0)
            & (F.col("_fewest") > 0)
            & (F.col("eligible_before") < F.col("max_results"))
            & (F.col("page") < first_page + F.col("max_pages"))
        )
        .select("search_slug", "page", "cards", "new_ids", "new_eligible", "eligible_before")
    )


def until_repeated(totals: DataFrame, first_page: int = 1) -> DataFrame:
    """Pages before the first empty or fully repeated one."""
    by_page = Window.partitionBy("search_slug").orderBy("page")
    so_far = by_page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        totals.withColumn("_gap", F.col("page") - first_page + 1 - F.row_number().over(by_page))
        .withColumn("_fewest", F.min("new_ids").over(so_far))
        .filter((F.col("_gap") == 0) & (F.col("_fewest") > 0))
        .drop("_gap", "_fewest")
    )


def cards_on(cards: DataFrame, pages: DataFrame) -> DataFrame:
    """Cards on the pages that are read."""
    return cards.join(pages.select("search_slug", "page"), ["search_slug", "page"], "left_semi")


def _limits(searches: DataFrame, name: str, most: int) -> DataFrame:
    """(search_slug, limit) of searches; a limit beyond the bound fails instead of cutting rows."""
    refused = F.concat(F.lit("search "), F.col("slug"), F.lit(f": {name} is over {most}"))
    within = F.when(F.col(name) > most, F.raise_error(refused).cast("boolean")).otherwise(F.lit(True))
    return searches.filter(within).select(F.col("slug").alias("search_slug"), name)


def cap_per_search(first: DataFrame, searches: DataFrame) -> DataFrame:
    """First `max_results` cards of each search.

    A search that allows more than MAX_RESULTS fails the query. The constant bound in front of
    the join lets every task cut its own rows first.
    """
    arrival = Window.partitionBy("search_slug").orderBy("page", "pos", "listing_id")
    limits = _limits(searches, "max_results", K.MAX_RESULTS)
    return (
        first.withColumn("rank", F.row_number().over(arrival))
        .filter(F.col("rank") <= K.MAX_RESULTS)
        .join(limits, "search_slug")
        .filter(F.col("rank") <= F.col("max_results"))
        .drop("max_results")
    )


def absent_known(known: DataFrame, collected: DataFrame, searches: DataFrame) -> DataFrame:
    """Known listings missing from the current cards, smallest ids first, bounded per search.

    A search that allows more than MAX_RECHECKS fails the query.
    """
    absent = known.join(collected.select(*PAIR), PAIR, "left_anti")
    by_id = Window.partitionBy("search_slug").orderBy("listing_id")
    limits = _limits(searches, "max_rechecks", K.MAX_RECHECKS)
    return (
        absent.withColumn("rank", F.row_number().over(by_id))
        .filter(F.col("rank") <= K.MAX_RECHECKS)
        .join(limits, "search_slug")
        .filter(F.col("rank") <= F.col("max_rechecks"))
        .drop("max_rechecks")
    )


def distinct_details(cards: DataFrame) -> DataFrame:
    """Each detail document once, however many searches ask for it."""
    return cards.groupBy("listing_id").agg(
        F.count_distinct("search_slug").alias("searches")
    )


def allowed_companies(cards: DataFrame, searches: DataFrame) -> DataFrame:
    """Cards of searches without an allowlist, and cards whose company is on it."""
    allow = searches.select(
        F.col("slug").alias("search_slug"),
        F.transform("company_names", X.fold_key).alias("_allowed"),
    )
    return (
        cards.join(allow, "search_slug")
        .filter(
            (F.size("_allowed") == 0)
            | F.array_contains("_allowed", X.normalized_key(F.col("company")))
        )
        .drop("_allowed")
    )


def admit(details: DataFrame, known: DataFrame) -> DataFrame:
    """New listings need an eligible posting date; known listings need none."""
    seen = known.select(*PAIR).distinct().withColumn("is_known", F.lit(True))
    return (
        details.join(seen, PAIR, "left")
        .withColumn("is_known", F.coalesce("is_known", F.lit(False)))
        .filter(F.col("is_known") | D.posting_is_eligible(F.col("posted_at")))
    )


def batch_gate(details: DataFrame, malformed: Column) -> DataFrame:
    """Searches with their share of malformed details and whether they may be persisted."""
    return (
        details.groupBy("search_slug")
        .agg(F.count("*").alias("details"), F.count_if(malformed).alias("malformed"))
        .withColumn("passes", F.col("malformed") * 2 <= F.col("details"))
    )


def passing(details: DataFrame, gate: DataFrame) -> DataFrame:
    """Details of searches that pass the gate."""
    failed = gate.filter(~F.col("passes")).select("search_slug")
    return details.join(failed, "search_slug", "left_anti")


def positions(observed: DataFrame, rechecked: DataFrame) -> DataFrame:
    """Observed and rechecked positions in one table."""
    return observed.withColumn("origin", F.lit("card")).unionByName(
        rechecked.withColumn("origin", F.lit("recheck"))
    )


def run_evidence(fetches: DataFrame, known: DataFrame) -> DataFrame:
    """What each detail fetch proves: listing_id, search_slug, http_status, malformed given.

    Gone pages confirm unavailability for known listings only; other errors fail the search;
    malformed pages never count.
    """
    seen = known.select(*PAIR).distinct().withColumn("_known", F.lit(True))
    gone = F.col("http_status").isin(*K.GONE_STATUSES)
    return fetches.join(seen, PAIR, "left").withColumn(
        "evidence",
        F.when(gone & F.coalesce("_known", F.lit(False)), "confirmation")
        .when(gone, "warning")
        .when(F.col("http_status") != 200, "search_failure")
        .when(F.col("malformed"), "malformed")
        .otherwise("observed"),
    ).drop("_known")
