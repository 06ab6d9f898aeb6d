"""One collection run as a single declarative plan: pages in, commit log and run rows out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listings_spark import constants as K
from listings_spark.functions import cascade as C
from listings_spark.functions import temporal as D
from listings_spark.functions import text as X
from listings_spark.operators import collect as G
from listings_spark.operators import quality as Q
from listings_spark.sources import pages as P
from listings_spark.sources.session import ensure_checkpoint_dir

PAIR = ["search_slug", "listing_id"]


@dataclass(frozen=True)
class CollectionRun:
    """Results of a run: commit log rows and one run row per search."""

    log: DataFrame
    runs: DataFrame


def _allowed(cards: DataFrame, searches: DataFrame, rules: dict) -> DataFrame:
    """Cards with `eligible`: the company is admitted and the title names the right kind."""
    terms = [
        rules.get("internship", K.PREFILTER_INTERNSHIP_TERMS),
        rules.get("new_grad", K.PREFILTER_NEW_GRAD_TERMS),
    ]
    allow = searches.select(
        F.col("slug").alias("search_slug"),
        F.transform("company_names", X.fold_key).alias("_allow"),
    )
    company = (F.size("_allow") == 0) | F.array_contains("_allow", X.fold_key(F.col("company")))
    return (
        cards.join(allow, "search_slug")
        .withColumn("eligible", company & X.title_allowed(F.col("title"), *terms))
        .drop("_allow")
    )


def _page_failures(
    extracted: DataFrame, read: DataFrame, searches: DataFrame
) -> DataFrame:
    """Searches that reach a block page or a page of mostly malformed cards."""
    bad = extracted.filter(F.col("status") != "ok").groupBy("search_slug").agg(
        F.min("page").alias("bad_page")
    )
    reached = read.groupBy("search_slug").agg(
        F.max("page").alias("last_page"), F.sum("new_eligible").alias("eligible_ids")
    )
    limits = searches.select(F.col("slug").alias("search_slug"), "max_pages", "max_results")
    return (
        bad.join(reached, "search_slug", "left")
        .join(limits, "search_slug")
        .filter(
            (F.col("bad_page") == F.coalesce("last_page", F.lit(-1)) + 1)
            & (F.coalesce("eligible_ids", F.lit(0)) < F.col("max_results"))
            & (F.col("bad_page") < F.col("max_pages"))
        )
        .select("search_slug", F.lit("invalid_html").alias("error_code"),
                F.lit("search page rejected").alias("error_message"))
    )


def _card_warnings(
    extracted: DataFrame, read: DataFrame, searches: DataFrame
) -> DataFrame:
    """Malformed cards on every parsed page: the pages read, and the one that ended reading."""
    reached = read.groupBy("search_slug").agg(
        F.max("page").alias("last_page"), F.sum("new_eligible").alias("eligible_ids")
    )
    limits = searches.select(F.col("slug").alias("search_slug"), "max_pages", "max_results")
    last = F.coalesce("last_page", F.lit(-1))
    stop = (
        (F.col("page") == last + 1)
        & (F.coalesce("eligible_ids", F.lit(0)) < F.col("max_results"))
        & (F.col("page") < F.col("max_pages"))
    )
    return (
        extracted.filter("status = 'ok'")
        .join(limits, "search_slug")
        .join(reached, "search_slug", "left")
        .filter((F.col("page") <= last) | stop)
        .groupBy("search_slug")
        .agg(F.sum("malformed").alias("card_warnings"))
    )


def collect_run(
    searches: DataFrame,
    result_pages: DataFrame,
    details: DataFrame,
    known: DataFrame,
    first_seq: int,
    run_prefix: str,
    observed_at: Column,
    target: int = K.TARGET_CYCLE,
    rules: dict | None = None,
) -> CollectionRun:
    """Evaluate all searches over already fetched documents.

    `searches` are effective searches with `company_names`; `result_pages` has
    (search_slug, page, html) with pages from 0; `details` has one (listing_id, html,
    http_status) per fetched listing; `known` comes from `known_listings`. Searches commit in
    slug order from `first_seq`. `rules` come from `phrases.rule_literals`; they decide both the
    title test of cards and the classification.
    """
    # Parsed pages, fetched records and decisions are each read several times below; they are
    # written once to the shared checkpoint folder instead of being computed again.
    ensure_checkpoint_dir(searches.sparkSession)
    extracted = (
        P.search_cards(result_pages.select("search_slug", "page", "html"))
        .drop("html")
        .checkpoint()
    )
    rules = rules or {}
    cards = _allowed(P.explode_cards(extracted), searches, rules)
    totals = G.page_totals(cards, F.col("eligible"))
    # At most ten pages per search; as stored rows their real size decides how Spark joins them.
    read = G.read_pages(totals, searches, first_page=0).checkpoint()
    found = G.first_cards(
        G.cards_on(cards, read).filter("eligible").select(
            *PAIR, "page", "pos", "title", "company", "location"
        )
    )
    selected = G.cap_per_search(found, searches)
    rechecks = G.absent_known(known, found, searches)
    wanted = selected.select(
        *PAIR, "title", "company", "location", F.lit("card").alias("origin")
    ).unionByName(
        rechecks.select(*PAIR, "title", "company", "location", F.lit("recheck").alias("origin"))
    )

    # Each detail page is parsed once, however many searches want it.
    needed = details.join(wanted.select("listing_id").distinct(), "listing_id", "left_semi")
    parsed = P.parse_details(
        needed.withColumn("html", F.when(F.col("http_status") == 200, F.col("html")))
    ).drop("html")
    fetched = P.complete_details(
        wanted.select(
            *PAIR, "origin", F.col("title").alias("card_title"),
            F.col("company").alias("card_company"), F.col("location").alias("card_location"),
        )
        .join(parsed, "listing_id", "left")
        .withColumn("observed_at", observed_at)
    )
    seen = known.select(*PAIR).distinct().withColumn("_known", F.lit(True))
    gone = F.col("http_status").isin(*K.GONE_STATUSES)
    known_here = F.coalesce("_known", F.lit(False))
    from_card = F.col("origin") == "card"
    fetched = fetched.withColumn(
        "locations",
        F.when(F.col("location") != "", F.array("location")).otherwise(
            F.array().cast("array<string>")
        ),
    )
    # A record that breaks any bound is a malformed detail, like a page without its fields.
    fetched = X.bind(fetched, _violations=Q.record_violations(with_start_date=True))
    judged = fetched.join(seen, PAIR, "left").withColumn(
        "evidence",
        F.when(gone & known_here, "confirmation")
        .when(gone, "warning")
        .when(F.coalesce(F.col("http_status") != 200, F.lit(True)), "search_failure")
        .when(F.col("problem").isNotNull() | (F.size("_violations") > 0), "malformed")
        .when(from_card & ~known_here & ~D.posting_is_eligible(F.col("posted_at")), "too_old")
        .otherwise("observed"),
    ).drop("age_text", "_known", "_violations").checkpoint()
    gate = G.batch_gate(judged.filter(from_card), F.col("evidence") == "malformed")
    broken = (
        judged.filter("evidence = 'search_failure'")
        .groupBy("search_slug")
        .agg(F.lit("http_error").alias("error_code"),
             F.lit("detail page could not be read").alias("error_message"))
        .unionByName(
            gate.filter("NOT passes").select(
                "search_slug", F.lit("invalid_html").alias("error_code"),
                F.lit("most detail pages were malformed").alias("error_message"),
            )
        )
        .unionByName(_page_failures(extracted, read, searches))
        .groupBy("search_slug")
        .agg(F.min("error_code").alias("error_code"), F.min("error_message").alias("error_message"))
    )

    decided = C.classify(
        judged.filter("evidence = 'observed'"), target=target, **rules
    )
    accepted_flag = (
        F.col("decision.include")
        & (F.length(F.array_join("geo.locations", "; ")).between(1, K.MAX_LOCATION))
    )
    decided = decided.withColumn("accepted", accepted_flag).drop("description").checkpoint()
    accepted = C.discovered(decided.filter("accepted"))

    order = searches.select(
        F.col("slug").alias("search_slug"),
        # One row per configured search: a small, bounded table.
        (F.row_number().over(Window.orderBy("slug")) + (first_seq - 1)).cast("bigint").alias(
            "run_seq"
        ),
    ).withColumn("run_id", F.concat(F.lit(run_prefix), F.lit("-"), F.col("run_seq")))
    healthy = order.join(broken.select("search_slug"), "search_slug", "left_anti")
    fields = ("company", "title", "location", "link", "category", "industries",
              "employment_type", "start_date")
    observed_rows = accepted.join(healthy, "search_slug").select(
        "run_seq", *PAIR, F.lit("observed").alias("kind"), "run_id", "observed_at",
        "posted_at", *fields,
    )
    missing_rows = (
        judged.filter("evidence = 'confirmation'")
        .join(healthy, "search_slug")
        .select(
            "run_seq", *PAIR, F.lit("unavailable").alias("kind"), "run_id", "observed_at",
            F.lit(None).cast("timestamp_ntz").alias("posted_at"),
            *[F.lit(None).cast("string").alias(c) for c in fields],
        )
    )

    counts = (
        found.groupBy("search_slug").agg(F.count("*").alias("found_count")),
        decided.groupBy("search_slug").agg(
            F.count_if("accepted").alias("accepted_count"),
            F.count_if(~F.col("accepted")).alias("excluded_count"),
        ),
        judged.groupBy("search_slug").agg(
            F.count_if(
                (F.col("evidence").isin("warning", "malformed", "too_old"))
                | ((F.col("evidence") == "confirmation") & from_card)
            ).alias("detail_warnings")
        ),
        _card_warnings(extracted, read, searches),
    )
    runs = order.join(broken, "search_slug", "left")
    for part in counts:
        runs = runs.join(part, "search_slug", "left")
    warnings = [F.coalesce(F.col(c), F.lit(0)) for c in ("detail_warnings", "card_warnings")]
    runs = runs.withColumn("warning_count", warnings[0] + warnings[1])
    failed = F.col("error_code").isNotNull()
    runs = runs.select(
        F.col("run_id").alias("id"), "run_seq", "search_slug",
        F.when(failed, "failed").otherwise("success").alias("status"),
        observed_at.alias("started_at"), observed_at.alias("finished_at"),
        F.lit(0).alias("duration_ms"),
        *[
            F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
            for c in ("found_count", "accepted_count", "excluded_count", "warning_count")
        ],
        "error_code", "error_message",
    )
    # A search yields each listing once, so the position inside a commit decides nothing here.
    log = observed_rows.unionByName(missing_rows).withColumn("pos", F.lit(0).cast("bigint"))
    return CollectionRun(log, runs)
