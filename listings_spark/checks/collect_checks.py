"""Registered queries on search-result cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from listings_spark.checks import sqltext as S
from listings_spark.checks.views import read, with_views
from listings_spark.functions import text as X
from listings_spark.operators import collect as G

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def cards(spark, sf):
    return read(spark, sf, "cards")


def eligible():
    return X.title_allowed(F.col("title"))


ELIGIBLE = S.any_phrase(
    S.key("title"), (*S.K.PREFILTER_INTERNSHIP_TERMS, *S.K.PREFILTER_NEW_GRAD_TERMS)
)


@check(
    "dedup_first",
    "SELECT search_slug, listing_id, page, pos, title FROM (SELECT *, row_number() OVER ("
    "PARTITION BY search_slug, listing_id ORDER BY page, pos) AS rn FROM {cards}) WHERE rn = 1",
)
def _(spark, sf):
    return G.first_cards(
        cards(spark, sf).select("search_slug", "listing_id", "page", "pos", "title")
    )


@check(
    "dedup_last",
    "SELECT search_slug, listing_id, pos, title, l_quantity FROM (SELECT *, row_number() OVER ("
    "PARTITION BY search_slug, listing_id ORDER BY pos DESC) AS rn FROM {cards}) WHERE rn = 1",
)
def _(spark, sf):
    return G.last_records(
        cards(spark, sf).select("search_slug", "listing_id", "pos", "title", "l_quantity")
    )


TOTALS = f"""ids AS (SELECT search_slug, listing_id, min(page) AS first_page,
  min(CASE WHEN {ELIGIBLE} THEN page END) AS first_eligible FROM {{cards}} GROUP BY ALL),
sizes AS (SELECT search_slug, page, count(*) AS cards FROM {{cards}} GROUP BY ALL),
news AS (SELECT search_slug, first_page AS page, count(*) AS n FROM ids GROUP BY ALL),
oks AS (SELECT search_slug, first_eligible AS page, count(*) AS n FROM ids
  WHERE first_eligible IS NOT NULL GROUP BY ALL),
totals AS (SELECT s.*, coalesce(n.n, 0) AS new_ids, coalesce(o.n, 0) AS new_eligible
  FROM sizes s LEFT JOIN news n USING (search_slug, page) LEFT JOIN oks o
  USING (search_slug, page)),
stops AS (SELECT search_slug, min(page) AS stop FROM totals WHERE new_ids = 0 GROUP BY 1),
before_stop AS (SELECT t.*, coalesce(sum(new_eligible) OVER (PARTITION BY t.search_slug
    ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS eligible_before
  FROM totals t LEFT JOIN stops s USING (search_slug) WHERE stop IS NULL OR page < stop)"""


@check(
    "page_cutoff",
    f"WITH {TOTALS} SELECT search_slug, page, cards, new_ids, new_eligible FROM before_stop",
)
def _(spark, sf):
    return G.until_repeated(G.page_totals(cards(spark, sf), eligible()))


@check(
    "quota_pages",
    f"WITH {TOTALS} SELECT search_slug, page, cards, new_ids, new_eligible,"
    " CAST(eligible_before AS BIGINT) AS eligible_before FROM before_stop JOIN {registry} r"
    " ON search_slug = r.slug WHERE eligible_before < max_results AND page <= max_pages",
)
def _(spark, sf):
    totals = G.page_totals(cards(spark, sf), eligible())
    return G.read_pages(totals, read(spark, sf, "registry"))


@check(
    "cap_per_search",
    "SELECT search_slug, listing_id, page, pos, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER ("
    "PARTITION BY search_slug ORDER BY page, pos) AS rank FROM (SELECT search_slug, listing_id,"
    " page, pos FROM (SELECT *, row_number() OVER (PARTITION BY search_slug, listing_id"
    f" ORDER BY page, pos) AS rn FROM {{cards}} WHERE {ELIGIBLE}) WHERE rn = 1)) JOIN"
    " {registry} r ON search_slug = r.slug WHERE rank <= max_results",
)
def _(spark, sf):
    first = G.first_cards(
        cards(spark, sf).filter(eligible()).select("search_slug", "listing_id", "page", "pos")
    )
    return G.cap_per_search(first, read(spark, sf, "registry"))


def known(spark, sf):
    return cards(spark, sf).filter("l_quantity > 20").select("search_slug", "listing_id").distinct()


def current(spark, sf):
    return cards(spark, sf).filter("l_quantity <= 20").select("search_slug", "listing_id")


@check(
    "absent_known",
    "WITH known AS (SELECT DISTINCT search_slug, listing_id FROM {cards} WHERE l_quantity > 20),"
    " cur AS (SELECT DISTINCT search_slug, listing_id FROM {cards} WHERE l_quantity <= 20),"
    " absent AS (SELECT k.* FROM known k ANTI JOIN cur USING (search_slug, listing_id))"
    " SELECT search_slug, listing_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER ("
    "PARTITION BY search_slug ORDER BY listing_id) AS rank FROM absent) JOIN {registry} r"
    " ON search_slug = r.slug WHERE rank <= max_rechecks",
)
def _(spark, sf):
    return G.absent_known(known(spark, sf), current(spark, sf), read(spark, sf, "registry"))


@check(
    "distinct_details",
    "SELECT listing_id, count(DISTINCT search_slug) AS searches FROM {cards} GROUP BY 1",
)
def _(spark, sf):
    return G.distinct_details(cards(spark, sf))


GATE = (
    "gate AS (SELECT search_slug, count(*) AS details, count(*) FILTER (bad) AS malformed,"
    " count(*) FILTER (bad) * 2 <= count(*) AS passes FROM (SELECT search_slug,"
    " l_quantity > 20 + 2 * page AND search_slug <> 's4' OR search_slug = 's3' AS bad"
    " FROM {cards}) GROUP BY 1)"
)


@check("batch_gate", f"WITH {GATE} SELECT * FROM gate")
def _(spark, sf):
    bad = F.expr("l_quantity > 20 + 2 * page AND search_slug <> 's4' OR search_slug = 's3'")
    return G.batch_gate(cards(spark, sf), bad)


@check(
    "passing_details",
    f"WITH {GATE} SELECT search_slug, count(*) AS n FROM {{cards}} JOIN gate USING (search_slug)"
    " WHERE passes GROUP BY 1",
)
def _(spark, sf):
    bad = F.expr("l_quantity > 20 + 2 * page AND search_slug <> 's4' OR search_slug = 's3'")
    rows = cards(spark, sf)
    return G.passing(rows, G.batch_gate(rows, bad)).groupBy("search_slug").agg(
        F.count("*").alias("n")
    )


@check(
    "positions_union",
    "SELECT search_slug, listing_id, origin, count(*) AS n FROM (SELECT search_slug, listing_id,"
    " 'card' AS origin FROM {cards} WHERE l_quantity <= 20 UNION ALL SELECT DISTINCT"
    " search_slug, listing_id, 'recheck' FROM {cards} WHERE l_quantity > 20) GROUP BY ALL",
)
def _(spark, sf):
    return G.positions(current(spark, sf), known(spark, sf)).groupBy(
        "search_slug", "listing_id", "origin"
    ).agg(F.count("*").alias("n"))


FETCH = (
    "CASE WHEN l_orderkey % 10 = 0 THEN 404 WHEN l_orderkey % 10 = 1 THEN 410"
    " WHEN l_orderkey % 97 = 2 THEN 503 ELSE 200 END"
)


@check(
    "run_evidence",
    "WITH known AS (SELECT DISTINCT search_slug, listing_id, true AS k FROM {cards}"
    f" WHERE l_quantity > 20), f AS (SELECT search_slug, listing_id, pos, {FETCH} AS st,"
    " l_orderkey % 11 = 3 AS bad FROM {cards})"
    " SELECT search_slug, listing_id, pos, CASE WHEN st IN (404, 410) AND k THEN 'confirmation'"
    " WHEN st IN (404, 410) THEN 'warning' WHEN st <> 200 THEN 'search_failure'"
    " WHEN bad THEN 'malformed' ELSE 'observed' END AS evidence"
    " FROM f LEFT JOIN known USING (search_slug, listing_id)",
)
def _(spark, sf):
    fetches = cards(spark, sf).select(
        "search_slug", "listing_id", "pos", F.expr(FETCH).alias("http_status"),
        (F.col("l_orderkey") % 11 == 3).alias("malformed"),
    )
    return G.run_evidence(fetches, known(spark, sf)).drop("http_status", "malformed")
