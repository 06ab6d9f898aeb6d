"""Registered queries on pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from listings_spark import constants as K
from listings_spark.checks import sqltext as S
from listings_spark.checks.views import read, with_views
from listings_spark.functions import text as X
from listings_spark.functions import urls as U
from listings_spark.sources import pages as P
from listings_spark.sources.session import dealt
from listings_spark.sources.snapshots import table_digest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


IGNORED = ", ".join(f"'{p}'" for p in K.TRACKING_PARAMETERS)
HOST = r"regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)"
QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"


@check(
    "url_canonical",
    f"""WITH parts AS (SELECT page_id, url, {HOST} AS host, {PATH} AS path, list_sort(list_filter(
      string_split({QUERY}, '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_')
      AND lower(string_split(p, '=')[1]) NOT IN ({IGNORED}))) AS params FROM pages)
    SELECT page_id, CASE WHEN starts_with(url, 'https:') THEN u END AS canonical,
      CASE WHEN NOT starts_with(url, 'https:') THEN 'scheme' END AS reason, u AS as_https
    FROM (SELECT *, 'https://' || lower(host) || coalesce(nullif(rtrim(path, '/'), ''), '/')
      || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS u
      FROM parts)""",
)
def _(spark, sf):
    forced = F.regexp_replace("url", "^http:", "https:")
    df = read(spark, sf, "pages").select("page_id", "url")
    df = X.bind(df, c=U.canonicalize(F.col("url")), f=U.canonicalize(forced))
    return df.select(
        "page_id", F.col("c.url").alias("canonical"), F.col("c.reason").alias("reason"),
        F.col("f.url").alias("as_https"),
    )


@check(
    "url_public",
    f"SELECT page_id, {HOST} AS host, regexp_matches({HOST},"
    r" '^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$')"
    " AS public FROM pages",
)
def _(spark, sf):
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1)
    return read(spark, sf, "pages").select(
        "page_id", host.alias("host"), U.is_public_host(host).alias("public")
    )


BLOCKED = " OR ".join(f"contains(lower(html), '{m}')" for m in K.BLOCK_MARKERS)


@check("blocked_pages", f"SELECT page_id, {BLOCKED} AS blocked FROM pages")
def _(spark, sf):
    return read(spark, sf, "pages").select("page_id", P.is_blocked(F.col("html")).alias("blocked"))


@check("html_text", f"SELECT page_id, {S.html_text('html')} AS body FROM pages")
def _(spark, sf):
    return read(spark, sf, "pages").select(
        "page_id", X.html_to_text(F.col("html")).alias("body")
    )


@check("clean_text", f"SELECT doc_id, {S.clean('text')} AS cleaned FROM documents")
def _(spark, sf):
    return read(spark, sf, "documents").select(
        "doc_id", X.clean_text(F.col("text")).alias("cleaned")
    )


@check("normalized_key", f"SELECT doc_id, {S.key('text')} AS key FROM documents")
def _(spark, sf):
    return read(spark, sf, "documents").select(
        "doc_id", X.normalized_key(F.col("text")).alias("key")
    )


# Result pages: every order is one page and its line items are the cards on it.
CARD_SQL = {
    "urn": "CASE WHEN l_orderkey % 9 = 4 AND l_linenumber > 1 OR l_partkey % 31 = 0"
           " THEN 'urn:li:jobPosting:none' ELSE 'urn:li:jobPosting:'"
           " || CAST(l_partkey AS STRING) END",
    "title": "CASE WHEN l_partkey % 17 = 0 THEN ' ' ELSE 'R&amp;D <b>Intern</b>\n '"
             " || CAST(l_partkey % 10 AS STRING) END".replace("\n", " "),
    "company": "'Supplier ' || CAST(l_suppkey AS STRING)",
    "location": "CASE WHEN l_linenumber = 7 THEN '' ELSE 'Berlin, <i>Germany</i>' END",
}


def result_pages(spark, sf):
    item = (
        "'<li><div class=\"base-search-card\" data-entity-urn=\"' || urn || '\"><h3 class=\"x "
        "base-search-card__title\">' || title || '</h3><h4 class=\"base-search-card__subtitle\">"
        "<a>' || company || '</a></h4><img src=\"x\"><span class=\"job-search-card__location\">'"
        " || location || '</span></div></li>'"
    )
    cards = read(spark, sf, "lineitem").select(
        "l_orderkey",
        F.struct(
            "l_linenumber", "l_partkey", "l_suppkey",
            *[F.expr(sql).alias(name) for name, sql in CARD_SQL.items()],
        ).alias("c"),
    ).select("l_orderkey", "c.*")
    cards = cards.select(
        "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey",
                               F.expr(item).alias("item")).alias("c")
    )
    pages = cards.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    body = F.array_join(F.transform("cs", lambda c: c["item"]), "\n")
    html = F.concat(F.lit("<!doctype html><ul>"), body, F.lit("</ul>"))
    return pages.select("l_orderkey", html.alias("html"))


CARD_ROWS = f"""rows AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    {CARD_SQL['urn']} AS urn, {S.clean("regexp_replace(" + CARD_SQL['title']
                                       + ", '<[^>]*>', ' ', 'g')")} AS title,
    {CARD_SQL['company']} AS company, {S.clean("regexp_replace(" + CARD_SQL['location']
                                              + ", '<[^>]*>', ' ', 'g')")} AS location
  FROM lineitem),
judged AS (SELECT *, regexp_matches(urn, ':[0-9]+$') AND title <> '' AND location <> '' AS good,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)
    AS seq FROM rows),
gated AS (SELECT l_orderkey, count(*) FILTER (NOT good) AS malformed,
  count(*) FILTER (NOT good) * 2 > count(*) AS rejected FROM judged GROUP BY 1)"""


@check(
    "pages_extract",
    f"""WITH {CARD_ROWS} SELECT l_orderkey AS page_key,
      CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY seq) - 1 AS INTEGER) AS pos,
      CAST(l_partkey AS VARCHAR) AS listing_id, title, company, location,
      'https://www.linkedin.com/jobs/view/' || l_partkey AS link
    FROM judged JOIN gated USING (l_orderkey) WHERE good AND NOT rejected""",
)
def _(spark, sf):
    cards = P.explode_cards(P.search_cards(result_pages(spark, sf)))
    return cards.select(
        F.col("l_orderkey").alias("page_key"), "pos", "listing_id", "title", "company",
        "location", "link",
    )


@check(
    "page_gate",
    f"WITH {CARD_ROWS} SELECT l_orderkey AS page_key, malformed, CASE WHEN rejected THEN"
    " 'rejected' ELSE 'ok' END AS status FROM gated",
)
def _(spark, sf):
    return P.search_cards(result_pages(spark, sf)).select(
        F.col("l_orderkey").alias("page_key"), F.col("malformed").cast("bigint"), "status"
    )


# Detail pages: one per raw listing, with parts missing on some of them.
KEY = "CAST(listing_id AS BIGINT)"


def detail_pages(spark, sf):
    html = (
        f"concat('<!doctype html><section>', CASE WHEN {KEY} % 13 = 0 THEN '' ELSE concat('<h2"
        f" class=\"top-card-layout__title topcard__title\">', title, '</h2>') END,"
        f" '<div class=\"top-card-layout__second-subline\"><div class=\"topcard__flavor-row\">',"
        f" CASE WHEN {KEY} % 17 = 0 THEN '' ELSE concat('<a class=\"topcard__org-name-link\">',"
        f" company, '</a>') END, '<span class=\"topcard__flavor topcard__flavor--bullet\">',"
        f" replace(place, ';', ' /'), '</span></div><div class=\"topcard__flavor-row\"><span"
        f" class=\"topcard__flavor--bullet\">applicants</span></div></div></section>"
        f"<span class=\"posted-time-ago__text\">', age_text, '</span>',"
        f" coalesce(concat('<div class=\"show-more-less-html__markup\">', description, '</div>'),"
        f" ''), '<ul><li><h3>Seniority</h3><span class=\"c__criteria-text\">Entry</span></li>',"
        f" coalesce(concat('<li><h3>Industries</h3><span>', industries, '</span></li>'), ''),"
        f" '</ul>', CASE WHEN {KEY} % 7 = 0 THEN '<div role=\"alert\">No longer accepting <b>"
        f"applications</b></div>' WHEN {KEY} % 7 = 1 THEN '<p>No longer accepting applications"
        f"</p>' ELSE '' END)"
    )
    # Dealt out before the pages are made: rows are narrow here, and reading pages is the work.
    rows = dealt(read(spark, sf, "listing_raw").select(
        "listing_id", "observed_at", "title", "company", "place", "age_text", "description", "industries"
    ))
    return rows.select(
        "listing_id", "observed_at", F.expr(html).alias("html"),
        F.lit("Card title").alias("card_title"), F.lit("Card company").alias("card_company"),
        F.lit("Card place").alias("card_location"),
    )


@check(
    "detail_records",
    f"""SELECT listing_id,
      CASE WHEN {KEY} % 13 = 0 THEN 'Card title' ELSE {S.clean('title')} END AS title,
      CASE WHEN {KEY} % 17 = 0 THEN 'Card company' ELSE company END AS company,
      {S.clean("replace(place, ';', ' /')")} AS location,
      CASE WHEN description IS NOT NULL THEN {S.html_text("coalesce(description, '')")} END
        AS description,
      industries, {KEY} % 7 = 0 AS closed_notice FROM {{listing_raw}}""",
)
def _(spark, sf):
    return P.detail_records(detail_pages(spark, sf)).select(
        "listing_id", "title", "company", "location", "description", "industries",
        "closed_notice",
    )


@check(
    "page_identity",
    f"SELECT listing_id, {KEY} % 13 <> 0 AND {KEY} % 17 <> 0 AS identity_ok FROM"
    " {listing_raw}",
)
def _(spark, sf):
    return P.detail_records(detail_pages(spark, sf)).select("listing_id", "identity_ok")


PART = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "price")
ROW_TEXT = " || ',' || ".join(
    f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'N')" for c in PART
)


@check(
    "table_digest",
    "WITH hashed AS (SELECT sha256(" + ROW_TEXT + ") AS h FROM (SELECT *, CAST(p_retailprice AS"
    " DECIMAL(15, 2)) AS price FROM part)) SELECT count(*) AS row_count,"
    " CAST(sum(CAST('0x' || substr(h, 1, 16) AS UBIGINT)) AS VARCHAR) AS digest_high,"
    " CAST(sum(CAST('0x' || substr(h, 17, 16) AS UBIGINT)) AS VARCHAR) AS digest_low FROM hashed",
)
def _(spark, sf):
    # The price as a decimal, which both engines write alike.
    price = F.col("p_retailprice").cast("decimal(15,2)").alias("price")
    part = read(spark, sf, "part").select(*PART[:-1], price)
    return table_digest(part).select("row_count", "digest_high", "digest_low")
