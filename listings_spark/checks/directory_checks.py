"""Registered queries on stored listings: orders, facets, filters, pages, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from listings_spark import constants as K
from listings_spark.checks import sqltext as S
from listings_spark.checks.listing_checks import classified, raw, with_places
from listings_spark.checks.views import read, with_views
from listings_spark.functions import arrays as A
from listings_spark.functions import temporal as D
from listings_spark.functions import text as X
from listings_spark.operators import directory as V
from listings_spark.operators import ordering as O
from listings_spark.operators import quality as Q
from listings_spark.operators import runs as N

QUERIES: dict = {}
UPPER = O.ASCII_UPPER
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def stored(spark, sf):
    return read(spark, sf, "stored")


OPEN = "FROM {stored} WHERE status = 'open'"


@check("all_listings", "SELECT *, row_number() OVER (ORDER BY listing_id) AS rank FROM {stored}")
def _(spark, sf):
    return O.with_rank(stored(spark, sf), [F.col("listing_id").asc()])


@check(
    "publication_order",
    "SELECT listing_id, company, title, location, row_number() OVER (ORDER BY translate(company,"
    f" '{UPPER}', '{UPPER.lower()}'), translate(title, '{UPPER}', '{UPPER.lower()}'), location, listing_id) AS rank {OPEN}",
)
def _(spark, sf):
    rows = O.open_listings(stored(spark, sf)).select("listing_id", "company", "title", "location")
    return O.with_rank(rows, O.publication_order())


DIRECTORY = ("listing_id", "company", "title", "location", "link", "category", "industries",
             "employment_type", "start_date", "first_seen_at")


@check(
    "directory_order",
    f"SELECT {', '.join(DIRECTORY)}, row_number() OVER (ORDER BY first_seen_at DESC,"
    f" listing_id DESC) AS rank {OPEN}",
)
def _(spark, sf):
    rows = O.open_listings(stored(spark, sf)).select(*DIRECTORY)
    return O.with_rank(rows, O.directory_order())


@check(
    "latest_per_type",
    "SELECT employment_type, listing_id, company, first_seen_at, CAST(rank AS INTEGER) AS rank FROM (SELECT *,"
    " row_number() OVER (PARTITION BY employment_type ORDER BY first_seen_at DESC,"
    f" listing_id DESC) AS rank {OPEN}) WHERE rank <= {K.PREVIEW_LIMIT}",
)
def _(spark, sf):
    return O.latest_per_type(stored(spark, sf)).select(
        "employment_type", "listing_id", "company", "first_seen_at", "rank"
    )


@check(
    "resort",
    "SELECT listing_id, title, row_number() OVER (ORDER BY title DESC, listing_id DESC)"
    f" AS rank {OPEN}",
)
def _(spark, sf):
    rows = O.open_listings(stored(spark, sf)).select("listing_id", "title")
    return O.with_rank(rows, O.column_order("title", descending=True))


@check(
    "type_counts",
    "SELECT t.employment_type, count(s.listing_id) AS n FROM (VALUES ('internship'),"
    " ('new-grad')) AS t(employment_type) LEFT JOIN (SELECT * FROM {stored}"
    " WHERE status = 'open') s USING (employment_type) GROUP BY 1",
)
def _(spark, sf):
    return V.type_counts(O.open_listings(stored(spark, sf)))


STORED_COUNTRIES = """p AS (SELECT listing_id, unnest(string_split(location, ';')) AS raw
  FROM {stored} WHERE status = 'open'),
c AS (SELECT listing_id, coalesce(nullif(trim(string_split(raw, ',')[-1]), ''), trim(raw))
  AS country FROM p)"""


@check(
    "facets",
    f"WITH {STORED_COUNTRIES} SELECT DISTINCT 'company' AS facet, company AS value {OPEN}"
    f" UNION ALL SELECT DISTINCT 'category', category {OPEN}"
    " UNION ALL SELECT DISTINCT 'country', country FROM c WHERE country <> ''"
    " UNION ALL SELECT 'employment_type', unnest(['internship', 'new-grad'])",
)
def _(spark, sf):
    return V.facets(O.open_listings(stored(spark, sf)))


SELECTED = ("listing_id", "company", "location", "category", "employment_type")


@check(
    "facet_filter",
    f"WITH {STORED_COUNTRIES} SELECT {', '.join(SELECTED)} {OPEN} AND category = 'cybersecurity'"
    " AND employment_type = 'new-grad' AND listing_id IN (SELECT listing_id FROM c WHERE"
    " country = 'Spain')",
)
def _(spark, sf):
    # The company is unknown, so that filter is ignored.
    rows = V.matches(
        O.open_listings(stored(spark, sf)), company="No such company", country="Spain",
        category="cybersecurity", employment_type="new-grad",
    )
    return rows.select(*SELECTED)


@check(
    "text_search",
    "SELECT listing_id, title, location FROM {stored} WHERE status = 'open' AND contains(lower("
    "concat_ws(' ', nullif(company, ''), nullif(title, ''), nullif(category, ''),"
    " nullif(industries, ''), nullif(employment_type, ''), nullif(location, ''))),"
    " 'intern 2027 software')"
    " OR status = 'open' AND contains(lower(concat_ws(' ', company, title, category,"
    " nullif(industries, ''), employment_type, location)), 'développeur')",
)
def _(spark, sf):
    rows = O.open_listings(stored(spark, sf))
    columns = [F.col(c) for c in V.SEARCHED]
    hit = X.text_search(columns, " DÉVELOPPEUR ") | X.text_search(
        columns, "Intern 2027 Software"
    )
    return rows.filter(hit).select("listing_id", "title", "location")


@check(
    "page_of_results",
    "SELECT listing_id, company, first_seen_at, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER ("
    f"ORDER BY first_seen_at DESC, listing_id DESC) AS rank {OPEN}) WHERE rank BETWEEN 61 AND 80",
)
def _(spark, sf):
    rows = O.open_listings(stored(spark, sf)).select("listing_id", "company", "first_seen_at")
    return O.result_page(rows, O.directory_order(), index=3, size=20)


@check("page_count", f"SELECT greatest(CAST(ceil(count(*) / 20.0) AS BIGINT), 1) AS pages {OPEN}")
def _(spark, sf):
    return O.page_count(O.open_listings(stored(spark, sf)), 20)


@check(
    "category_label",
    "SELECT category, array_to_string(list_transform(string_split(category, '-'),"
    " lambda w: upper(w[1]) || w[2:]), ' ') AS label, count(*) AS n FROM {stored} GROUP BY ALL",
)
def _(spark, sf):
    counted = stored(spark, sf).groupBy("category").agg(F.count("*").alias("n"))
    return counted.select("category", X.category_label(F.col("category")).alias("label"), "n")


@check(
    "reconcile",
    "SELECT listing_id, CASE WHEN status = 'open' THEN title ELSE company END AS title,"
    " 'unexpected' AS side, CAST(1 AS BIGINT) AS n FROM {stored} WHERE FALSE"
    " UNION ALL SELECT listing_id, title, 'missing', 1 FROM {stored}"
    " WHERE status = 'open' AND category = 'other-tech'"
    " UNION ALL SELECT listing_id, title || '!', 'unexpected', 1 FROM {stored}"
    " WHERE status = 'open' AND category = 'other-tech'",
)
def _(spark, sf):
    current = O.open_listings(stored(spark, sf)).select("listing_id", "title", "category")
    drifted = current.withColumn(
        "title",
        F.when(F.col("category") == "other-tech", F.concat("title", F.lit("!"))).otherwise(
            F.col("title")
        ),
    )
    return Q.reconcile(drifted.drop("category"), current.drop("category"))


@check(
    "admission",
    "WITH known AS (SELECT listing_id FROM {stored} WHERE status = 'closed')"
    " SELECT r.listing_id, r.posted_at, k.listing_id IS NOT NULL AS is_known FROM {listing_raw} r"
    " LEFT JOIN known k USING (listing_id)"
    f" WHERE k.listing_id IS NOT NULL OR r.posted_at >= {S.POLICY}",
)
def _(spark, sf):
    from listings_spark.operators import collect as G

    known = stored(spark, sf).filter("status = 'closed'").select(
        F.lit("s").alias("search_slug"), "listing_id"
    )
    details = raw(spark, sf).select(
        F.lit("s").alias("search_slug"), "listing_id", "posted_at"
    )
    return G.admit(details, known).select("listing_id", "posted_at", "is_known")


@check(
    "excluded_counts",
    f"WITH {S.cascade_ctes('{listing_raw}')} SELECT date_posted AS batch,"
    " CAST(sum(CASE WHEN exclusion_reason IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS accepted,"
    " CAST(sum(CASE WHEN exclusion_reason IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS excluded"
    " FROM decided GROUP BY 1",
)
def _(spark, sf):
    return classified(spark, sf).groupBy(F.col("date_posted").alias("batch")).agg(
        F.count_if("decision.include").alias("accepted"),
        F.count_if(~F.col("decision.include")).alias("excluded"),
    )


@check(
    "record_violations",
    r"""SELECT listing_id, array_to_string(list_filter([
      CASE WHEN NOT regexp_matches(listing_id, '^[0-9]{1,30}$') THEN 'listing_id.pattern' END,
      CASE WHEN length(title) > 500 THEN 'title.length' END,
      CASE WHEN NOT regexp_matches(link, '^https://(?i:www\.linkedin\.com)(:443)?/jobs/view/'
        || listing_id || '/?(\?trackingId=x&utm_source=feed)?(#.*)?$') THEN 'link.identity' END,
      CASE WHEN length(description) > 200000 THEN 'description.length' END],
      lambda x: x IS NOT NULL), '|') AS violations FROM {listing_raw}""",
)
def _(spark, sf):
    df = with_places(raw(spark, sf))
    return df.select(
        "listing_id", F.array_join(Q.record_violations(), "|").alias("violations")
    )


@check(
    "discovered_records",
    f"WITH {S.cascade_ctes('{listing_raw}')} SELECT listing_id, company, clean_title AS title,"
    " shown_locations AS location, cat AS category, typ AS employment_type, posted_at,"
    " industries FROM decided WHERE exclusion_reason IS NULL AND shown_locations <> ''",
)
def _(spark, sf):
    from listings_spark.functions.cascade import discovered

    return discovered(classified(spark, sf)).select(
        "listing_id", "company", "title", "location", "category", "employment_type",
        "posted_at", "industries",
    )


TOTALS = """SELECT grp, search_slug, status, CAST(GROUPING(grp, search_slug, status) AS BIGINT) AS level,
  count(*) AS runs, CAST(sum(found_count) AS BIGINT) AS found_count,
  CAST(sum(accepted_count) AS BIGINT) AS accepted_count, CAST(sum(excluded_count) AS BIGINT) AS excluded_count,
  CAST(sum(warning_count) AS BIGINT) AS warning_count, max(duration_ms) AS longest_ms, max(finished_at) AS last_at
  FROM {runs} r LEFT JOIN (SELECT slug, grp FROM {registry}) g ON r.search_slug = g.slug GROUP BY """


@check("run_cube", TOTALS + "CUBE (grp, search_slug, status)")
def _(spark, sf):
    return N.run_totals(read(spark, sf, "runs"), read(spark, sf, "registry"))


@check("run_rollup_levels", TOTALS + "ROLLUP (grp, search_slug, status)")
def _(spark, sf):
    return N.run_totals(read(spark, sf, "runs"), read(spark, sf, "registry"), nested=True)


@check(
    "run_before",
    """WITH rows AS (SELECT event_id, search_slug, ts FROM {commits}),
    met AS (SELECT event_id, arg_max(id, (finished_at, id)) AS run_id, max(finished_at) AS finished_at
      FROM rows JOIN {runs} r ON r.search_slug = rows.search_slug AND r.finished_at <= rows.ts
      AND r.status = 'success' GROUP BY event_id)
    SELECT event_id, run_id, finished_at FROM rows LEFT JOIN met USING (event_id)""",
)
def _(spark, sf):
    # The latest good run before each event; audits have no search.
    rows = read(spark, sf, "commits").select("event_id", "search_slug", "ts")
    good = read(spark, sf, "runs").filter("status = 'success'").select("id", "search_slug", "finished_at")
    return N.with_run_before(rows, good, "ts").select(
        "event_id", F.col("run.id").alias("run_id"), F.col("run.finished_at").alias("finished_at")
    )
