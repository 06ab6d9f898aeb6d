"""Registered queries on search definitions and phrase dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from listings_spark import constants as K
from listings_spark.checks import sqltext as S
from listings_spark.checks.views import read, with_views
from listings_spark.functions import arrays as A
from listings_spark.functions import text as X
from listings_spark.operators import collect as G
from listings_spark.operators import phrases as P
from listings_spark.operators import quality as Q
from listings_spark.sources import searches as R

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


DICTIONARY = f"""dictionary AS (SELECT kind, category, {S.key('phrase')} AS phrase,
  min(position) AS position FROM {{rules_raw}} GROUP BY ALL)"""


@check("rule_dictionary", f"WITH {DICTIONARY} SELECT *, CAST(NULL AS VARCHAR) AS problem"
       " FROM dictionary")
def _(spark, sf):
    return P.rule_dictionary(read(spark, sf, "rules_raw"))


@check(
    "phrase_conflicts",
    f"WITH {DICTIONARY} SELECT phrase, count(DISTINCT category) AS owners,"
    " arg_min(category, (position, category)) AS first_owner FROM dictionary GROUP BY phrase"
    " HAVING count(DISTINCT category) > 1",
)
def _(spark, sf):
    return P.phrase_conflicts(P.rule_dictionary(read(spark, sf, "rules_raw")))


TEXT_DICTIONARY = DICTIONARY.replace("rules_raw", "rules_text")
GENERIC = " OR ".join(f"contains(' ' || k || ' ', ' {p} ')" for p in K.OTHER_TECH_PHRASES)


@check(
    "category_by_rules",
    f"""WITH {TEXT_DICTIONARY},
    ranks AS (SELECT category, min(position) AS category_rank FROM dictionary GROUP BY 1),
    texts AS (SELECT doc_id, {S.key('text')} AS k FROM documents),
    found AS (SELECT doc_id, arg_min(category, (category_rank, category)) AS category
      FROM texts JOIN dictionary ON contains(' ' || k || ' ', ' ' || phrase || ' ')
      JOIN ranks USING (category) GROUP BY doc_id)
    SELECT doc_id, coalesce(category, CASE WHEN {GENERIC} THEN 'other-tech' ELSE 'unknown' END)
      AS category FROM texts LEFT JOIN found USING (doc_id)""",
)
def _(spark, sf):
    texts = read(spark, sf, "documents").select(
        "doc_id", X.normalized_key(F.col("text")).alias("k")
    )
    rules = P.rule_dictionary(read(spark, sf, "rules_text"))
    return P.first_category_by_rules(texts, "k", rules, "doc_id")


@check(
    "phrase_hits",
    f"""WITH {TEXT_DICTIONARY}, texts AS (SELECT doc_id, {S.key('text')} AS k
      FROM documents)
    SELECT doc_id, phrase, category FROM texts JOIN dictionary
      ON contains(' ' || k || ' ', ' ' || phrase || ' ')""",
)
def _(spark, sf):
    texts = read(spark, sf, "documents").select(
        "doc_id", X.normalized_key(F.col("text")).alias("k")
    )
    rules = P.rule_dictionary(read(spark, sf, "rules_text")).select("phrase", "category")
    return P.phrase_hits(texts, "k", rules, "doc_id").select(
        "doc_id", "phrase", "category"
    )


@check(
    "effective_limits",
    "SELECT slug, 3 AS max_pages, least(max_results, 75) AS max_results, 0 AS max_rechecks"
    " FROM {registry} WHERE enabled",
)
def _(spark, sf):
    limited = R.effective_searches(read(spark, sf, "registry"), max_pages=3, max_rechecks=0)
    return limited.select("slug", "max_pages", "max_results", "max_rechecks")


@check(
    "search_violations",
    f"""SELECT slug, array_to_string(list_filter([
      CASE WHEN NOT regexp_full_match(slug, '[a-z0-9]+(-[a-z0-9]+)*') THEN 'slug.pattern' END,
      CASE WHEN length(slug) > 100 THEN 'slug.length' END,
      CASE WHEN length(name) NOT BETWEEN 1 AND 200 THEN 'name.length' END,
      CASE WHEN length(keywords) NOT BETWEEN 2 AND 300 THEN 'keywords.length' END,
      CASE WHEN length(location) NOT BETWEEN 1 AND 200 THEN 'location.length' END,
      CASE WHEN date_posted NOT IN {K.DATE_POSTED} THEN 'date_posted.value' END,
      CASE WHEN workplace NOT IN {K.WORKPLACES} THEN 'workplace.value' END,
      CASE WHEN max_pages NOT BETWEEN 1 AND {K.MAX_PAGES} THEN 'max_pages.range' END,
      CASE WHEN max_results NOT BETWEEN 1 AND {K.MAX_RESULTS} THEN 'max_results.range' END,
      CASE WHEN max_results > max_pages * {K.PAGE_SIZE} THEN 'max_results.pages' END,
      CASE WHEN max_rechecks NOT BETWEEN 0 AND {K.MAX_RECHECKS} THEN 'max_rechecks.range' END,
      CASE WHEN {S.key('name')} IN ('example', 'example search') THEN 'name.placeholder' END],
      lambda x: x IS NOT NULL), '|') AS violations FROM {{registry_faulty}}""",
)
def _(spark, sf):
    faulty = read(spark, sf, "registry_faulty")
    return faulty.select("slug", F.array_join(R.search_violations(), "|").alias("violations"))


@check("group_counts", "SELECT grp, count(*) AS searches FROM {registry} GROUP BY grp")
def _(spark, sf):
    return read(spark, sf, "registry").groupBy("grp").agg(F.count("*").alias("searches"))


HASHED = ("slug", "name", "keywords", "location", "enabled", "max_pages", "max_results")
HASH_SQL = (
    """sha256('{"enabled":' || CAST(enabled AS VARCHAR) || ',"keywords":"' || keywords"""
    """ || '","location":"' || location || '","max_pages":' || max_pages || ',"max_results":'"""
    """ || max_results || ',"name":"' || name || '","slug":"' || slug || '"}')"""
)


@check("config_hash", f"SELECT slug, {HASH_SQL} AS config_hash FROM {{registry}}")
def _(spark, sf):
    digest = X.config_hash({c: F.col(c) for c in HASHED})
    return read(spark, sf, "registry").select("slug", digest.alias("config_hash"))


@check(
    "sync_searches",
    f"""WITH cfg AS (SELECT slug, name, keywords, location, enabled, {HASH_SQL} AS config_hash
      FROM {{registry}} WHERE s_suppkey % 3 <> 1)
    SELECT coalesce(n.slug, o.slug) AS slug,
      CASE WHEN n.slug IS NOT NULL THEN n.name ELSE o.name END AS name,
      CASE WHEN n.slug IS NOT NULL THEN n.keywords ELSE o.keywords END AS keywords,
      CASE WHEN n.slug IS NOT NULL THEN n.location ELSE o.location END AS location,
      CASE WHEN n.slug IS NOT NULL THEN n.config_hash ELSE o.config_hash END AS config_hash,
      coalesce(n.enabled, false) AS enabled, TIMESTAMP '2026-08-22 03:00:00' AS updated_at
    FROM {{registry_state}} o FULL OUTER JOIN cfg n ON o.slug = n.slug""",
)
def _(spark, sf):
    # The configuration of this sync knows two thirds of the searches.
    configured = read(spark, sf, "registry").filter("s_suppkey % 3 <> 1").select(
        "slug", "name", "keywords", "location", "enabled",
        X.config_hash({c: F.col(c) for c in HASHED}).alias("config_hash"),
    )
    now = F.expr("timestamp_ntz'2026-08-22 03:00:00'")
    return R.sync_searches(read(spark, sf, "registry_state"), configured, now)


@check(
    "duplicate_keys",
    "SELECT lower(keywords) || '|' || lower(location) || '||' || workplace || '|' ||"
    " date_posted AS identity, count(*) AS n FROM {registry} GROUP BY 1 HAVING count(*) > 1",
)
def _(spark, sf):
    registry = read(spark, sf, "registry")
    keyed = registry.withColumn("identity", R.query_identity(registry.columns))
    return Q.duplicate_keys(keyed, ["identity"])


NAMES = (
    "'SUPPLIER ' || CAST(s_suppkey AS STRING) || '|Supplier#' || CAST(s_suppkey AS STRING)"
    " || '|Café  R&amp;D|cafe r d|Supplier-' || CAST(s_suppkey + 20 AS STRING)"
)


@check(
    "allowlist_clean",
    f"""WITH p AS (SELECT slug, unnest(string_split({NAMES}, '|')) AS raw,
      unnest(range(5)) AS pos FROM {{registry}}),
    k AS (SELECT slug, {S.clean('raw')} AS item, {S.key('raw')} AS k, pos FROM p),
    f AS (SELECT slug, k, arg_min(item, pos) AS item, min(pos) AS pos FROM k GROUP BY ALL)
    SELECT slug, string_agg(item, '|' ORDER BY pos) AS names FROM f GROUP BY slug""",
)
def _(spark, sf):
    df = read(spark, sf, "registry").withColumn("names", F.split(F.expr(NAMES), "\\|"))
    return df.select("slug", F.array_join(A.distinct_by_key(F.col("names")), "|").alias("names"))


@check(
    "allowlist",
    f"""WITH allowed AS (SELECT slug AS search_slug, s_suppkey, s_suppkey % 2 = 0 AS anyone
      FROM {{registry}})
    SELECT c.search_slug, c.listing_id, c.company, count(*) AS n FROM {{cards}} c
    JOIN allowed a USING (search_slug)
    WHERE anyone OR {S.key('c.company')} IN ('supplier ' || s_suppkey,
      'supplier ' || (s_suppkey + 20)) GROUP BY ALL""",
)
def _(spark, sf):
    registry = read(spark, sf, "registry")
    names = F.when(F.col("s_suppkey") % 2 == 0, F.array().cast("array<string>")).otherwise(
        F.split(F.expr(NAMES), "\\|")
    )
    searches = registry.withColumn("company_names", A.distinct_by_key(names))
    cards = read(spark, sf, "cards").select("search_slug", "listing_id", "company")
    return G.allowed_companies(cards, searches).groupBy(
        "search_slug", "listing_id", "company"
    ).agg(F.count("*").alias("n"))
