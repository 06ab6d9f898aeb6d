"""Registered queries on listing-shaped rows: text, dates, geography and the cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from listings_spark import constants as K
from listings_spark.checks import sqltext as S
from listings_spark.checks.views import read, with_views
from listings_spark.functions import arrays as A
from listings_spark.functions import cascade as C
from listings_spark.functions import geo as G
from listings_spark.functions import temporal as D
from listings_spark.functions import text as X
from listings_spark.functions import urls as U

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def raw(spark, sf_dir):
    return read(spark, sf_dir, "listing_raw")


def with_places(df):
    return df.withColumn("locations", F.split("place", ";"))


RAW = "FROM {listing_raw}"


@check("normalize_title", f"SELECT listing_id, {S.title('title')} AS clean_title {RAW}")
def _(spark, sf):
    return raw(spark, sf).select(
        "listing_id", X.normalize_title(F.col("title")).alias("clean_title")
    )


@check("display_location", f"SELECT listing_id, {S.display('place')} AS shown {RAW}")
def _(spark, sf):
    return raw(spark, sf).select("listing_id", X.display_location(F.col("place")).alias("shown"))


@check(
    "phrase_match",
    f"SELECT listing_id, regexp_matches({S.key('title')}, '(^| )intern( |$)') AS intern,"
    f" regexp_matches({S.key('title')}, '(^| )data science( |$)') AS data_science {RAW}",
)
def _(spark, sf):
    key = X.normalized_key(F.col("title"))
    return raw(spark, sf).select(
        "listing_id",
        X.contains_phrase(key, "intern").alias("intern"),
        X.contains_phrase(key, "data science").alias("data_science"),
    )


TERMS = (*K.PREFILTER_INTERNSHIP_TERMS, *K.PREFILTER_NEW_GRAD_TERMS)


@check(
    "title_prefilter",
    f"SELECT listing_id, title {RAW} WHERE {S.any_phrase(S.key('title'), TERMS)}",
)
def _(spark, sf):
    return raw(spark, sf).filter(X.title_allowed(F.col("title"))).select("listing_id", "title")


AGE_CASE = " ".join(
    f"WHEN '{name}' THEN {seconds}" for name, seconds in K.AGE_UNIT_SECONDS.items()
)
AGE_RE = "^(?:reposted )?([0-9]+) (minute|hour|day|week|month|year)s? ago$"


@check(
    "relative_age",
    f"""WITH k AS (SELECT listing_id, observed_at, age_text, {S.key('age_text')} AS ak {RAW})
    SELECT listing_id, CASE WHEN contains(age_text, '+') THEN NULL
      WHEN ak IN ('just now', 'today') THEN observed_at
      WHEN regexp_matches(ak, '{AGE_RE}') THEN observed_at - INTERVAL 1 SECOND *
        (CAST(regexp_extract(ak, '{AGE_RE}', 1) AS BIGINT) *
         CASE regexp_extract(ak, '{AGE_RE}', 2) {AGE_CASE} END) END AS posted FROM k""",
)
def _(spark, sf):
    return raw(spark, sf).select(
        "listing_id", D.relative_age(F.col("age_text"), F.col("observed_at")).alias("posted")
    )


VAL = "(?:" + "|".join(K.START_PERIODS) + r")\s+20[0-9]{2}"
VERBS = r"start(?:ing|s)?|begin(?:ning|s)?|commenc(?:e|es|ing)|join(?:\s+our|\s+the)?"
NOUNS = "|".join(K.START_NOUNS)


@check(
    "start_period",
    rf"""WITH b AS (SELECT listing_id,
      nullif(regexp_extract(title, '(?i)\b({VAL})\b', 1), '') AS t,
      {S.html_text("coalesce(description, '')")} AS body {RAW}),
    f AS (SELECT listing_id, coalesce(t, nullif(regexp_extract(body,
      '(?i)\b(?:{VERBS})\b[^.\n]{{0,24}}({VAL})\b|\b({VAL})\s+(?:{NOUNS})\b', 1), ''),
      nullif(regexp_extract(body,
      '(?i)\b(?:{VERBS})\b[^.\n]{{0,24}}({VAL})\b|\b({VAL})\s+(?:{NOUNS})\b', 2), '')) AS v FROM b)
    SELECT listing_id, upper(v[1]) || lower(regexp_extract(v, '^.(\S*)', 1)) || ' '
      || regexp_extract(v, '(20[0-9]{{2}})$', 1) AS start_date FROM f""",
)
def _(spark, sf):
    body = X.html_to_text(F.col("description"))
    return raw(spark, sf).select(
        "listing_id", D.start_period(F.col("title"), body).alias("start_date")
    )


@check("years", f"WITH k AS (SELECT listing_id, {S.key('title')} AS k {RAW})"
       f" SELECT listing_id, {S.joined(S.years('k'))} AS years FROM k")
def _(spark, sf):
    return raw(spark, sf).select(
        "listing_id",
        F.array_join(D.year_tokens(X.normalized_key(F.col("title"))), "|").alias("years"),
    )


BODY_KEY = S.key(S.html_text("coalesce(description, '')"))


def body_key():
    return X.normalized_key(X.html_to_text(F.col("description")))


@check("context_years", f"WITH k AS (SELECT listing_id, {BODY_KEY} AS k {RAW})"
       f" SELECT listing_id, {S.joined(S.years('k', context=True))} AS years FROM k")
def _(spark, sf):
    return raw(spark, sf).select(
        "listing_id", F.array_join(D.context_years(body_key()), "|").alias("years")
    )


@check(
    "eligibility_years",
    f"WITH k AS (SELECT listing_id, {BODY_KEY} AS k, {S.key('title')} AS t {RAW})"
    f" SELECT listing_id, {S.joined(S.years('t', cycle_only=True))} AS title_years,"
    f" {S.joined(S.years('k', context=True, cycle_only=True))} AS body_years FROM k",
)
def _(spark, sf):
    title = X.normalized_key(F.col("title"))
    return raw(spark, sf).select(
        "listing_id",
        F.array_join(D.cycle_years(title), "|").alias("title_years"),
        F.array_join(D.context_years(body_key(), ignore_eligibility=True), "|").alias(
            "body_years"
        ),
    )


RECENCY_CASE = " ".join(
    f"WHEN date_posted = '{n}' THEN posted_at >= observed_at - INTERVAL 1 SECOND * {s}"
    for n, s in K.RECENCY_SECONDS.items()
)


@check(
    "recency_window",
    f"SELECT listing_id, date_posted, posted_at {RAW} WHERE CASE WHEN date_posted = 'any'"
    f" THEN true WHEN date_posted = 'cycle' THEN posted_at >= {S.POLICY} {RECENCY_CASE} END",
)
def _(spark, sf):
    inside = D.in_recency_window(F.col("posted_at"), F.col("date_posted"), F.col("observed_at"))
    return raw(spark, sf).filter(inside).select("listing_id", "date_posted", "posted_at")


@check(
    "date_label",
    f"SELECT listing_id, strftime(observed_at, '%-d %b %Y') AS label,"
    f" coalesce(strftime(posted_at, '%B %-d, %Y at %H:%M UTC'), 'Never') AS collected {RAW}",
)
def _(spark, sf):
    return raw(spark, sf).select(
        "listing_id",
        D.date_label(F.col("observed_at")).alias("label"),
        D.collection_label(F.col("posted_at")).alias("collected"),
    )


@check(
    "list_clean",
    f"""WITH p AS (SELECT listing_id, unnest(string_split(place, ';')) AS raw,
      unnest(range(len(string_split(place, ';')))) AS pos {RAW}),
    c AS (SELECT listing_id, {S.clean('raw')} AS item, min(pos) AS pos FROM p GROUP BY ALL)
    SELECT listing_id, coalesce(string_agg(item, '|' ORDER BY pos)
      FILTER (item <> ''), '') AS items, count(*) FILTER (item <> '') AS n
    FROM c GROUP BY listing_id""",
)
def _(spark, sf):
    df = with_places(raw(spark, sf)).withColumn("items", A.clean_list(F.col("locations")))
    return df.select(
        "listing_id", F.array_join("items", "|").alias("items"),
        F.size("items").cast("bigint").alias("n"),
    )


@check(
    "geo_resolve",
    f"WITH {S.geo_ctes('{listing_raw}')} SELECT listing_id, locations, codes, europe_signal,"
    " non_europe_signal FROM geo",
)
def _(spark, sf):
    df = with_places(raw(spark, sf)).withColumn("geo", G.resolve_locations(F.col("locations")))
    return df.select(
        "listing_id",
        A.display_list(F.col("geo.locations")).alias("locations"),
        F.array_join("geo.country_codes", ",").alias("codes"),
        F.col("geo.europe_signal").alias("europe_signal"),
        F.col("geo.non_europe_signal").alias("non_europe_signal"),
    )


@check(
    "geo_gate",
    f"WITH {S.geo_ctes('{listing_raw}')} SELECT listing_id, {S.GEO_REASON} AS reason FROM geo",
)
def _(spark, sf):
    geo = G.resolve_locations(F.col("locations"))
    df = with_places(raw(spark, sf)).withColumn("geo", geo)
    return df.select("listing_id", G.geo_rejection(F.col("geo")).alias("reason"))


COUNTRY_SPLIT = """WITH p AS (SELECT listing_id, unnest(string_split(place, ';')) AS raw,
      unnest(range(len(string_split(place, ';')))) AS pos FROM {listing_raw}),
    c AS (SELECT listing_id, pos, coalesce(nullif(trim(string_split(raw, ',')[-1]), ''),
      trim(raw)) AS country FROM p),
    d AS (SELECT listing_id, country, min(pos) AS pos FROM c WHERE country <> ''
      GROUP BY ALL)"""


@check(
    "countries",
    COUNTRY_SPLIT + " SELECT listing_id, string_agg(country, '|' ORDER BY pos) AS countries"
    " FROM d GROUP BY listing_id",
)
def _(spark, sf):
    return raw(spark, sf).select(
        "listing_id", F.array_join(A.countries(F.col("place")), "|").alias("countries")
    )


@check(
    "iso_codes",
    "SELECT listing_id, array_to_string(regexp_extract_all(' ' || regexp_replace(place,"
    " '[^A-Za-z]', '  ', 'g') || ' ', '[^A-Za-z]([A-Z]{2})[^A-Za-z]', 1), '|') AS codes "
    .replace("{2}", "{{2}}").replace("{{2}}", "{2}") + RAW,
)
def _(spark, sf):
    return raw(spark, sf).select(
        "listing_id", F.array_join(A.iso_codes(F.col("place")), "|").alias("codes")
    )


TK = f"WITH k AS (SELECT listing_id, {S.key(S.title('title'))} AS k {RAW})"


def title_key():
    return X.normalized_key(X.normalize_title(F.col("title")))


@check("employment_type", TK + f" SELECT listing_id, {S.employment('k')} AS kind FROM k")
def _(spark, sf):
    return raw(spark, sf).select("listing_id", C.employment_type(title_key()).alias("kind"))


@check("seniority", TK + f" SELECT listing_id, k FROM k WHERE NOT"
       f" {S.any_phrase('k', K.SENIORITY_PHRASES)}")
def _(spark, sf):
    df = raw(spark, sf).select("listing_id", title_key().alias("k"))
    return df.filter(~C.is_senior(F.col("k")))


@check(
    "first_category",
    f"WITH k AS (SELECT listing_id, {S.key(S.title('title'))} AS k, {BODY_KEY} AS b {RAW})"
    f" SELECT listing_id, coalesce({S.first_category('k')}, {S.first_category('b')}, CASE WHEN"
    f" {S.any_phrase('k', K.OTHER_TECH_PHRASES)} OR {S.any_phrase('b', K.OTHER_TECH_PHRASES)}"
    " THEN 'other-tech' END, 'unknown') AS category FROM k",
)
def _(spark, sf):
    df = raw(spark, sf).select("listing_id", title_key().alias("k"), body_key().alias("b"))
    return df.select(
        "listing_id", C.category_of(F.col("k"), F.col("b")).alias("category")
    )


@check("fallback_gate", TK + f" SELECT listing_id, {S.fallback('k')} AS allowed FROM k")
def _(spark, sf):
    return raw(spark, sf).select("listing_id", C.fallback_allowed(title_key()).alias("allowed"))


CYCLE = (
    f"k AS (SELECT listing_id, posted_at, {S.key(S.title('title'))} AS k, {BODY_KEY} AS b"
    f" {RAW}), t AS (SELECT *, {S.employment('k')} AS kind FROM k),"
    f" y AS (SELECT listing_id, posted_at, {S.cycle('k', 'b', 'kind')} AS cycle FROM t)"
)


def cycles(spark, sf):
    df = raw(spark, sf).select(
        "listing_id", "posted_at", title_key().alias("k"), body_key().alias("b")
    )
    kind = C.employment_type(F.col("k"))
    return df.select(
        "listing_id", "posted_at",
        D.resolve_cycle(F.col("k"), F.col("b"), kind, K.TARGET_CYCLE).alias("cycle"),
    )


@check("cycle", f"WITH {CYCLE} SELECT listing_id, cycle FROM y")
def _(spark, sf):
    return cycles(spark, sf).select("listing_id", "cycle")


@check(
    "cycle_policy",
    f"WITH {CYCLE} SELECT listing_id, CASE WHEN cycle = '{K.TARGET_CYCLE}' THEN NULL"
    " WHEN cycle <> 'unknown' THEN 'listing is for the ' || cycle || ' cycle'"
    f" WHEN posted_at IS NULL OR posted_at < {S.POLICY} THEN"
    f" '{K.REASON_UNKNOWN_CYCLE % K.TARGET_CYCLE}' END AS reason FROM y",
)
def _(spark, sf):
    reason = C.cycle_rejection(
        F.col("cycle"), F.col("posted_at"), K.TARGET_CYCLE, D.policy_date()
    )
    return cycles(spark, sf).select("listing_id", reason.alias("reason"))


def classified(spark, sf):
    return C.classify(with_places(raw(spark, sf)))


@check(
    "classify",
    f"WITH {S.cascade_ctes('{listing_raw}')} SELECT listing_id, clean_title,"
    " exclusion_reason IS NULL AS include,"
    " CASE WHEN early_reason IS NULL THEN cat ELSE 'unknown' END AS category,"
    " CASE WHEN early_reason IS NULL THEN typ END AS employment_type, exclusion_reason,"
    " shown_locations AS locations, codes FROM decided",
)
def classify_query(spark, sf):
    return classified(spark, sf).select(
        "listing_id", "clean_title", "decision.*",
        A.display_list(F.col("geo.locations")).alias("locations"),
        F.array_join("geo.country_codes", ",").alias("codes"),
    )


@check("id_extract", "SELECT listing_id, nullif(regexp_extract(urn,"
       " 'jobPosting:([0-9]{1,30})$', 1), '') AS found_id ".replace("{1,30}", "{1,30}") + RAW)
def _(spark, sf):
    return raw(spark, sf).select("listing_id", X.extract_id(F.col("urn")).alias("found_id"))


@check(
    "link_identity",
    r"SELECT listing_id, link, regexp_matches(link,"
    r" '^https://(?i:www\.linkedin\.com)(:443)?/jobs/view/' || listing_id ||"
    r" '/?(\?trackingId=x&utm_source=feed)?(#.*)?$') AS agrees " + RAW,
)
def _(spark, sf):
    agrees = U.link_matches_identity(F.col("link"), F.col("listing_id"))
    return raw(spark, sf).select("listing_id", "link", agrees.alias("agrees"))
