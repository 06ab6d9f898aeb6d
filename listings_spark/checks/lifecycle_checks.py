"""Registered queries on the commit log: merge, provenance, closure, audits, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from listings_spark.checks.views import read, with_views
from listings_spark.operators import audit as U
from listings_spark.operators import directory as V
from listings_spark.operators import histories
from listings_spark.operators import lifecycle as L
from listings_spark.operators import quality as Q
from listings_spark.sources.session import ensure_checkpoint_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ORACLES_RAW: dict[str, str] = {}  # before the views are put in front


def check(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
            ORACLES_RAW[name] = sql
        return fn

    return register


T = 2  # closure threshold of these checks

# The SQL twin derives every state from the raw history around each event, with joins; it
# shares no step with the windowed fold.
LIFE = f"""lg AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (
    PARTITION BY run_seq, listing_id ORDER BY pos DESC) AS rn FROM {{log_raw}})
  WHERE rn = 1 AND (search_slug IS NULL OR run_seq % 6 <> 5)),
ev AS (SELECT *, coalesce(sum(CASE WHEN kind = 'audit_unavailable' THEN 1 ELSE 0 END) OVER (
    PARTITION BY listing_id ORDER BY run_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    0) AS inc, sum(CASE WHEN kind = 'audit_unavailable' THEN 1 ELSE 0 END) OVER (
    PARTITION BY listing_id) AS last_inc FROM lg),
obs AS (SELECT * FROM ev WHERE kind = 'observed'),
pairs AS (SELECT listing_id, inc, search_slug, min(run_seq) AS first_obs,
    arg_min(observed_at, run_seq) AS first_seen_at, max(observed_at) AS last_seen_at,
    arg_max(run_id, run_seq) AS last_seen_run_id FROM obs GROUP BY ALL),
lives AS (SELECT listing_id, inc, min(run_seq) AS born FROM obs GROUP BY ALL),
moments AS (SELECT listing_id, inc, run_seq FROM ev UNION ALL
  SELECT DISTINCT listing_id, last_inc, CAST(9000000000 AS BIGINT) FROM ev),
resets AS (SELECT m.listing_id, m.inc, m.run_seq, p.search_slug, max(r.run_seq) AS reset
  FROM moments m JOIN pairs p ON m.listing_id = p.listing_id AND m.inc = p.inc
    AND p.first_obs < m.run_seq
  JOIN ev r ON r.listing_id = m.listing_id AND r.inc = m.inc AND r.run_seq < m.run_seq
    AND (r.kind = 'observed' AND r.search_slug = p.search_slug
      OR r.kind = 'audit_available' AND r.run_seq > p.first_obs)
  GROUP BY ALL),
confs AS (SELECT s.listing_id, s.inc, s.run_seq, s.search_slug,
    least({T}, count(u.run_seq)) AS conf
  FROM resets s LEFT JOIN ev u ON u.listing_id = s.listing_id AND u.inc = s.inc
    AND u.search_slug = s.search_slug AND u.kind = 'unavailable'
    AND u.run_seq > s.reset AND u.run_seq < s.run_seq
  GROUP BY ALL),
around AS (SELECT listing_id, inc, run_seq, count(*) AS npairs,
    count(*) FILTER (conf < {T}) AS active FROM confs GROUP BY ALL),
prior AS (SELECT listing_id, inc, run_seq, lag((company, title, location, link, category,
      employment_type)) OVER w AS before_fields,
    (company, title, location, link, category, employment_type) AS now_fields,
    last_value(nullif(industries, '') IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING) AS before_ind,
    last_value(start_date IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING) AS before_start
  FROM obs WINDOW w AS (PARTITION BY listing_id, inc ORDER BY run_seq)),
flagged AS (SELECT e.*, l.born IS NOT NULL AND l.born < e.run_seq AS existed,
    a.npairs IS NOT NULL AND a.active = 0 AS was_closed,
    c.conf AS own, coalesce(a.active, 0) AS active,
    p.now_fields IS DISTINCT FROM p.before_fields
      OR nullif(e.industries, '') IS NOT NULL
        AND nullif(e.industries, '') IS DISTINCT FROM p.before_ind
      OR e.start_date IS NOT NULL AND e.start_date IS DISTINCT FROM p.before_start AS differs
  FROM ev e LEFT JOIN lives l USING (listing_id, inc)
  LEFT JOIN around a USING (listing_id, inc, run_seq)
  LEFT JOIN confs c ON c.listing_id = e.listing_id AND c.inc = e.inc
    AND c.run_seq = e.run_seq AND c.search_slug = e.search_slug
  LEFT JOIN prior p ON p.listing_id = e.listing_id AND p.inc = e.inc AND p.run_seq = e.run_seq),
flags AS (SELECT *, kind = 'observed' AND NOT existed AS is_new,
    kind = 'observed' AND existed AND differs AS is_changed,
    kind IN ('observed', 'audit_available') AND existed AND was_closed AS is_reopened,
    coalesce(kind = 'unavailable' AND own = {T} - 1 AND active = 1, false) AS is_closed,
    kind = 'audit_unavailable' AND existed AS is_deleted,
    max(CASE WHEN kind = 'observed' OR kind = 'audit_available' AND existed
      THEN observed_at END) OVER (PARTITION BY listing_id, inc ORDER BY run_seq) AS eff
  FROM flagged),
counters AS (SELECT run_seq, count(*) FILTER (is_new) AS new_count,
    count(*) FILTER (is_changed) AS updated_count, count(*) FILTER (is_closed) AS closed_count,
    count(*) FILTER (is_reopened) AS reopened_count,
    count(*) FILTER (is_deleted) AS deleted_count FROM flags GROUP BY run_seq),
live AS (SELECT * FROM flags WHERE inc = last_inc),
sets AS (SELECT listing_id, max(run_seq) AS set_seq, arg_max(eff, run_seq) AS set_at FROM live
  WHERE kind = 'observed' AND (is_new OR is_changed OR is_reopened) GROUP BY 1),
raises AS (SELECT listing_id, max(CASE WHEN is_closed THEN observed_at ELSE eff END) AS raised
  FROM live JOIN sets USING (listing_id)
  WHERE run_seq > set_seq AND (is_closed OR kind = 'audit_available' AND is_reopened)
  GROUP BY 1),
listings AS (SELECT o.listing_id, arg_max(company, run_seq) AS company,
    arg_max(title, run_seq) AS title, arg_max(location, run_seq) AS location,
    arg_max(link, run_seq) AS link, arg_max(category, run_seq) AS category,
    arg_max(nullif(industries, ''), run_seq) FILTER (nullif(industries, '') IS NOT NULL)
      AS industries,
    arg_max(employment_type, run_seq) AS employment_type,
    arg_max(start_date, run_seq) FILTER (start_date IS NOT NULL) AS start_date,
    arg_min(least(coalesce(posted_at, observed_at), observed_at), run_seq) AS first_seen_at
  FROM obs o WHERE inc = last_inc GROUP BY 1),
seen AS (SELECT listing_id, max(eff) AS last_seen_at FROM live GROUP BY 1),
final AS (SELECT l.*, s.last_seen_at, greatest(u.set_at, coalesce(r.raised, u.set_at))
    AS updated_at, CASE WHEN a.active > 0 THEN 'open' ELSE 'closed' END AS status
  FROM listings l JOIN seen s USING (listing_id) JOIN sets u USING (listing_id)
  LEFT JOIN raises r USING (listing_id)
  JOIN around a ON a.listing_id = l.listing_id AND a.run_seq = 9000000000),
links AS (SELECT p.search_slug, p.listing_id, p.first_seen_at, p.last_seen_at,
    p.last_seen_run_id, CAST(c.conf AS INTEGER) AS unavailable_confirmations,
    c.conf < {T} AS active
  FROM pairs p JOIN (SELECT DISTINCT listing_id, last_inc FROM ev) e
    ON e.listing_id = p.listing_id AND e.last_inc = p.inc
  JOIN confs c ON c.listing_id = p.listing_id AND c.inc = p.inc
    AND c.search_slug = p.search_slug AND c.run_seq = 9000000000)"""


def log(spark, sf, rows=None):
    raw = read(spark, sf, "log_raw")
    collapsed = L.collapse_log(raw, rows=raw.count() if rows is None else rows)
    return L.committed_only(collapsed, read(spark, sf, "runs"))


def folded(spark, sf):
    # Collapsing leaves at most the raw rows, which are counted without making the log.
    rows = read(spark, sf, "log_raw").count()
    return L.fold(log(spark, sf, rows), threshold=T, rows=rows)


def state(spark, sf):
    # Both tables, and all that reads them again, come from one fold.
    ensure_checkpoint_dir(spark)
    events = L.stored(folded(spark, sf))
    return L.listings_from(events), L.provenance_from(events, T)


@check("merge_listings", f"WITH {LIFE} SELECT * FROM final")
def _(spark, sf):
    return L.listings_from(folded(spark, sf))


@check("merge_provenance", f"WITH {LIFE} SELECT * FROM links")
def _(spark, sf):
    return L.provenance_from(folded(spark, sf), T)


@check(
    "merge_counters",
    f"WITH {LIFE} SELECT * FROM counters",
)
def _(spark, sf):
    return L.counters_from(folded(spark, sf))


def in_blocks(spark, sf):
    # Histories of more than a few commits are cut into blocks that fold apart.
    ensure_checkpoint_dir(spark)
    events = log(spark, sf).checkpoint()
    return L.fold(events, threshold=T, long=histories.long_histories(events, 5))


@check("merge_in_blocks", f"WITH {LIFE} SELECT * FROM final")
def _(spark, sf):
    return L.listings_from(in_blocks(spark, sf))


@check("links_in_blocks", f"WITH {LIFE} SELECT * FROM links")
def _(spark, sf):
    return L.provenance_from(in_blocks(spark, sf), T)


@check("counters_in_blocks", f"WITH {LIFE} SELECT * FROM counters")
def _(spark, sf):
    return L.counters_from(in_blocks(spark, sf))


@check(
    "merge_incremental",
    f"WITH {LIFE} SELECT * FROM final",
)
def _(spark, sf):
    # The second half of the history merged into the state after the first half.
    half = (2024 * 12 + 1) * 744 * 5 + 5 * 24 * 15
    ensure_checkpoint_dir(spark)
    events = log(spark, sf).checkpoint()
    first = L.fold(events.filter(F.col("run_seq") < half), threshold=T).checkpoint()
    rest = events.filter(F.col("run_seq") >= half)
    again = L.fold(rest, L.listings_from(first), L.provenance_from(first, T), T)
    return L.listings_from(again)


@check(
    "confirmations",
    f"WITH {LIFE} SELECT run_seq, search_slug, listing_id, own + 1 AS unavailable_confirmations,"
    f" own + 1 < {T} AS active, is_closed AS closes_listing FROM flags"
    f" WHERE kind = 'unavailable' AND own < {T}",
)
def _(spark, sf):
    return L.confirmation_trail(folded(spark, sf), T)


@check(
    "status_now",
    f"WITH {LIFE} SELECT listing_id, CASE WHEN count(*) FILTER (active) > 0 THEN 'open' ELSE"
    " 'closed' END AS status, count(*) FILTER (active) AS active_searches FROM links GROUP BY 1",
)
def _(spark, sf):
    return L.listing_status(L.provenance_from(folded(spark, sf), T))


@check(
    "closable",
    f"WITH {LIFE} SELECT DISTINCT listing_id FROM lg WHERE kind = 'unavailable' AND listing_id"
    " NOT IN (SELECT listing_id FROM links WHERE active)",
)
def _(spark, sf):
    affected = log(spark, sf).filter("kind = 'unavailable'")
    return L.closable(L.provenance_from(folded(spark, sf), T), affected)


@check(
    "known_listings",
    f"WITH {LIFE} SELECT search_slug, listing_id, company, title, location, link FROM links"
    " JOIN (SELECT listing_id, company, title, location, link FROM final) USING (listing_id)"
    " WHERE active",
)
def _(spark, sf):
    return L.known_listings(*state(spark, sf))


@check(
    "isolation",
    "WITH lg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_seq, listing_id"
    " ORDER BY pos DESC) AS rn FROM {log_raw}) WHERE rn = 1)"
    " SELECT run_seq, listing_id, kind FROM lg WHERE search_slug IS NULL OR run_seq % 6 <> 5",
)
def _(spark, sf):
    return log(spark, sf).select("run_seq", "listing_id", "kind")


# Audit of the merged state: what each listing's pages answer follows from its id.
CHECKED = (
    "CASE WHEN CAST(listing_id AS BIGINT) % 10 = 0 THEN 404 WHEN CAST(listing_id AS BIGINT)"
    " % 10 = 1 THEN 503 ELSE 200 END AS public_status,"
    " CAST(listing_id AS BIGINT) % 10 = 2 AS closed_notice,"
    " CASE WHEN CAST(listing_id AS BIGINT) % 10 = 3 THEN 410 WHEN CAST(listing_id AS BIGINT)"
    " % 10 = 4 THEN 429 ELSE 200 END AS detail_status,"
    " CAST(listing_id AS BIGINT) % 10 <> 5 AS identity_ok"
)
OUTCOME = (
    "CASE WHEN public_status = 404 OR public_status = 200 AND (closed_notice OR detail_status"
    " = 410) THEN 'unavailable' WHEN public_status = 200 AND detail_status = 200 AND identity_ok"
    " THEN 'available' ELSE 'inconclusive' END"
)
AUDITED = (
    f"audited AS (SELECT listing_id, {OUTCOME} AS outcome, TIMESTAMP '2024-01-25 12:00:00' AS"
    f" observed_at FROM (SELECT listing_id, {CHECKED} FROM final))"
)


def page_facts(listings):
    return listings.select("listing_id", *[F.expr(x) for x in _split_items(CHECKED)])


def audited(listings):
    stamp = F.expr("timestamp_ntz'2024-01-25 12:00:00'")
    return U.outcomes(page_facts(listings)).withColumn("observed_at", stamp)


def _split_items(text: str) -> list[str]:
    return [item.strip() for item in text.split(",")]


@check(
    "audit_outcome",
    f"WITH {LIFE}, {AUDITED} SELECT listing_id, outcome FROM audited",
)
def _(spark, sf):
    return audited(L.listings_from(folded(spark, sf))).select("listing_id", "outcome")


@check(
    "audit_apply",
    f"WITH {LIFE}, {AUDITED} SELECT f.* REPLACE ("
    " CASE WHEN outcome = 'available' THEN greatest(f.last_seen_at, observed_at)"
    "   ELSE f.last_seen_at END AS last_seen_at,"
    " CASE WHEN outcome = 'available' AND status = 'closed' THEN greatest(f.updated_at,"
    "   f.last_seen_at, observed_at) ELSE f.updated_at END AS updated_at,"
    " CASE WHEN outcome = 'available' THEN 'open' ELSE status END AS status)"
    " FROM final f JOIN audited USING (listing_id) WHERE outcome <> 'unavailable'",
)
def _(spark, sf):
    listings, links = state(spark, sf)
    return U.apply_audit(listings, links, audited(listings))[0]


@check(
    "audit_apply_links",
    f"WITH {LIFE}, {AUDITED} SELECT l.* REPLACE ("
    " CASE WHEN outcome = 'available' THEN 0 ELSE unavailable_confirmations END"
    "   AS unavailable_confirmations,"
    " outcome = 'available' OR active AS active)"
    " FROM links l JOIN audited USING (listing_id) WHERE outcome <> 'unavailable'",
)
def _(spark, sf):
    listings, links = state(spark, sf)
    return U.apply_audit(listings, links, audited(listings))[1]


@check(
    "audit_summary",
    f"WITH {LIFE}, {AUDITED} SELECT count(*) AS checked, count(*) FILTER (outcome ="
    " 'available') AS available, count(*) FILTER (outcome = 'unavailable') AS deleted,"
    " count(*) FILTER (outcome = 'available' AND status = 'closed') AS reopened,"
    " count(*) FILTER (outcome = 'inconclusive') AS inconclusive"
    " FROM audited JOIN final USING (listing_id)",
)
def _(spark, sf):
    listings = L.listings_from(folded(spark, sf))
    return U.summary(listings, audited(listings))


@check(
    "audit_inconclusive",
    f"WITH {LIFE}, {AUDITED} SELECT listing_id FROM audited WHERE outcome = 'inconclusive'",
)
def _(spark, sf):
    return U.inconclusive_ids(audited(L.listings_from(folded(spark, sf))))


@check(
    "audit_conflicts",
    "SELECT listing_id FROM {log_raw} WHERE kind = 'audit_available' INTERSECT"
    " SELECT listing_id FROM {log_raw} WHERE kind = 'audit_unavailable'",
)
def _(spark, sf):
    rows = read(spark, sf, "log_raw")
    return U.conflicts(
        rows.filter("kind = 'audit_available'"), rows.filter("kind = 'audit_unavailable'")
    )


COUNTERS = ("duration_ms", "found_count", "accepted_count", "excluded_count", "warning_count")


@check(
    "constraint_report",
    f"WITH {LIFE}, f AS (SELECT * REPLACE (CASE WHEN category = 'data-science' THEN 'gardening'"
    " ELSE category END AS category) FROM final), r AS (SELECT * REPLACE (duration_ms - 60 AS"
    " duration_ms) FROM {runs})"
    " SELECT 'listings' AS \"table\", 'employment_type' AS rule, 0 AS violations UNION ALL"
    " SELECT 'listings', 'listing_status', 0 UNION ALL"
    " SELECT 'listings', 'category', count(*) FROM f WHERE category = 'gardening' UNION ALL"
    " SELECT 'listings', 'seen_at_order', count(*) FROM f WHERE last_seen_at < first_seen_at"
    " UNION ALL SELECT 'provenance', 'confirmations_nonnegative', 0 UNION ALL"
    " SELECT 'provenance', 'link_seen_at_order', count(*) FROM links WHERE last_seen_at <"
    " first_seen_at UNION ALL SELECT 'runs', 'run_status', 0 UNION ALL"
    + " UNION ALL ".join(
        f" SELECT 'runs', '{c}_nonnegative', count(*) FROM r WHERE {c} < 0" for c in COUNTERS
    ),
)
def _(spark, sf):
    listings, links = state(spark, sf)
    # Damage two columns so that the report has something to find.
    damaged = listings.withColumn(
        "category",
        F.when(F.col("category") == "data-science", "gardening").otherwise(F.col("category")),
    )
    runs = read(spark, sf, "runs").withColumn("duration_ms", F.col("duration_ms") - 60)
    return Q.constraint_report(damaged, links, runs)


@check(
    "fk_orphans",
    f"WITH {LIFE}, kept AS (SELECT * FROM final WHERE status = 'open'), searches AS (SELECT slug"
    " FROM {registry} WHERE enabled)"
    " SELECT 'runs.search_slug' AS reference, count(*) AS orphans FROM {runs} WHERE search_slug"
    " NOT IN (SELECT slug FROM searches) UNION ALL SELECT 'provenance.search_slug', count(*)"
    " FROM links WHERE search_slug NOT IN (SELECT slug FROM searches) UNION ALL SELECT"
    " 'provenance.listing_id', count(*) FROM links WHERE listing_id NOT IN (SELECT listing_id"
    " FROM kept) UNION ALL SELECT 'provenance.last_seen_run_id', count(*) FROM links WHERE"
    " last_seen_run_id NOT IN (SELECT id FROM {runs})",
)
def _(spark, sf):
    listings, links = state(spark, sf)
    searches = read(spark, sf, "registry").filter("enabled")
    kept = listings.filter("status = 'open'")
    return Q.fk_report(kept, links, read(spark, sf, "runs"), searches)


@check(
    "cascade_delete",
    f"WITH {LIFE} SELECT 'provenance' AS \"table\", count(*) AS n FROM links WHERE search_slug IN"
    " (SELECT slug FROM {registry} WHERE enabled) UNION ALL SELECT 'runs', count(*) FROM {runs}"
    " WHERE search_slug IN (SELECT slug FROM {registry} WHERE enabled)",
)
def _(spark, sf):
    links = L.provenance_from(folded(spark, sf), T)
    kept = read(spark, sf, "registry").filter("enabled")
    links, runs = L.delete_searches(links, read(spark, sf, "runs"), kept)
    return links.agg(F.lit("provenance").alias("table"), F.count("*").alias("n")).unionByName(
        runs.agg(F.lit("runs").alias("table"), F.count("*").alias("n"))
    )


@check(
    "stats",
    "SELECT (SELECT count(*) FROM {stored}) AS total, (SELECT count(*) FROM {stored} WHERE"
    " status = 'open') AS open, (SELECT count(*) FROM {stored} WHERE status <> 'open') AS closed,"
    " (SELECT count(*) FROM {registry} WHERE enabled) AS configured_searches,"
    " (SELECT count(*) FROM {runs} WHERE status = 'success') AS successful_runs,"
    " (SELECT count(*) FROM {runs} WHERE status = 'failed') AS failed_runs,"
    " (SELECT max(finished_at) FROM {runs} WHERE status = 'success') AS last_success_at",
)
def _(spark, sf):
    return V.state_stats(
        read(spark, sf, "stored"), read(spark, sf, "runs"), read(spark, sf, "registry")
    )


@check(
    "last_success",
    "SELECT max(finished_at) AS last_success_at FROM {runs} WHERE status = 'success'",
)
def _(spark, sf):
    return V.last_success(read(spark, sf, "runs"))


CHANGES = ("new_count", "updated_count", "closed_count", "reopened_count")


@check(
    "run_rollup",
    f"WITH {LIFE}, b AS (SELECT CAST(finished_at AS DATE) AS batch, status = 'success' AS ok, r.*"
    " EXCLUDE (status), c.* EXCLUDE (run_seq) FROM {runs} r LEFT JOIN counters c"
    " USING (run_seq))"
    " SELECT batch, count(*) FILTER (ok) AS successful_searches, count(*) FILTER (NOT ok) AS"
    " failed_searches, "
    + ", ".join(
        f"CAST(coalesce(sum({c}) FILTER (ok), 0) AS BIGINT) AS {c}"
        for c in (*COUNTERS[1:], *CHANGES)
    )
    + ", CASE WHEN count(*) FILTER (ok) = 0 THEN 'failed' WHEN count(*) FILTER (NOT ok) > 0"
    " THEN 'partial' ELSE 'success' END AS status FROM b GROUP BY batch",
)
def _(spark, sf):
    counters = L.counters_from(folded(spark, sf))
    return V.run_rollup(read(spark, sf, "runs"), counters, F.to_date("finished_at"))


HEALTH = (
    "health AS (SELECT slug, status, finished_at, found_count, accepted_count, excluded_count,"
    " error_code FROM (SELECT *, row_number() OVER (PARTITION BY search_slug ORDER BY"
    " finished_at DESC, id DESC) AS rn FROM {runs}) x JOIN {registry} g ON g.slug ="
    " x.search_slug WHERE rn = 1 AND enabled)"
)


@check("search_health", f"WITH {HEALTH} SELECT * FROM health")
def _(spark, sf):
    return V.search_health(read(spark, sf, "runs"), read(spark, sf, "registry"))


@check(
    "registry_health",
    f"WITH {HEALTH} SELECT slug, location AS scope, CASE WHEN enabled THEN 'yes' ELSE 'no' END"
    " AS enabled, max_pages || '/' || max_results || '/' || max_rechecks AS limits,"
    " coalesce(h.status, 'never-run') AS last, CASE WHEN h.status IS NULL THEN '-/-' ELSE"
    " h.found_count || '/' || h.accepted_count END AS found_accepted"
    " FROM {registry} LEFT JOIN health h USING (slug)",
)
def _(spark, sf):
    registry = read(spark, sf, "registry")
    return V.registry_health(registry, V.search_health(read(spark, sf, "runs"), registry))


@check(
    "failure_rows",
    "SELECT id, search_slug, status, CASE WHEN status = 'failed' THEN 0 ELSE found_count END AS"
    " found_count, CASE WHEN status = 'failed' THEN 0 ELSE accepted_count END AS accepted_count,"
    " CASE WHEN status = 'failed' THEN substr(error_code, 1, 100) END AS error_code,"
    " CASE WHEN status = 'failed' THEN substr(error_message, 1, 500) END AS error_message"
    " FROM {runs}",
)
def _(spark, sf):
    from listings_spark.sources.runlog import run_rows

    return run_rows(read(spark, sf, "runs")).select(
        "id", "search_slug", "status", "found_count", "accepted_count", "error_code",
        "error_message",
    )
