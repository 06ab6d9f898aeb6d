"""Registered queries on stored state: streams, replays, replacement, the run log, snapshots.

Each writes to the session's shared folder and reads back what a later reader would see.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from listings_spark.checks import lifecycle_checks, listing_checks
from listings_spark.checks.lifecycle_checks import LIFE, T
from listings_spark.checks.views import read, with_views
from listings_spark.functions import arrays as A
from listings_spark.functions import temporal as D
from listings_spark.operators import lifecycle as L
from listings_spark.plans import state as S
from listings_spark.operators import ordering as O
from listings_spark.sources import pages as P
from listings_spark.sources import runlog, snapshots, tables
from listings_spark.sources.session import dealt, ensure_checkpoint_dir
from listings_spark.streaming import merge as M

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str):
    def register(fn):
        QUERIES[name] = fn
        ORACLES[name] = with_views(sql)
        return fn

    return register


def place(spark) -> str:
    """A new folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/check-{uuid.uuid4().hex}"


def committed(spark, sf):
    """The commit log as stored rows, so that writers and streams see one fixed table."""
    base = place(spark)
    log = lifecycle_checks.log(spark, sf)
    log.withColumn("pos", F.lit(0).cast("bigint")).write.parquet(base)
    return spark.read.parquet(base)


@check("stream_merge", f"WITH {LIFE} SELECT * FROM final")
def _(spark, sf):
    # Runs of commits arrive as files, one file a micro-batch.
    log, base = committed(spark, sf), place(spark)
    cuts = log.agg(F.expr("percentile_approx(run_seq, array(0.4, 0.7))")).first()[0]
    bounds = [None, *sorted(set(cuts)), None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = log
        part = part if low is None else part.filter(F.col("run_seq") > low)
        part = part if high is None else part.filter(F.col("run_seq") <= high)
        M.write_commits(part, f"{base}/log")
    stream = M.log_stream(spark, f"{base}/log", log.schema, files_per_trigger=1)
    M.merge_stream(stream, f"{base}/state", f"{base}/marks", T).awaitTermination()
    return S.load_state(spark, f"{base}/state")["listings"]


@check("reordered_log", f"WITH {LIFE} SELECT * FROM final")
def _(spark, sf):
    # Commits arrive in an order drawn by hash; each waits until all before it are there.
    log, base = committed(spark, sf), place(spark)
    parts = log.withColumn("part", F.pmod(F.xxhash64("run_seq"), F.lit(4)))
    parts.write.partitionBy("part").parquet(f"{base}/log")
    expected = log.select("run_seq").distinct()
    reach = log.agg(F.max("run_seq") - F.min("run_seq")).first()[0]
    for part in range(4):
        stream = spark.readStream.schema(log.schema).parquet(f"{base}/log/part={part}")
        M.merge_stream_in_order(
            stream, f"{base}/state", f"{base}/marks-{part}", expected, reach + 1, T
        ).awaitTermination()
    return S.load_state(spark, f"{base}/state")["listings"]


# The youngest tenth of the commits arrives first and is merged; the rest comes too late.
@check(
    "late_commits",
    f"WITH {LIFE}, cut AS (SELECT max(run_seq) - (max(run_seq) - min(run_seq)) // 10 AS bound FROM lg)"
    " SELECT listing_id, run_seq, kind FROM lg, cut WHERE run_seq < bound",
)
def _(spark, sf):
    log, base = committed(spark, sf), place(spark)
    low, high = log.agg(F.min("run_seq"), F.max("run_seq")).first()
    at = high - (high - low) // 10
    S.apply_in_order(log.filter(F.col("run_seq") >= at), base, threshold=T, last=True)
    S.apply_in_order(log.filter(F.col("run_seq") < at), base, threshold=T, last=True)
    return S.late_commits(spark, base).select("listing_id", "run_seq", "kind")


HALF = (2024 * 12 + 1) * 744 * 5 + 5 * 24 * 15


@check(
    "evolved_state",
    f"WITH {LIFE}, held AS (SELECT listing_id FROM lives JOIN (SELECT DISTINCT listing_id, last_inc FROM ev)"
    f" USING (listing_id) WHERE inc = last_inc AND born < {HALF})"
    " SELECT f.*, CASE WHEN h.listing_id IS NOT NULL THEN 'first half' END AS note, CAST(NULL AS INTEGER) AS score"
    " FROM final f LEFT JOIN held h USING (listing_id)",
)
def _(spark, sf):
    # A column with a constant and one without are added between two merges.
    log, base = committed(spark, sf), place(spark)
    S.apply_log(log.filter(F.col("run_seq") < HALF), base, T)
    S.evolve_state(spark, base, "listings", {"note": "string"}, backfill={"note": "first half"})
    S.evolve_state(spark, base, "listings", {"score": "int"})
    S.apply_log(log.filter(F.col("run_seq") >= HALF), base, T)
    return S.load_state(spark, base)["listings"]


BROKEN = (
    "CASE WHEN listing_id LIKE '%3' THEN 'contract' ELSE employment_type END AS employment_type,"
    " CASE WHEN listing_id LIKE '%33' OR listing_id LIKE '%4' THEN first_seen_at - INTERVAL '1' DAY"
    " ELSE last_seen_at END AS last_seen_at"
)


@check(
    "quarantine",
    f"WITH {LIFE} SELECT listing_id AS key, concat_ws(',', CASE WHEN listing_id LIKE '%3' THEN"
    " 'employment_type' END, CASE WHEN listing_id LIKE '%33' OR listing_id LIKE '%4' THEN 'seen_at_order' END)"
    " AS violations, false AS readable FROM final WHERE listing_id LIKE '%3' OR listing_id LIKE '%4'"
    " UNION ALL SELECT listing_id, '', true FROM final"
    " WHERE listing_id NOT LIKE '%3' AND listing_id NOT LIKE '%4'",
)
def _(spark, sf):
    # A publication with broken rows: they are set aside, the others are read.
    base = place(spark)
    listings = lifecycle_checks.state(spark, sf)[0]
    broken = listings.selectExpr(
        *[c for c in listings.columns if c not in ("employment_type", "last_seen_at")],
        BROKEN.split(", CASE")[0], "CASE" + BROKEN.split(", CASE")[1],
    )
    tables.publish_buckets(
        {"listings": broken}, base, "listing_id", list(range(8)), 8,
        rules={"listings": S.RULES["listings"]()}, allowed=1 << 40,
    )
    kept = tables.read_buckets(spark, base, "listings", tables.manifest(spark, base))
    return tables.read_quarantine(spark, base).select(
        "key", F.array_join("violations", ",").alias("violations"), F.lit(False).alias("readable")
    ).unionByName(
        kept.select(F.col("listing_id").alias("key"), F.lit("").alias("violations"), F.lit(True).alias("readable"))
    )


@check("published_audit", lifecycle_checks.ORACLES_RAW["audit_apply"])
def _(spark, sf):
    # The audit of a published state reads and rewrites the buckets of checked listings only.
    log, base = committed(spark, sf), place(spark)
    S.apply_log(log, base, T)
    listings = S.load_state(spark, base)["listings"]
    S.apply_audit(lifecycle_checks.page_facts(listings), base, F.expr("timestamp_ntz'2024-01-25 12:00:00'"))
    return S.load_state(spark, base)["listings"]


@check("published_audit_report", lifecycle_checks.ORACLES_RAW["audit_summary"])
def _(spark, sf):
    log, base = committed(spark, sf), place(spark)
    S.apply_log(log, base, T)
    facts = lifecycle_checks.page_facts(S.load_state(spark, base)["listings"])
    return S.apply_audit(facts, base, F.expr("timestamp_ntz'2024-01-25 12:00:00'"))


@check("replayed_state", f"WITH {LIFE} SELECT * FROM links")
def _(spark, sf):
    # The same commits again change nothing.
    log, base = committed(spark, sf), place(spark)
    for _ in range(2):
        S.apply_log(log, base, T)
    return S.load_state(spark, base)["provenance"]


@check("stream_classify", listing_checks.ORACLES["classify"])
def _(spark, sf):
    base = place(spark)
    rows = listing_checks.with_places(listing_checks.raw(spark, sf))
    dealt(rows).write.parquet(f"{base}/raw")  # files for all cores
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/raw")
    M.classify_stream(stream, f"{base}/out", f"{base}/marks").awaitTermination()
    return spark.read.parquet(f"{base}/out").select(
        "listing_id", "clean_title", "decision.*",
        A.display_list(F.col("geo.locations")).alias("locations"),
        F.array_join("geo.country_codes", ",").alias("codes"),
    )


@check(
    "replaced_table",
    "SELECT slug, keywords, CAST(2 AS BIGINT) AS version FROM {registry} WHERE enabled",
)
def _(spark, sf):
    base, registry = place(spark), read(spark, sf, "registry").select("slug", "keywords", "enabled")
    tables.replace_table(registry.drop("enabled"), base)
    tables.replace_table(registry.filter("enabled").drop("enabled"), base)
    version = F.lit(tables.current_version(spark, base)).cast("bigint")
    return tables.read_current(spark, base).withColumn("version", version)


@check(
    "appended_runs",
    "SELECT id, run_seq, status, CASE WHEN status = 'failed' THEN 0 ELSE found_count END AS found_count,"
    " CAST(finished_at AS DATE) AS run_date FROM {runs}",
)
def _(spark, sf):
    base, runs = place(spark), read(spark, sf, "runs")
    for odd in (0, 1):
        runlog.append_runs(runs.filter(F.pmod("run_seq", F.lit(2)) == odd), base)
    return spark.read.parquet(base).select("id", "run_seq", "status", "found_count", "run_date")


@check(
    "evolved_table",
    "SELECT s_suppkey, s_name, CAST(NULL AS VARCHAR) AS note, coalesce(nullif(s_nationkey, 0), -1)"
    " AS s_nationkey FROM supplier",
)
def _(spark, sf):
    old = read(spark, sf, "supplier").select(
        "s_suppkey", "s_name", "s_acctbal", F.expr("nullif(s_nationkey, 0)").alias("s_nationkey")
    )
    return L.evolve(old, add={"note": "string"}, drop=("s_acctbal",), backfill={"s_nationkey": -1})


@check(
    "utc_times",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 2 HOUR"
    " ELSE ts + INTERVAL 330 MINUTE END AS at FROM events",
)
def _(spark, sf):
    offset = F.expr("CASE event_id % 3 WHEN 1 THEN '+02:00' WHEN 2 THEN '-05:30' END")
    at = D.ensure_utc(F.col("ts"), offset).cast("timestamp_ntz")
    return read(spark, sf, "events").select("event_id", at.alias("at"))


@check(
    "page_source",
    "SELECT page_id, url, strlen(html) AS bytes FROM pages",
)
def _(spark, sf):
    return P.read_pages(spark, f"{sf}/pages.parquet").select(
        "page_id", "url", F.octet_length("html").cast("bigint").alias("bytes")
    )


STATE_ROWS = (
    "(SELECT count(*) FROM final) + (SELECT count(*) FROM links) + (SELECT count(*) FROM {runs})"
    " + (SELECT count(*) FROM {registry})"
)
KEYS = [
    f"20300101T00000{i}.000000Z-run-{run}-attempt-1" for i, run in enumerate(("first", "second"))
]


@check(
    "snapshots",
    f"WITH {LIFE} SELECT key, CAST({STATE_ROWS} AS BIGINT) AS row_count, previous, problems, '' AS broken"
    f" FROM (VALUES ('{KEYS[0]}', NULL, ''), ('{KEYS[1]}', '{KEYS[0]}', 'digest'))"
    " AS v(key, previous, problems)",
)
def _(spark, sf):
    # Two snapshots in a chain; afterwards a value of the second is moved to the next column.
    base = place(spark)
    listings, links = lifecycle_checks.state(spark, sf)
    held = {
        "searches": read(spark, sf, "registry"), "runs": read(spark, sf, "runs"),
        "listings": listings, "provenance": links,
    }
    key = None
    for i, run in enumerate(("first", "second")):
        key = snapshots.create_snapshot(
            held, base, created_at=datetime(2030, 1, 1, 0, 0, i), retention_days=30, run_id=run,
            previous_key=key,
        )
    shifted = listings.withColumns({
        "company": F.concat("company", F.lit("|"), "title"), "title": F.lit(""),
    })
    shifted.write.mode("overwrite").parquet(f"{base}/{key}/listings")
    manifests = snapshots.load_manifest(spark, base)
    found = None
    for one in KEYS:
        row = snapshots.verify_snapshot(spark, base, one)
        found = row if found is None else found.unionByName(row)
    rules = snapshots.manifest_violations(manifests)
    return (
        manifests.select("key", "row_count", F.col("previous_key").alias("previous"))
        .join(found, "key")
        .join(rules, "key")
        .select(
            "key", "row_count", "previous", F.array_join("problems", ",").alias("problems"),
            F.array_join("violations", ",").alias("broken"),
        )
    )


@check(
    "page_after_key",
    """WITH k AS (SELECT first_seen_at AS seen, listing_id AS id FROM {stored}
      WHERE listing_id = (SELECT median_id FROM (SELECT quantile_disc(listing_id, 0.5) AS median_id FROM {stored})))
    SELECT s.* FROM {stored} s, k WHERE s.first_seen_at < seen OR (s.first_seen_at = seen AND listing_id < id)
    ORDER BY first_seen_at DESC, listing_id DESC LIMIT 50""",
)
def _(spark, sf):
    # The page behind a row in the middle, from files sorted by the order.
    base, order = place(spark), [("first_seen_at", True), ("listing_id", True)]
    O.write_ordered(read(spark, sf, "stored"), base, order)
    listings = spark.read.parquet(base)
    nth = (listings.count() + 1) // 2
    middle = O.with_rank(listings.select("listing_id"), [F.col("listing_id")]).filter(F.col("rank") == nth).first()[0]
    key = listings.filter(F.col("listing_id") == middle).select("first_seen_at", "listing_id").first()
    return O.page_after(listings, order, key.asDict(), 50)


@check(
    "damaged_buckets",
    """WITH b AS (SELECT substr(md5(listing_id), 1, 2) AS node, listing_id, company FROM {stored}),
    hurt AS (SELECT DISTINCT node FROM b WHERE company = (SELECT min(company) FROM b))
    SELECT node, count(*) AS expected_rows, count(*) AS actual_rows FROM b JOIN hurt USING (node) GROUP BY node""",
)
def _(spark, sf):
    # One company's links are lost after the snapshot; the trees tell in which buckets.
    base, listings = place(spark), read(spark, sf, "stored")
    first = listings.agg(F.min("company")).first()[0]
    hurt = listings.withColumn("link", F.when(F.col("company") != first, F.col("link")))
    for name, table in (("expected", listings), ("actual", hurt)):
        snapshots.write_tree(snapshots.digest_tree(table, "listing_id"), f"{base}/{name}")
    return snapshots.damaged_buckets(spark, f"{base}/expected", f"{base}/actual")
