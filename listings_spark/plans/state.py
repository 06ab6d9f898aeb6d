"""Merging a slice of commits or an audit into published state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listings_spark import constants as K
from listings_spark.operators import audit as U
from listings_spark.operators import histories
from listings_spark.operators import lifecycle as L
from listings_spark.operators import quality as Q
from listings_spark.sources import tables
from listings_spark.sources.runlog import new_commits
from listings_spark.sources.session import ensure_checkpoint_dir

STATE = ("listings", "provenance")
KEYS = {"listings": ["listing_id"], "provenance": ["search_slug", "listing_id"]}
RULES = {"listings": Q.stored_listing_rules, "provenance": Q.provenance_rules}
BUCKETS = 64  # of a new state; large states take more, so that a bucket stays a few tasks' work


class LateCommit(ValueError):
    """A commit that is older than one already merged; merging it would undo the newer one."""


class AuditConflict(ValueError):
    """An audit that calls one listing both available and unavailable."""


# Files sorted by status and id let readers skip closed listings and look ids up.
LAYOUT = {"listings": ("status", "listing_id"), "provenance": ("search_slug", "listing_id")}


def merge_state(
    log: DataFrame, listings: DataFrame, provenance: DataFrame,
    threshold: int = K.CLOSURE_CONFIRMATIONS,
) -> tuple[DataFrame, DataFrame]:
    """State after a slice; listings the slice does not mention pass through untouched.

    Only mentioned listings are shuffled into the fold. When the slice's ids are small enough
    for Spark to broadcast, the untouched state is not shuffled at all. Columns that the state has
    besides those of the merge stay with their rows; a deletion ends them.
    """
    touched = log.select("listing_id").distinct()
    folded = L.fold(
        log,
        listings.join(touched, "listing_id", "left_semi"),
        provenance.join(touched, "listing_id", "left_semi"),
        threshold,
        histories.long_histories(log),
    )
    # Both results read the fold; it is written once instead of being computed twice.
    ensure_checkpoint_dir(log.sparkSession)
    folded = folded.checkpoint()
    gone = log.filter("kind = 'audit_unavailable'").select("listing_id").distinct()
    merged = {"listings": L.listings_from(folded), "provenance": L.provenance_from(folded, threshold)}
    out = []
    for (name, new), old in zip(merged.items(), (listings, provenance), strict=True):
        own = [c for c in old.columns if c not in new.columns]
        if own:
            kept = old.select(*KEYS[name], *own).join(gone, "listing_id", "left_anti")
            new = new.join(kept, KEYS[name], "left")
        out.append(new.select(*old.columns).unionByName(old.join(touched, "listing_id", "left_anti")))
    return out[0], out[1]


def _empty(spark: SparkSession) -> dict[str, DataFrame]:
    text = "string"
    listing = ", ".join(
        f"{c} {'timestamp_ntz' if c.endswith('_at') else text}" for c in L.LISTING_COLUMNS
    )
    link = (
        "search_slug string, listing_id string, first_seen_at timestamp_ntz,"
        " last_seen_at timestamp_ntz, last_seen_run_id string,"
        " unavailable_confirmations int, active boolean"
    )
    schemas = {"listings": listing, "provenance": link, "commits": "run_seq bigint"}
    return {name: spark.createDataFrame([], schema) for name, schema in schemas.items()}


def load_state(
    spark: SparkSession, base: str, only: list[int] | None = None
) -> dict[str, DataFrame]:
    """Published state, or some of its buckets; empty tables before the first publication."""
    return _held(spark, base, tables.manifest(spark, base), only)


def _held(
    spark: SparkSession, base: str, now: dict, only: list[int] | None
) -> dict[str, DataFrame]:
    empty = _empty(spark)
    state = {name: tables.read_buckets(spark, base, name, now, only) for name in STATE}
    state["commits"] = tables.read_whole(spark, base, "commits", now)
    return {name: empty[name] if df is None else df for name, df in state.items()}


def _buckets(spark: SparkSession, base: str, buckets: int) -> int:
    """Number of buckets of the state; it is fixed by the first publication."""
    return tables.manifest(spark, base).get("buckets", buckets)


def _touched(rows: DataFrame, buckets: int) -> list[int]:
    """Buckets of the listings in `rows`; at most `buckets` numbers reach the driver."""
    found = rows.select(tables.bucket_of("listing_id", buckets).alias("b")).distinct().collect()
    return sorted(r["b"] for r in found)


def _publish(
    listings: DataFrame, provenance: DataFrame, commits: DataFrame, base: str,
    touched: list[int], buckets: int, allowed: int = 0, **whole: DataFrame,
) -> int:
    """Publish the touched buckets and the narrow table of merged commits in one step.

    Rows that break a constraint go to the quarantine; more than `allowed` refuse the publication.
    """
    return tables.publish_buckets(
        {"listings": listings, "provenance": provenance}, base, "listing_id", touched, buckets,
        sort_by=LAYOUT, whole={"commits": commits, **whole},
        rules={name: rules() for name, rules in RULES.items()}, allowed=allowed,
    )


def evolve_state(
    spark: SparkSession, base: str, name: str, add=None, drop=(), backfill=None
) -> int:
    """Publish a table of the state with other columns (`lifecycle.evolve`).

    Added and dropped columns change the manifest only; a constant for nulls rewrites the table.
    """
    now = tables.manifest(spark, base)
    old = load_state(spark, base)[name]
    new = L.evolve(old, add, drop, backfill)
    buckets = now.get("buckets", BUCKETS)
    touched = list(range(buckets)) if backfill else []
    rows = new if backfill else new.limit(0)
    return tables.publish_buckets({name: rows}, base, "listing_id", touched, buckets, sort_by=LAYOUT)


def apply_log(
    log: DataFrame, base: str, threshold: int = K.CLOSURE_CONFIRMATIONS, buckets: int = BUCKETS,
    allowed: int = 0,
) -> int:
    """Merge new commits into published state; commits already merged are skipped.

    The merged commits are published with the state by the same pointer swap, so a rerun
    after a failure neither loses a commit nor counts a confirmation twice. A commit older than
    the newest merged one is refused before anything changes (`apply_in_order` holds such commits
    back instead). Only the buckets of listings that the commits mention are read and rewritten. A
    state with more than `allowed` rows that break a constraint is not published.
    """
    spark = log.sparkSession
    ensure_checkpoint_dir(spark)
    state = load_state(spark, base, only=[])
    fresh = L.collapse_log(new_commits(log, state["commits"])).checkpoint()
    newest = state["commits"].agg(F.max("run_seq")).first()[0]
    oldest = fresh.agg(F.min("run_seq")).first()[0]
    if newest is not None and oldest is not None and oldest < newest:
        raise LateCommit(f"commit {oldest} comes after commit {newest} was merged")
    return _merge(fresh, state["commits"], base, threshold, buckets, allowed)


def _merge(
    fresh: DataFrame, merged: DataFrame, base: str, threshold: int, buckets: int, allowed: int,
    **whole: DataFrame,
) -> int:
    spark = fresh.sparkSession
    buckets = _buckets(spark, base, buckets)
    touched = _touched(fresh, buckets)
    held = load_state(spark, base, only=touched)
    listings, provenance = merge_state(fresh, held["listings"], held["provenance"], threshold)
    commits = merged.unionByName(fresh.select("run_seq").distinct())
    return _publish(listings, provenance, commits, base, touched, buckets, allowed, **whole)


def apply_in_order(
    log: DataFrame, base: str, expected: DataFrame | None = None, delay: int = 0,
    threshold: int = K.CLOSURE_CONFIRMATIONS, buckets: int = BUCKETS, last: bool = False,
    allowed: int = 0,
) -> int:
    """Merge commits that arrive in any order, each once all commits before it are merged or lost.

    A commit waits in the state's `pending` table while one of the `expected` commits (run_seq)
    before it is missing. A missing commit is given up once one has arrived that is more than
    `delay` younger; without `expected`, every commit waits that long. `last` merges all that
    waits. A commit that comes after younger ones were merged goes to the `late` table and changes
    nothing. State, pending and late commits are published in one step, so replays are safe.
    """
    spark = log.sparkSession
    ensure_checkpoint_dir(spark)
    now = tables.manifest(spark, base)
    merged = load_state(spark, base, only=[])["commits"]
    waiting, late = (tables.read_whole(spark, base, name, now) for name in ("pending", "late"))
    arrived = L.collapse_log(log)
    known = merged if late is None else merged.unionByName(late.select("run_seq").distinct())
    # Commits that wait are stored with the state already; only new ones are stored here.
    if waiting is not None:
        known_here = known.unionByName(waiting.select("run_seq").distinct())
        arrived = new_commits(arrived, known_here).checkpoint().unionByName(waiting)
    else:
        arrived = new_commits(arrived, known).checkpoint()
    newest = merged.agg(F.max("run_seq")).first()[0]
    youngest = arrived.agg(F.max("run_seq")).first()[0]
    overdue = F.lit(False) if newest is None else F.col("run_seq") < newest
    lost = arrived.filter(overdue)
    open_ = arrived.filter(~overdue)
    bound = None if last or youngest is None else youngest - delay
    if bound is not None and expected is not None:
        # The first commit that is still awaited holds back all after it.
        have = known.unionByName(arrived.select("run_seq").distinct())
        awaited = expected.select("run_seq").filter(F.col("run_seq") >= bound)
        if newest is not None:
            awaited = awaited.filter(F.col("run_seq") > newest)
        gap = awaited.join(have, "run_seq", "left_anti").agg(F.min("run_seq")).first()[0]
        bound = gap
    ready = open_ if bound is None else open_.filter(F.col("run_seq") < bound)
    rest = open_.filter(F.lit(False)) if bound is None else open_.filter(F.col("run_seq") >= bound)
    late = lost if late is None else late.unionByName(lost)
    return _merge(ready, merged, base, threshold, buckets, allowed, pending=rest, late=late)


def late_commits(spark: SparkSession, base: str) -> DataFrame | None:
    """Commits that came after younger ones were merged; null before the first ordered merge."""
    return tables.read_whole(spark, base, "late", tables.manifest(spark, base))


def apply_audit(checks: DataFrame, base: str, observed_at, allowed: int = 0) -> DataFrame:
    """Audit the published state with page checks and publish the result.

    All outcomes are known before the one change. Listings checked several times count once; a
    listing with opposite outcomes refuses the whole audit. Returns the audit summary of the
    state as it was before.
    """
    spark = checks.sparkSession
    judged = U.outcomes(checks).select("listing_id", "outcome")
    opposite = U.conflicts(
        judged.filter("outcome = 'available'"), judged.filter("outcome = 'unavailable'")
    ).head(1)
    if opposite:
        raise AuditConflict(f"listing {opposite[0][0]} is both available and unavailable")
    proof = F.when(F.col("outcome") == "inconclusive", 1).otherwise(0)
    audited = judged.groupBy("listing_id").agg(
        F.min_by("outcome", proof).alias("outcome")
    ).withColumn("observed_at", observed_at)
    now = tables.manifest(spark, base)
    buckets = now.get("buckets", BUCKETS)
    touched = _touched(audited, buckets)
    held = _held(spark, base, now, touched)
    report = U.summary(held["listings"], audited)
    listings, provenance = U.apply_audit(held["listings"], held["provenance"], audited)
    _publish(listings, provenance, held["commits"], base, touched, buckets, allowed)
    return report


def audit_checks(listings: DataFrame, public: DataFrame, details: DataFrame) -> DataFrame:
    """Page facts per stored listing from fetched public and detail pages.

    `public` and `details` have (listing_id, http_status, html).
    """
    from listings_spark.sources import pages as P

    def parsed(pages: DataFrame, prefix: str) -> DataFrame:
        blank = F.lit(None).cast("string")
        rows = P.detail_records(
            pages.withColumns({
                "card_title": blank, "card_company": blank, "card_location": blank,
                "observed_at": F.lit(None).cast("timestamp_ntz"),
            })
        )
        readable = F.col("http_status") == 200
        blocked = F.coalesce(F.col("problem") == "blocked", F.lit(False))
        return rows.select(
            "listing_id",
            # A block page is no answer at all.
            F.when(readable & blocked, 0).otherwise(F.col("http_status")).alias(
                f"{prefix}_status"
            ),
            (readable & F.col("closed_notice")).alias(f"{prefix}_notice"),
            (readable & F.col("identity_ok")).alias(f"{prefix}_identity"),
        )

    shown = parsed(public, "public").select(
        "listing_id", "public_status", F.col("public_notice").alias("closed_notice")
    )
    detail = parsed(details, "detail").select(
        "listing_id", "detail_status", F.col("detail_identity").alias("identity_ok")
    )
    return (
        listings.select("listing_id")
        .join(shown, "listing_id", "left")
        .join(detail, "listing_id", "left")
    )
