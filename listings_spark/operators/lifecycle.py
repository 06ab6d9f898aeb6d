"""Lifecycle merge: observations, unavailability evidence and audits folded into state.

A commit log has one row per (run_seq, listing_id) after `collapse_log`:
`run_seq, kind, search_slug, listing_id, run_id, observed_at, posted_at` and the listing
fields. `kind` is observed, unavailable, audit_available or audit_unavailable; audits carry no
search. Commit order (`run_seq`) decides which value is latest; event time (`observed_at`)
only feeds the monotonic `last_seen_at`.

Scale: `collapse_log` leaves a listing at most one row per commit however many raw rows it had,
combined on the map side or, where the number of raw rows is known, in tasks of bounded size.
Everything after it is partitioned by listing: one shuffle of the collapsed log and one of the
state; all windows and aggregates reuse it. Listings with very many commits in a slice are cut into
blocks that fold apart (`histories`), and `replay` cuts long logs into slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listings_spark import constants as K
from listings_spark.operators import histories
from listings_spark.sources.session import ensure_checkpoint_dir

FIELDS = ("company", "title", "location", "link", "category", "employment_type")
OPTIONAL = ("industries", "start_date")
LISTING_COLUMNS = (
    "listing_id", "company", "title", "location", "link", "category", "industries",
    "employment_type", "start_date", "first_seen_at", "last_seen_at", "updated_at", "status",
)
PROVENANCE_COLUMNS = (
    "search_slug", "listing_id", "first_seen_at", "last_seen_at", "last_seen_run_id",
    "unavailable_confirmations", "active",
)
COMMITS_PER_SLICE = 20_000
ROWS_PER_TASK = 50_000  # events that one task of a fold sorts and holds
RAW_PER_TASK = 200_000  # raw rows that one task of a collapse sorts


def _tasks(log: DataFrame, rows: int, most: int) -> int:
    """Tasks that take at most about `most` of these rows each, and one for each core at least."""
    return max(log.sparkSession.sparkContext.defaultParallelism, -(-rows // most))


def collapse_log(log: DataFrame, position: str = "pos", rows: int | None = None) -> DataFrame:
    """One row per commit and listing; the last row of the commit wins.

    A collapse sorts whole raw rows. With `rows`, the number that the log has at most, they are
    shuffled once by commit and listing into tasks of bounded size. Without it they are combined
    where they are read and then by the session's shuffle partitions, tasks that grow with the log.
    """
    if rows is not None:
        log = log.repartition(_tasks(log, rows, RAW_PER_TASK), "run_seq", "listing_id")
    rest = [c for c in log.columns if c not in ("run_seq", "listing_id", position)]
    latest = F.max(F.struct(F.col(position), *[F.col(c) for c in rest])).alias("_latest")
    return (
        log.groupBy("run_seq", "listing_id")
        .agg(latest)
        .select("run_seq", "listing_id", *[F.col(f"_latest.{c}").alias(c) for c in rest])
    )


def committed_only(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Log rows of failed searches change nothing; audits have no run and pass."""
    failed = runs.filter(F.col("status") != "success").select("run_seq")
    return log.join(failed, "run_seq", "left_anti")


def _log_events(log: DataFrame) -> DataFrame:
    """The log in fold form: no carried values."""
    return log.select(
        "listing_id", F.col("run_seq").cast("bigint").alias("run_seq"), "kind", "search_slug",
        "run_id", "observed_at", "posted_at", *FIELDS, *OPTIONAL,
        F.lit(0).alias("carried"), F.lit(None).cast("string").alias("carried_status"),
        F.lit(None).cast("timestamp_ntz").alias("carried_first"),
        F.lit(None).cast("timestamp_ntz").alias("carried_updated"),
        F.lit(None).cast("int").alias("carried_confirmations"),
    )


def _state_events(listings: DataFrame, provenance: DataFrame, threshold: int) -> DataFrame:
    """Existing state as events before the first commit."""
    none = F.lit(None)
    stored = listings.select(
        "listing_id", F.lit(-1).cast("bigint").alias("run_seq"),
        F.lit("state").alias("kind"), none.cast("string").alias("search_slug"),
        none.cast("string").alias("run_id"), F.col("last_seen_at").alias("observed_at"),
        none.cast("timestamp_ntz").alias("posted_at"), *FIELDS, *OPTIONAL,
        F.lit(0).alias("carried"), F.col("status").alias("carried_status"),
        F.col("first_seen_at").alias("carried_first"),
        F.col("updated_at").alias("carried_updated"),
        none.cast("int").alias("carried_confirmations"),
    )
    # Confirmations already counted; an active row is always short of the threshold.
    counted = F.when(
        F.col("active"), F.least("unavailable_confirmations", F.lit(threshold - 1))
    ).otherwise(F.lit(threshold))
    linked = provenance.select(
        "listing_id", F.lit(-1).cast("bigint").alias("run_seq"), F.lit("link").alias("kind"),
        "search_slug", F.col("last_seen_run_id").alias("run_id"),
        F.col("last_seen_at").alias("observed_at"), none.cast("timestamp_ntz").alias("posted_at"),
        *[none.cast("string").alias(c) for c in (*FIELDS, *OPTIONAL)],
        counted.cast("int").alias("carried"), none.cast("string").alias("carried_status"),
        F.col("first_seen_at").alias("carried_first"),
        none.cast("timestamp_ntz").alias("carried_updated"),
        F.col("unavailable_confirmations").cast("int").alias("carried_confirmations"),
    )
    return stored.unionByName(linked)


def _parts(blocks: bool) -> list[str]:
    """What a fold is partitioned by."""
    return ["listing_id", "block"] if blocks else ["listing_id"]


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def _fold_tasks(log: DataFrame, provenance: DataFrame | None, rows: int | None = None) -> int:
    """Tasks of a fold: so many that each has a bounded number of events.

    A fold sorts its events for several windows in one task, which takes many times the bytes that
    they are shuffled in; Spark would size tasks by those bytes.
    """
    rows = log.count() if rows is None else rows
    rows += 0 if provenance is None else provenance.count()
    return _tasks(log, rows, ROWS_PER_TASK)


def stored(folded: DataFrame) -> DataFrame:
    """A fold written once to the shared checkpoint folder; its readers take as many tasks as it had.

    A stored fold is no longer known to lie by listing, so every reader shuffles what it needs.
    """
    ensure_checkpoint_dir(folded.sparkSession)
    held = folded.checkpoint()
    return held.repartition(max(1, held.rdd.getNumPartitions()), *_parts("block" in held.columns))


def fold(
    log: DataFrame,
    listings: DataFrame | None = None,
    provenance: DataFrame | None = None,
    threshold: int = K.CLOSURE_CONFIRMATIONS,
    long: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Every event of a collapsed log with the state around it.

    `long` names the blocks of long histories (`histories.long_histories`); without it a
    listing's events are folded in one task. The log and the links are counted first, to size tasks;
    pass stored ones where making them is costly, or the `rows` that the log has at most. Adds the incarnation of the listing (a deletion starts a new one), whether the event
    is effective, and the flags is_new, is_changed, is_reopened, is_closed, is_deleted.
    """
    if not 1 <= threshold <= 10:
        raise ValueError("the confirmation threshold lies between 1 and 10")
    events = _log_events(log)
    if listings is not None:
        events = events.unionByName(_state_events(listings, provenance, threshold))
    by = _parts(long is not None)
    if long is not None:
        events = histories.in_blocks(events, long, FIELDS, OPTIONAL, threshold)
    events = events.repartition(_fold_tasks(log, provenance, rows), *by)

    kind = F.col("kind")
    observed, stored, linked = kind == "observed", kind == "state", kind == "link"
    missing, audit_ok = kind == "unavailable", kind == "audit_available"
    deletes = kind == "audit_unavailable"
    before = (Window.unboundedPreceding, -1)
    upto = (Window.unboundedPreceding, Window.currentRow)

    in_order = Window.partitionBy(*by).orderBy("run_seq")
    events = events.withColumn(
        "incarnation", F.coalesce(_count(deletes).over(in_order.rowsBetween(*before)), F.lit(0))
    ).withColumn(
        "epoch", F.coalesce(_count(audit_ok).over(in_order.rowsBetween(*before)), F.lit(0))
    )

    # Per search and listing: confirmations since the last reset. A successful audit resets
    # every pair of its listing, so counting starts again in each epoch.
    pair = Window.partitionBy(*by, "incarnation", "search_slug").orderBy("run_seq")
    events = events.withColumn(
        "_linked",
        F.coalesce(F.max(observed | linked).over(pair.rowsBetween(*before)), F.lit(False)),
    )
    weight = F.when(missing & F.col("_linked"), 1).when(linked, F.col("carried")).otherwise(0)
    spell = Window.partitionBy(*by, "incarnation", "search_slug", "epoch").orderBy(
        "run_seq"
    )
    events = events.withColumn("_weight", weight).withColumn(
        "_counted", F.sum("_weight").over(spell.rowsBetween(*upto))
    )
    base = F.max(F.when(observed, F.col("_counted"))).over(spell.rowsBetween(*before))
    events = events.withColumn(
        "_before", F.col("_counted") - F.col("_weight") - F.coalesce(base, F.lit(0))
    )
    off = F.when(missing & F.col("_linked") & (F.col("_before") == threshold - 1), 1).when(
        linked & (F.col("carried") >= threshold), 1
    )
    on = F.when(observed & F.col("_linked") & (F.col("_before") >= threshold), 1)
    events = events.withColumn("_off", F.coalesce(off, F.lit(0))).withColumn(
        "_on", F.coalesce(on, F.lit(0))
    )
    events = events.withColumn(
        "_joins", F.when((observed & ~F.col("_linked")) | linked, 1).otherwise(0)
    )

    # Per listing: how many pairs exist and how many of them are switched off.
    life = Window.partitionBy(*by, "incarnation").orderBy("run_seq")
    era = Window.partitionBy(*by, "incarnation", "epoch").orderBy("run_seq")
    pairs = F.coalesce(F.sum("_joins").over(life.rowsBetween(*before)), F.lit(0))
    switched = F.coalesce(
        F.sum(F.col("_off") - F.col("_on")).over(era.rowsBetween(*before)), F.lit(0)
    )
    carried_status = F.max("carried_status").over(life.rowsBetween(*before))
    exists = F.coalesce(F.max(observed | stored).over(life.rowsBetween(*before)), F.lit(False))
    payload = F.when(observed | stored, F.struct(*FIELDS))
    previous = F.last(payload, ignorenulls=True).over(life.rowsBetween(*before))
    events = (
        events.withColumn("_pairs", pairs)
        .withColumn("_active", F.col("_pairs") - switched)
        .withColumn("_exists", exists)
        .withColumn("_previous", previous)
    )
    for name in OPTIONAL:
        value = F.when(observed | stored, F.nullif(F.col(name), F.lit("")))
        events = events.withColumn(
            f"_previous_{name}", F.last(value, ignorenulls=True).over(life.rowsBetween(*before))
        )
    events = events.withColumn(
        "_was_closed",
        F.col("_exists")
        & F.when(F.col("_pairs") > 0, F.col("_active") == 0).otherwise(
            F.coalesce(carried_status == "closed", F.lit(False))
        ),
    )
    differs = ~F.struct(*FIELDS).eqNullSafe(F.col("_previous"))
    for name in OPTIONAL:
        value = F.nullif(F.col(name), F.lit(""))
        differs = differs | (
            value.isNotNull() & ~value.eqNullSafe(F.col(f"_previous_{name}"))
        )
    exists_now = F.col("_exists")
    seen = F.when(observed | stored | (audit_ok & exists_now), F.col("observed_at"))
    return (
        events.withColumn("is_new", observed & ~exists_now)
        .withColumn("is_changed", observed & exists_now & differs)
        .withColumn("is_reopened", (observed | audit_ok) & F.col("_was_closed"))
        .withColumn("is_closed", missing & (F.col("_off") == 1) & (F.col("_active") == 1))
        .withColumn("is_deleted", deletes & exists_now)
        .withColumn("_effective_time", F.max(seen).over(life.rowsBetween(*upto)))
        .withColumn(
            "_deletions",
            _count(deletes).over(Window.partitionBy(*by)),
        )
    )


def _surviving(folded: DataFrame) -> DataFrame:
    """Events of the latest incarnation of each listing."""
    return folded.filter(F.col("incarnation") == F.col("_deletions"))


def listings_from(folded: DataFrame) -> DataFrame:
    """Current listings after a fold."""
    kind = F.col("kind")
    content = kind.isin("observed", "state")
    sets = F.when(
        kind == "state", F.col("carried_updated")
    ).when(
        (kind == "observed") & (F.col("is_new") | F.col("is_changed") | F.col("is_reopened")),
        F.col("_effective_time"),
    )
    raises = F.when(F.col("is_closed"), F.col("observed_at")).when(
        (kind == "audit_available") & F.col("is_reopened"), F.col("_effective_time")
    )
    blocks = "block" in folded.columns
    by = _parts(blocks)
    whole = Window.partitionBy(*by, "incarnation")
    rows = (
        _surviving(folded)
        .withColumn("_sets", sets)
        .withColumn("_raises", raises)
        .withColumn("_last_set", F.max(F.when(sets.isNotNull(), F.col("run_seq"))).over(whole))
    )
    order = F.col("run_seq")
    optional = [
        F.max_by(
            F.nullif(F.col(c), F.lit("")),
            F.when(content & (F.nullif(F.col(c), F.lit("")).isNotNull()), order),
        ).alias(c)
        for c in OPTIONAL
    ]
    birth = F.when(
        kind == "observed",
        F.least(F.coalesce("posted_at", "observed_at"), F.col("observed_at")),
    ).when(kind == "state", F.col("carried_first"))
    # After the last event of a listing: pairs that exist minus pairs switched off in the
    # last epoch.
    in_last = F.when(
        (F.col("epoch") + F.when(kind == "audit_available", 1).otherwise(0))
        == F.col("_last_epoch"),
        F.col("_off") - F.col("_on"),
    )
    rows = rows.withColumn(
        "_last_epoch",
        F.max(F.col("epoch") + F.when(kind == "audit_available", 1).otherwise(0)).over(whole),
    )
    found = (
        rows.groupBy(*by)
        .agg(
            *([F.max("last_block").alias("_last_block")] if blocks else []),
            F.max_by(F.struct(*FIELDS), F.when(content, order)).alias("_fields"),
            *optional,
            F.min_by(birth, F.when(content, order)).alias("first_seen_at"),
            F.max("_effective_time").alias("last_seen_at"),
            F.max_by("_sets", F.when(F.col("_sets").isNotNull(), order)).alias("_set"),
            F.max(F.when(order > F.coalesce("_last_set", F.lit(-2)), F.col("_raises"))).alias("_raised"),
            F.max("carried_status").alias("_carried"),
            F.bool_or(kind == "audit_available").alias("_audited"),
            F.sum("_joins").alias("_pairs"),
            F.coalesce(F.sum(in_last), F.lit(0)).alias("_off"),
        )
    )
    updated = F.greatest("_set", "_raised")
    if blocks:
        # Blocks in order: the last one that set a time, and the times that raised it since.
        found = found.groupBy("listing_id").agg(
            F.max_by(F.struct(*[c for c in found.columns if c not in ("listing_id", "_set", "_raised")]), "block").alias("_end"),
            F.sort_array(F.collect_list(F.struct("block", "_set", "_raised"))).alias("_times"),
        ).select("listing_id", "_end.*", "_times").filter("block = _last_block")
        updated = F.aggregate(
            "_times", F.lit(None).cast("timestamp_ntz"),
            lambda held, x: F.greatest(F.coalesce(x["_set"], held), x["_raised"]),
        )
    return (
        found.withColumn("updated_at", updated)
        .filter(F.col("_fields").isNotNull())
        .withColumn(
            "status",
            F.when(
                F.col("_pairs") > 0,
                F.when(F.col("_pairs") > F.col("_off"), "open").otherwise("closed"),
            )
            .when(F.col("_audited"), "open")
            .otherwise(F.coalesce("_carried", F.lit("open"))),
        )
        .select("listing_id", "_fields.*", *OPTIONAL, "first_seen_at", "last_seen_at",
                "updated_at", "status")
        .select(*LISTING_COLUMNS)
    )


def provenance_from(folded: DataFrame, threshold: int = K.CLOSURE_CONFIRMATIONS) -> DataFrame:
    """Current search-to-listing links after a fold."""
    kind = F.col("kind")
    seen = kind.isin("observed", "link")
    order = F.col("run_seq")
    by = _parts("block" in folded.columns)
    if len(by) > 1:
        folded = folded.filter("block = last_block")
    whole = Window.partitionBy(*by, "incarnation")
    rows = (
        _surviving(folded)
        .withColumn(
            "_last_epoch",
            F.max(F.col("epoch") + F.when(kind == "audit_available", 1).otherwise(0)).over(whole),
        )
        .filter(F.col("search_slug").isNotNull())
    )
    # Counting in the last epoch only: reset at the last observation there, if any.
    in_last = F.col("epoch") == F.col("_last_epoch")
    after = F.when(in_last, F.col("_counted"))
    return (
        rows.groupBy(*by, "search_slug")
        .agg(
            F.min_by(
                F.coalesce("carried_first", "observed_at"), F.when(seen, order)
            ).alias("first_seen_at"),
            F.max(F.when(seen, F.col("observed_at"))).alias("last_seen_at"),
            F.max_by("run_id", F.when(seen, order)).alias("last_seen_run_id"),
            F.coalesce(F.max(after), F.lit(0)).alias("_counted"),
            F.max(F.when(in_last & (kind == "observed"), F.col("_counted"))).alias("_base"),
            F.max(F.when(in_last & (kind == "link"), F.col("carried"))).alias("_carried"),
            F.max(
                F.when(in_last & (kind == "link"), F.col("carried_confirmations"))
            ).alias("_stored"),
        )
        .filter(F.col("last_seen_run_id").isNotNull())
        .withColumn("_count", F.col("_counted") - F.coalesce("_base", F.lit(0)))
        .withColumn(
            "unavailable_confirmations",
            (
                F.least("_count", F.lit(threshold))
                # A carried count may exceed the threshold of this merge; keep it exact.
                + F.when(
                    F.col("_base").isNull() & F.col("_carried").isNotNull(),
                    F.col("_stored") - F.col("_carried"),
                ).otherwise(0)
            ).cast("int"),
        )
        .withColumn("active", F.col("_count") < threshold)
        .select(*PROVENANCE_COLUMNS)
    )


def counters_from(folded: DataFrame) -> DataFrame:
    """New, updated, closed, reopened and deleted listings per commit."""
    return (
        folded.filter(F.col("run_seq") >= 0)
        .groupBy("run_seq")
        .agg(
            _count(F.col("is_new")).alias("new_count"),
            _count(F.col("is_changed")).alias("updated_count"),
            _count(F.col("is_closed")).alias("closed_count"),
            _count(F.col("is_reopened")).alias("reopened_count"),
            _count(F.col("is_deleted")).alias("deleted_count"),
        )
    )


def confirmation_trail(folded: DataFrame, threshold: int = K.CLOSURE_CONFIRMATIONS) -> DataFrame:
    """Each effective unavailability with the confirmations it leads to."""
    return (
        folded.filter(
            (F.col("kind") == "unavailable") & F.col("_linked") & (F.col("_before") < threshold)
        )
        .select(
            "run_seq", "search_slug", "listing_id",
            (F.col("_before") + 1).alias("unavailable_confirmations"),
            (F.col("_before") + 1 < threshold).alias("active"),
            F.col("is_closed").alias("closes_listing"),
        )
    )


def merge(
    log: DataFrame,
    listings: DataFrame | None = None,
    provenance: DataFrame | None = None,
    threshold: int = K.CLOSURE_CONFIRMATIONS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New listings, new provenance and per-commit counters for one slice of commits.

    All three read one fold, which is written once to the shared checkpoint folder.
    """
    long = histories.long_histories(log)
    folded = stored(fold(log, listings, provenance, threshold, long))
    return listings_from(folded), provenance_from(folded, threshold), counters_from(folded)


def replay(
    log: DataFrame,
    first_seq: int,
    last_seq: int,
    listings: DataFrame | None = None,
    provenance: DataFrame | None = None,
    threshold: int = K.CLOSURE_CONFIRMATIONS,
    commits_per_slice: int = COMMITS_PER_SLICE,
) -> tuple[DataFrame, DataFrame]:
    """Fold a long history slice by slice, so no listing ever holds more rows than a slice
    has commits. State between slices is checkpointed in the shared folder. Commits outside the
    given bounds fail the replay."""
    ensure_checkpoint_dir(log.sparkSession)
    outside = log.filter(~F.col("run_seq").between(first_seq, last_seq)).select("run_seq").head(1)
    if outside:
        raise ValueError(f"commit {outside[0][0]} is outside {first_seq} to {last_seq}")
    for start in range(first_seq, last_seq + 1, commits_per_slice):
        part = log.filter(F.col("run_seq").between(start, start + commits_per_slice - 1))
        listings, provenance, _ = merge(part, listings, provenance, threshold)
        listings, provenance = listings.checkpoint(), provenance.checkpoint()
    return listings, provenance


def listing_status(provenance: DataFrame) -> DataFrame:
    """A listing is open while any of its searches still holds it active."""
    return provenance.groupBy("listing_id").agg(
        F.when(F.bool_or("active"), "open").otherwise("closed").alias("status"),
        _count(F.col("active")).alias("active_searches"),
    )


def closable(provenance: DataFrame, affected: DataFrame) -> DataFrame:
    """Affected listings that no search holds active any more."""
    held = provenance.filter("active").select("listing_id")
    return affected.select("listing_id").distinct().join(held, "listing_id", "left_anti")


def known_listings(listings: DataFrame, provenance: DataFrame) -> DataFrame:
    """Listings each search still holds active, for all searches at once."""
    held = provenance.filter("active").select("search_slug", "listing_id")
    return held.join(
        listings.select("listing_id", "company", "title", "location", "link"), "listing_id"
    ).select("search_slug", "listing_id", "company", "title", "location", "link")


def delete_searches(
    provenance: DataFrame, runs: DataFrame, searches: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Cascade of removed searches: their links and runs go too."""
    keep = searches.select(F.col("slug").alias("search_slug"))
    return (
        provenance.join(keep, "search_slug", "left_semi"),
        runs.join(keep, "search_slug", "left_semi"),
    )


def evolve(table: DataFrame, add=None, drop=(), backfill=None) -> DataFrame:
    """Next schema version: new nullable columns, dropped columns, constants for nulls."""
    out = table.drop(*drop)
    for name, kind in (add or {}).items():
        out = out.withColumn(name, F.lit(None).cast(kind))
    for name, value in (backfill or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out
