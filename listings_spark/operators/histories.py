"""Long histories of one listing: blocks of commits that are summed up, carried and folded apart.

A run of commits acts on a listing's state by an associative summary: fields overwrite unless
null, times take their maximum, confirmations count on from the last reset, and a deletion starts
anew. So a history of any length is cut into blocks; the summaries of the blocks before give the
state that a block starts from, as the same state and link events that a stored state gives; and
every block is then folded by itself, in its own task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listings_spark import constants as K
from listings_spark.operators.ordering import with_rank
from listings_spark.sources.session import ensure_checkpoint_dir

BLOCK = 20_000  # commits of one listing folded together
SMALL = 100_000  # rows up to which a table of long histories is sent to all tasks


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def long_histories(log: DataFrame, block: int = BLOCK) -> DataFrame | None:
    """(listing_id, run_seq, block, last_block) of listings with more than `block` commits, if any.

    Commits are numbered by ranges of the whole order, so no task gets a whole history. Only
    ids and commit numbers of long histories move.
    """
    ensure_checkpoint_dir(log.sparkSession)
    often = (
        log.groupBy("listing_id").agg(F.count("*").alias("commits")).filter(F.col("commits") > block).checkpoint()
    )
    n = often.count()
    if not n:
        return None
    events = log.select("listing_id", "run_seq").join(_bounded(often, n), "listing_id")
    ranked = with_rank(events, [F.col("listing_id"), F.col("run_seq")], "_rank")
    firsts = ranked.groupBy("listing_id").agg(F.min("_rank").alias("_first")).checkpoint()
    return (
        ranked.join(_bounded(firsts, n), "listing_id")
        .select(
            "listing_id", F.col("run_seq").cast("bigint").alias("run_seq"),
            F.floor((F.col("_rank") - F.col("_first")) / block).cast("int").alias("block"),
            F.floor((F.col("commits") - 1) / block).cast("int").alias("last_block"),
        )
        .checkpoint()
    )


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _after(value: Column, order: Column, when: Column) -> Column:
    return F.max_by(value, F.when(when, order))


def in_blocks(
    events: DataFrame, long: DataFrame, fields: tuple[str, ...], optional: tuple[str, ...],
    threshold: int = K.CLOSURE_CONFIRMATIONS,
) -> DataFrame:
    """Fold events with their block, and for later blocks the state and links they start from.

    Listings without a long history are one block. Events of stored state stand in the first.
    """
    ids = long.select("listing_id").distinct().checkpoint()
    some = _bounded(ids, ids.count())
    short = events.join(some, "listing_id", "left_anti").withColumns(
        {"block": F.lit(0), "last_block": F.lit(0)}
    )
    last = long.groupBy("listing_id").agg(F.max("last_block").alias("last_block"))
    carried = events.filter("run_seq < 0").join(last, "listing_id").withColumn("block", F.lit(0))
    placed = events.filter("run_seq >= 0").join(long, ["listing_id", "run_seq"])
    placed = placed.unionByName(carried).checkpoint()
    return short.unionByName(placed).unionByName(_starts(placed, fields, optional, threshold))


def _starts(
    placed: DataFrame, fields: tuple[str, ...], optional: tuple[str, ...], threshold: int
) -> DataFrame:
    """State and link events that each block after the first starts from."""
    kind = F.col("kind")
    content, seen = kind.isin("observed", "state"), kind.isin("observed", "link")
    order = F.col("run_seq")
    deletes, audits = kind == "audit_unavailable", kind == "audit_available"

    # Deletions and audits before each block, then before each event.
    count = lambda c: F.count_if(c)
    by_block = placed.groupBy("listing_id", "block", "last_block").agg(
        count(deletes).alias("_d"), count(audits).alias("_a")
    )
    earlier = Window.partitionBy("listing_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bounds = by_block.select(
        "listing_id", "block", "last_block",
        F.coalesce(F.sum("_d").over(earlier), F.lit(0)).alias("_inc"),
        F.coalesce(F.sum("_a").over(earlier), F.lit(0)).alias("_epoch"),
    ).checkpoint()
    inside = Window.partitionBy("listing_id", "block").orderBy("run_seq").rowsBetween(Window.unboundedPreceding, -1)
    here = placed.drop("last_block").join(bounds.drop("last_block"), ["listing_id", "block"]).withColumns({
        "inc": F.col("_inc") + F.coalesce(F.count_if(deletes).over(inside), F.lit(0)),
        "epoch": F.col("_epoch") + F.coalesce(F.count_if(audits).over(inside), F.lit(0)),
    }).drop("_inc", "_epoch")
    born = here.filter(content).groupBy("listing_id", "inc").agg(F.min("run_seq").alias("born"))
    here = here.join(born, ["listing_id", "inc"], "left").checkpoint()

    # The listing: one summary for each block of an incarnation, and what all before it come to.
    lives = F.coalesce(order > F.col("born"), F.lit(False))
    blank = {c: F.nullif(F.col(c), F.lit("")) for c in optional}
    birth = F.when(
        kind == "observed", F.least(F.coalesce("posted_at", "observed_at"), F.col("observed_at"))
    ).when(kind == "state", F.col("carried_first"))
    summary = here.groupBy("listing_id", "inc", "block").agg(
        _after(F.struct(*fields), order, content).alias("_fields"),
        *[_after(blank[c], order, content & blank[c].isNotNull()).alias(c) for c in optional],
        F.min_by(birth, F.when(content, order)).alias("_birth"),
        F.max(F.when(content | (audits & lives), F.col("observed_at"))).alias("_seen"),
        F.max("carried_status").alias("_status"),
        F.bool_or(audits & lives).alias("_audited"),
    )
    before = Window.partitionBy("listing_id", "inc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = (
        summary.select(
            "listing_id", "inc", "block",
            F.last("_fields", ignorenulls=True).over(before).alias("_fields"),
            *[F.last(c, ignorenulls=True).over(before).alias(c) for c in optional],
            F.first("_birth", ignorenulls=True).over(before).alias("carried_first"),
            F.max("_seen").over(before).alias("observed_at"),
            F.max("_status").over(before).alias("_status"),
            F.coalesce(F.max("_audited").over(before), F.lit(False)).alias("_audited"),
        )
        .join(bounds, ["listing_id", "block"])
        .filter((F.col("block") > 0) & (F.col("inc") == F.col("_inc")) & F.col("_fields").isNotNull())
        .select(
            "listing_id", F.lit(-1).cast("bigint").alias("run_seq"), F.lit("state").alias("kind"),
            _none("string").alias("search_slug"), _none("string").alias("run_id"), "observed_at",
            _none("timestamp_ntz").alias("posted_at"), "_fields.*", *optional, F.lit(0).alias("carried"),
            F.when(F.col("_audited"), "open").otherwise(F.col("_status")).alias("carried_status"),
            "carried_first", _none("timestamp_ntz").alias("carried_updated"),
            _none("int").alias("carried_confirmations"), "block", "last_block",
        )
    )

    # Its links: a summary for each block and epoch, and a question at the start of each block.
    pairs = here.filter(F.col("search_slug").isNotNull())
    since = pairs.filter(seen).groupBy("listing_id", "inc", "search_slug").agg(F.min("run_seq").alias("since"))
    since = since.checkpoint()
    linked = pairs.join(since, ["listing_id", "inc", "search_slug"]).filter(order >= F.col("since"))
    latest = Window.partitionBy("listing_id", "inc", "search_slug", "epoch", "block")
    linked = linked.withColumn("_last", F.max(F.when(kind == "observed", order)).over(latest))
    missing = kind == "unavailable"
    told = linked.groupBy("listing_id", "inc", "search_slug", "epoch", "block").agg(
        F.min_by(F.coalesce("carried_first", "observed_at"), F.when(seen, order)).alias("_first"),
        F.max(F.when(seen, F.col("observed_at"))).alias("_seen"),
        _after(F.col("run_id"), order, seen).alias("_run"),
        F.count_if(missing).alias("_all"),
        F.when(F.max("_last").isNotNull(), F.count_if(missing & (order > F.col("_last")))).alias("_rest"),
        F.max(F.when(kind == "link", F.col("carried"))).alias("_carried"),
        F.max(F.when(kind == "link", F.col("carried_confirmations"))).alias("_stored"),
        F.lit(1).alias("_told"),
    )
    asked = (
        bounds.filter("block > 0").withColumnsRenamed({"_inc": "inc", "_epoch": "epoch"})
        .join(since, ["listing_id", "inc"])
        .select("listing_id", "inc", "search_slug", "epoch", "block", F.lit(0).alias("_told"))
    )
    rows = told.unionByName(asked, allowMissingColumns=True)
    life = Window.partitionBy("listing_id", "inc", "search_slug").orderBy("block", "_told", "epoch").rowsBetween(
        Window.unboundedPreceding, -1
    )
    era = Window.partitionBy("listing_id", "inc", "search_slug", "epoch").orderBy("block", "_told")
    upto, past = era.rowsBetween(Window.unboundedPreceding, 0), era.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(
        "_reset", F.when(F.col("_rest").isNotNull(), F.sum("_all").over(upto) - F.col("_rest"))
    )
    reset = F.last("_reset", ignorenulls=True).over(past)
    kept = F.when(reset.isNull(), F.coalesce(F.max("_carried").over(past), F.lit(0))).otherwise(0)
    extra = F.when(
        reset.isNull(), F.coalesce(F.max("_stored").over(past) - F.max("_carried").over(past), F.lit(0))
    ).otherwise(0)
    links = (
        rows.select(
            "listing_id", "search_slug", "block", "_told",
            F.first("_first", ignorenulls=True).over(life).alias("carried_first"),
            F.max("_seen").over(life).alias("observed_at"),
            F.last("_run", ignorenulls=True).over(life).alias("run_id"),
            F.least(
                F.coalesce(F.sum("_all").over(past), F.lit(0)) - F.coalesce(reset, F.lit(0)) + kept,
                F.lit(threshold),
            ).cast("int").alias("carried"),
            extra.cast("int").alias("_extra"),
        )
        .filter((F.col("_told") == 0) & F.col("run_id").isNotNull())
        .join(bounds.select("listing_id", "block", "last_block"), ["listing_id", "block"])
        .select(
            "listing_id", F.lit(-1).cast("bigint").alias("run_seq"), F.lit("link").alias("kind"),
            "search_slug", "run_id", "observed_at", _none("timestamp_ntz").alias("posted_at"),
            *[_none("string").alias(c) for c in (*fields, *optional)],
            "carried", _none("string").alias("carried_status"), "carried_first",
            _none("timestamp_ntz").alias("carried_updated"),
            (F.col("carried") + F.col("_extra")).alias("carried_confirmations"), "block", "last_block",
        )
    )
    return states.unionByName(links)
