"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listings_spark.llm.common import stored, uniform, word_count
from listings_spark.llm.prefix import prefix_sums

WEIGHTS = (5, 2, 1)
MOST = 3  # copies of a document, and targets as multiples of a source's size
SHORT_WORDS = 100  # shorter documents are half as likely to be taken
SHORT_ODDS = 0.5


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets of sources from (source, source_size): shares by weight, none above MOST sizes.

    Sources take the weights in turn, by code point, null last. Resharing the excess until no
    source is above its bound ends at min(MOST * size, level * weight) for one common level.
    Sources are filled in the order in which a rising level meets their bounds. One row per
    source is ordered in one task.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    ranked = sizes.withColumn("nth", F.row_number().over(place) - 1).withColumn(
        "weight", F.element_at(weights, (F.col("nth") % len(WEIGHTS) + 1).cast("int"))
    )
    fill = Window.orderBy(F.col("bound") / F.col("weight"), "nth")
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    filled = (
        ranked.withColumn("bound", (MOST * F.col("source_size")).cast("double"))
        .withColumn(
            "level",
            (F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(upto), F.lit(0.0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))),
        )
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("bound"))
    )
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(
        fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return filled.withColumn(
        "target",
        F.when(
            F.col("bound") > 0,
            F.least("bound", F.coalesce(level, F.lit(float("inf"))) * F.col("weight")),
        ).otherwise(F.lit(0.0)),
    ).select("source", "source_size", "target")


def expected_copies(classes: DataFrame) -> DataFrame:
    """Copies per document from (source, target, odds, class_size), none above MOST.

    Within a source copies go by odds, times one factor that meets the target; classes that
    the factor lifts above MOST stay there and the rest share what is left.
    """
    order = Window.partitionBy("source").orderBy(F.col("odds").desc())
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("source")
    rest = F.col("odds") * F.col("class_size")
    spent = F.coalesce(F.sum("class_size").over(above), F.lit(0)) * float(MOST)
    left = F.sum(rest).over(every) - F.coalesce(F.sum(rest).over(above), F.lit(0.0))
    tried = classes.withColumn(
        "factor", F.when(left > 0, (F.col("target") - spent) / left)
    )
    factor = F.first(
        F.when(F.col("factor") * F.col("odds") <= MOST, F.col("factor")), ignorenulls=True
    ).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return tried.withColumn(
        "copies",
        F.greatest(
            F.lit(0.0),
            F.least(F.lit(float(MOST)), F.coalesce(factor, F.lit(float("inf"))) * F.col("odds")),
        ),
    ).select("source", "odds", "copies")


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Choose how often each document enters the mix, so that sources meet their targets.

    A document's expected copies follow its source's target and its odds (documents under
    SHORT_WORDS words have half the odds). Whole expected copies are certain. The fraction left
    is an inclusion probability p: documents are ranked by Pareto order, u/(1-u) divided by
    p/(1-p) with u drawn from the id, and taken from the smallest on until the words of the
    sample reach what the source still lacks; the cut is off by half a document at most.

    Null text: no words, never matters for a target. Null source: a source of its own, last.
    Null or repeated ids share their draw and are ordered by size; wholly equal rows are
    interchangeable. Empty input: no rows. Other columns are ignored; reruns agree.
    """
    sized = stored(docs.select("doc_id", "source", word_count().alias("size")), "words").withColumn(
        "odds", F.when(F.col("size") < SHORT_WORDS, SHORT_ODDS).otherwise(1.0)
    )
    classes = sized.groupBy("source", "odds").agg(F.sum("size").alias("class_size"))
    targets = source_targets(classes.groupBy("source").agg(F.sum("class_size").alias("source_size")))
    given = classes.join(
        targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    plan = stored(
        given.join(
            expected_copies(given).select(
                F.col("source").alias("_source"), F.col("odds").alias("_odds"), "copies"
            ),
            F.col("source").eqNullSafe(F.col("_source")) & (F.col("odds") == F.col("_odds")),
        )
        .withColumn("certain", F.floor("copies"))
        .withColumn("chance", F.col("copies") - F.col("certain"))
        .withColumn(
            "lacking",
            F.col("target")
            - F.sum(F.col("certain") * F.col("class_size")).over(Window.partitionBy("source")),
        )
        .select("_source", "_odds", "source_size", "target", "certain", "chance", "lacking"),
        "plan",
    )
    drawn = uniform(F.col("doc_id"), seed=seed)
    asked = sized.join(
        plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("odds") == F.col("_odds"))
    ).select(
        "doc_id", "source", "size", "source_size", "target", "certain", "chance", "lacking",
        F.when(
            F.col("chance") > 0,
            (drawn / (1 - drawn)) / (F.col("chance") / (1 - F.col("chance"))),
        ).otherwise(float("inf")).alias("rank"),
    )
    run = prefix_sums(
        asked, [F.col("rank"), F.col("doc_id").asc_nulls_last(), F.col("size")],
        {"before": "size"}, group="source",
    )
    sampled = (F.col("chance") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("lacking"))
    return run.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("certain") + sampled.cast("long")).alias("copies"),
        ((F.col("certain") + sampled.cast("long")) * F.col("size")).alias("taken"),
    )
