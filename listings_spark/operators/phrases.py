"""Phrase dictionaries held in tables: word n-grams joined to phrases by equality.

Used when the dictionary is data. Short fixed lists stay literals (`functions.text`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listings_spark import constants as K
from listings_spark.functions import text as X


def rule_dictionary(rules: DataFrame) -> DataFrame:
    """Normalised (kind, category, phrase) with the position of the first occurrence.

    Entries without searchable text or over the length bound are refused: they stay in the
    result with a `problem` and no phrase.
    """
    keyed = rules.withColumn("_key", X.normalized_key(F.col("phrase")))
    problem = (
        F.when(F.length("phrase") > K.MAX_PHRASE, "too long")
        .when(X.collapse_space(F.col("phrase")) == "", "empty")
        .when(F.col("_key") == "", "no searchable text")
    )
    return (
        keyed.withColumn("problem", problem)
        .withColumn("phrase", F.when(F.col("problem").isNull(), F.col("_key")))
        .groupBy("kind", "category", "phrase", "problem")
        .agg(F.min("position").alias("position"))
    )


def phrase_conflicts(dictionary: DataFrame) -> DataFrame:
    """Phrases owned by more than one category, with the first owner."""
    return (
        dictionary.filter((F.col("kind") == "category") & F.col("phrase").isNotNull())
        .groupBy("phrase")
        .agg(
            F.count_distinct("category").alias("owners"),
            F.min_by("category", F.struct("position", "category")).alias("first_owner"),
        )
        .filter(F.col("owners") > 1)
    )


LISTS = ("internship", "new_grad", "seniority")


def rule_literals(dictionary: DataFrame, most: int = K.MAX_PHRASES_PER_LIST) -> dict:
    """Phrase lists of a dictionary as arguments for `cascade.classify`.

    Kinds are "category" and those of LISTS; a kind without phrases keeps its default. Meant for
    configured rules: a list of more than `most` phrases is refused before anything is collected,
    and texts then meet the dictionary by `phrase_hits`. Categories come in configured order.
    """
    usable = dictionary.filter(
        F.col("phrase").isNotNull() & F.col("kind").isin("category", *LISTS)
    )
    largest = usable.groupBy("kind", "category").count().agg(F.max("count"), F.count("*")).first()
    if (largest[0] or 0) > most or largest[1] > most:
        raise ValueError(f"a rule list holds more than {most} phrases or categories")
    rows = usable.orderBy("position", "category", "phrase").collect()
    found: dict = {}
    for row in rows:
        if row["kind"] == "category":
            found.setdefault("categories", {}).setdefault(row["category"], []).append(row["phrase"])
        else:
            found.setdefault(row["kind"], []).append(row["phrase"])
    return found


def anchor_word(phrase: Column) -> Column:
    """The longest word of a phrase (the first of these), which few texts hold."""
    words = F.split(phrase, " ")
    longest = F.array_max(F.transform(words, F.length))
    return F.element_at(F.filter(words, lambda w: F.length(w) == longest), 1)


def phrase_hits(texts: DataFrame, key: str, dictionary: DataFrame, identity: str) -> DataFrame:
    """Dictionary rows whose phrase occurs in the key, one row per text and phrase.

    Phrases of any length. Distinct words of the texts meet the anchor words of the phrases in
    an equality join; only those candidates go back to their texts for the test of the whole
    phrase. The words are narrow rows; Spark broadcasts the dictionary when its size allows it
    and splits frequent words by the skew join otherwise.
    """
    phrases = dictionary.filter(F.col("phrase").isNotNull()).withColumn(
        "_anchor", anchor_word(F.col("phrase"))
    )
    words = texts.select(
        F.col(identity).alias("_id"),
        F.explode(F.array_distinct(F.split(F.col(key), " "))).alias("_anchor"),
    )
    candidates = words.join(phrases, "_anchor").drop("_anchor")
    inside = F.contains(
        F.concat(F.lit(" "), F.col(key), F.lit(" ")),
        F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")),
    )
    return (
        texts.select(identity, key)
        .join(candidates, F.col(identity) == F.col("_id"))
        .filter(inside)
        .drop("_id", key)
    )


def first_category_by_rules(
    texts: DataFrame, key: str, dictionary: DataFrame, identity: str, generic=K.OTHER_TECH_PHRASES
) -> DataFrame:
    """Category of the lowest configured position among all matching phrases, for every text.

    A text without a hit is "other-tech" if it holds a generic phrase and "unknown" otherwise.
    """
    owned = dictionary.filter((F.col("kind") == "category") & F.col("phrase").isNotNull())
    order = owned.groupBy("category").agg(F.min("position").alias("category_rank"))
    hits = phrase_hits(
        texts, key, owned.select("phrase", "category"), identity
    ).join(order, "category")
    first = hits.groupBy(F.col(identity).alias("_id")).agg(
        F.min_by("category", F.struct("category_rank", "category")).alias("category")
    )
    fallback = F.when(X.contains_any(F.col(key), generic), F.lit("other-tech")).otherwise(
        F.lit("unknown")
    )
    return texts.join(first, F.col(identity) == F.col("_id"), "left").select(
        identity, F.coalesce("category", fallback).alias("category")
    )
