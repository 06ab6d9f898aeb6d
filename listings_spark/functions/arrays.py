"""List cleaning and derived lists as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listings_spark import constants as K
from listings_spark.functions import text as X


def clean_list(values: Column) -> Column:
    """Cleaned items in order, empties and repeats dropped; null becomes an empty list."""
    items = F.coalesce(values, F.array().cast("array<string>"))
    cleaned = F.transform(X.decode_entity_items(items), X.collapse_space)
    return F.array_distinct(F.filter(cleaned, lambda x: x != ""))


def list_violations(values: Column) -> Column:
    """Names of the bounds a raw location list breaks."""
    items = F.coalesce(values, F.array().cast("array<string>"))
    cleaned = F.transform(X.decode_entity_items(items), X.collapse_space)
    return F.array_compact(
        F.array(
            F.when(F.size(items) > K.MAX_LOCATIONS, F.lit("locations.count")),
            F.when(
                F.exists(cleaned, lambda x: F.length(x) > K.MAX_LOCATION),
                F.lit("locations.length"),
            ),
        )
    )


def sorted_codes(values: Column) -> Column:
    """Distinct codes in ascending order."""
    return F.array_sort(F.array_distinct(values))


def display_list(values: Column) -> Column:
    """Items joined for display."""
    return F.array_join(values, "; ")


def strip_space(value: Column) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.regexp_replace(value, rf"^{X.WHITESPACE}|{X.WHITESPACE}$", "")


def countries(location: Column) -> Column:
    """Distinct last comma parts of a ";"-separated location, in order.

    A place whose last part is blank is kept whole.
    """

    def last_part(place: Column) -> Column:
        tail = strip_space(F.element_at(F.split(place, ","), -1))
        return F.when(tail != "", tail).otherwise(strip_space(place))

    parts = F.transform(F.split(location, ";"), last_part)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def iso_codes(raw: Column) -> Column:
    """Upper-case two-letter tokens of the raw text that touch no other letter."""
    return F.regexp_extract_all(raw, F.lit("(?<![A-Za-z])([A-Z]{2})(?![A-Za-z])"), F.lit(1))


def distinct_by_key(values: Column) -> Column:
    """Cleaned items, first spelling per comparison key, order kept."""
    pairs = F.transform(
        X.decode_entity_items(values),
        lambda x: F.struct(X.fold_key(x).alias("key"), X.collapse_space(x).alias("item")),
    )

    def first_spellings(ps: Column) -> Column:
        keys = F.transform(ps, lambda p: p["key"])
        kept = F.filter(ps, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
        return F.transform(kept, lambda p: p["item"])

    return X.let(pairs, first_spellings)
