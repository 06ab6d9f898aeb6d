"""Country evidence from location texts.

The dictionaries are fixed and short, so they are array literals scanned per location inside
one projection: no join and no shuffle, whatever the number of listings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listings_spark import constants as K
from listings_spark.functions import arrays as A
from listings_spark.functions import text as X


def _codes_of(padded_key: Column, names: dict[str, str]) -> Column:
    """Codes of all names that occur as whole phrases in a padded key.

    The look-ahead finds a name at every word, also inside a longer one ("northern ireland"
    holds "ireland"). Names that share their first word differ in length only where they mean
    the same country, so one hit per word is enough.
    """
    found = F.regexp_extract_all(
        padded_key, F.lit(f"(?<= )(?=({'|'.join(names)}) )"), F.lit(1)
    )
    entries = ", ".join(f"'{name}', '{code}'" for name, code in names.items())
    table = F.expr(f"map({entries})")
    return F.transform(found, lambda name: F.try_element_at(table, name))


def _place_evidence(place: Column) -> Column:
    """Evidence of one place given as struct (padded key, upper-case tokens, display)."""
    padded, tokens = place["padded"], place["tokens"]
    outside = F.arrays_overlap(
        tokens, X.string_array(K.NON_EUROPEAN_CODES)
    ) | padded.rlike(f" (?:{'|'.join(K.NON_EUROPEAN_NAMES)}) ")
    no_codes = F.array().cast("array<string>")

    def evidence(outside: Column) -> Column:
        codes = F.concat(
            _codes_of(padded, K.COUNTRY_NAMES),
            # City names are only a fallback: a clear market elsewhere rules out namesakes.
            F.when(outside, no_codes).otherwise(_codes_of(padded, K.CITY_NAMES)),
            F.array_intersect(tokens, X.string_array(K.EUROPEAN_CODES)),
        )
        return F.struct(
            place["display"].alias("display"),
            codes.alias("codes"),
            padded.rlike("|".join(K.EUROPE_SUBSTRINGS)).alias("europe"),
            outside.alias("outside"),
        )

    return X.let(outside, evidence)


def resolve_locations(values: Column) -> Column:
    """Struct of display locations, country codes and the two region signals."""

    def prepared(raw: Column, decoded: Column) -> Column:
        return F.struct(
            F.concat(F.lit(" "), X.fold_key(decoded), F.lit(" ")).alias("padded"),
            A.iso_codes(raw).alias("tokens"),
            X.location_from_decoded(decoded).alias("display"),
        )

    places = F.transform(
        F.zip_with(values, X.decode_entity_items(values), prepared), _place_evidence
    )
    return X.let(
        places,
        lambda p: F.struct(
            F.array_distinct(
                F.filter(F.transform(p, lambda x: x["display"]), lambda d: d != "")
            ).alias("locations"),
            A.sorted_codes(F.flatten(F.transform(p, lambda x: x["codes"]))).alias(
                "country_codes"
            ),
            F.exists(p, lambda x: x["europe"] | (F.size(x["codes"]) > 0)).alias(
                "europe_signal"
            ),
            F.exists(p, lambda x: x["outside"]).alias("non_europe_signal"),
        ),
    )


def geo_rejection(geo: Column) -> Column:
    """Reason a resolved location is refused, null when it passes.

    An explicit European code overrides a non-European signal.
    """
    european = X.string_array(K.EUROPEAN_CODES)
    explicit = F.arrays_overlap(geo["country_codes"], european)
    return F.when(
        geo["non_europe_signal"] & ~explicit, F.lit(K.REASON_OUTSIDE_EUROPE)
    ).when(~(explicit | geo["europe_signal"]), F.lit(K.REASON_NOT_EUROPEAN))
