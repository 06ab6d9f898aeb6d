"""Dates, posting ages and cycle-year evidence as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listings_spark import constants as K
from listings_spark.functions import text as X


def ensure_utc(value: Column, offset: Column | None = None) -> Column:
    """UTC instant of a timestamp; a zone offset such as `+02:00` is applied when given."""
    if offset is None:
        return value
    return F.when(offset.isNull(), value).otherwise(F.to_utc_timestamp(value, offset))


def seconds_interval(seconds: Column) -> Column:
    """Fixed-length interval of a number of seconds."""
    zero = F.lit(0)
    return F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))


def relative_age(value: Column, observed_at: Column) -> Column:
    """Posting time from texts such as "3 weeks ago"; null when there is no usable age.

    Lower bounds ("30+ days ago") give null. A month is 31 days and a year is 365.
    """
    units = "|".join(K.AGE_UNIT_SECONDS)
    pattern = rf"^(?:reposted )?(\d+) ({units})s? ago$"

    def seconds_of(key: Column) -> Column:
        count = F.nullif(F.regexp_extract(key, pattern, 1), F.lit("")).try_cast("bigint")
        unit = F.regexp_extract(key, pattern, 2)
        unit_seconds = F.lit(None).cast("bigint")
        for name, seconds in K.AGE_UNIT_SECONDS.items():
            unit_seconds = F.when(unit == name, F.lit(seconds)).otherwise(unit_seconds)
        # Ages that reach before year one have no date.
        horizon = 2000 * 365 * 86_400
        now = F.when(key.isin("just now", "today"), F.lit(0))
        return F.coalesce(
            now, F.when(count <= F.floor(F.lit(horizon) / unit_seconds), count * unit_seconds)
        )

    decoded = X.decode_entities(value)
    seconds = F.when(~F.contains(decoded, F.lit("+")), X.let(X.fold_key(decoded), seconds_of))
    return observed_at - seconds_interval(seconds)


def _alternatives(phrases) -> str:
    longest_first = sorted(phrases, key=len, reverse=True)
    return "|".join(p.replace(" ", r"\s+") for p in longest_first)


START_VALUE = rf"(?:{'|'.join(K.START_PERIODS)})\s+20\d{{2}}"
START_IN_TITLE = rf"\b({START_VALUE})\b"
START_IN_CONTEXT = (
    rf"\b(?:{_alternatives(K.START_VERBS)})\b[^.\n]{{0,{K.START_GAP}}}({START_VALUE})\b"
    rf"|\b({START_VALUE})\s+(?:{'|'.join(K.START_NOUNS)})\b"
)


def start_period(title: Column, description: Column) -> Column:
    """Season or month with year: anywhere in the title, else in start context in the body."""

    def found(source: Column, pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(source, "(?iU)" + pattern, group), F.lit(""))

    def shown(value: Column) -> Column:
        words = F.split(value, r"\s+")
        return F.concat(F.initcap(F.get(words, 0)), F.lit(" "), F.get(words, 1))

    body = F.coalesce(description, F.lit(""))
    in_body = X.let(
        body,
        lambda b: F.coalesce(found(b, START_IN_CONTEXT, 1), found(b, START_IN_CONTEXT, 2)),
    )
    return X.let(F.coalesce(found(title, START_IN_TITLE, 1), in_body), shown)


def _context_form() -> str:
    terms = "|".join(sorted(K.CYCLE_CONTEXT_TERMS, key=len, reverse=True))
    gap = f".{{0,{K.YEAR_CONTEXT_GAP}}}"
    year = rf"{K.YEAR_PATTERN}\b"
    # The year itself is tested first so look-behind runs only at candidate positions.
    return rf"\b(?={year})(?:(?<=\b(?:{terms})\b{gap})|(?={year}{gap}\b(?:{terms})\b))"


def _not_eligibility() -> str:
    leads = "|".join(K.GRADUATE_LEADS)
    tail = "(?: in| by)?"
    return (
        rf"(?<!(?:class of|(?:{leads}) graduate{tail}|graduating{tail}"
        rf"|graduation(?: date)?{tail}) )"
    )


YEAR_TOKENS = rf"\b{K.YEAR_PATTERN}\b"
# Keys separate words by one space, so a plain space in the bounded look-behind is exact.
CYCLE_YEARS = rf"\b(?={K.YEAR_PATTERN}\b){_not_eligibility()}{K.YEAR_PATTERN}"
CONTEXT_YEARS = f"{_context_form()}{K.YEAR_PATTERN}"
CONTEXT_CYCLE_YEARS = f"{_context_form()}{_not_eligibility()}{K.YEAR_PATTERN}"


def _all_matches(key: Column, pattern: str) -> Column:
    return F.regexp_extract_all(key, F.lit(pattern), F.lit(0))


def year_tokens(key: Column) -> Column:
    """Every year token of a key, in order."""
    return _all_matches(key, YEAR_TOKENS)


def cycle_years(key: Column) -> Column:
    """Year tokens that do not merely describe who may apply."""
    return _all_matches(key, CYCLE_YEARS)


def context_years(key: Column, ignore_eligibility: bool = False) -> Column:
    """Years close to an opportunity term; optionally without eligibility years."""
    return _all_matches(key, CONTEXT_CYCLE_YEARS if ignore_eligibility else CONTEXT_YEARS)


def resolve_cycle(
    title_key: Column, body_key: Column, employment_type: Column, target: int
) -> Column:
    """Cycle of a listing: a conflicting title year, the target in the title, then the body.

    Graduation years are ignored for internships only. Without evidence: "unknown".
    """
    wanted = str(target)

    def evidence(years: Column) -> Column:
        return X.let(
            years,
            lambda ys: F.coalesce(
                F.get(F.filter(ys, lambda y: y != wanted), 0),
                F.when(F.array_contains(ys, wanted), F.lit(wanted)),
            ),
        )

    graduate = employment_type == "new-grad"
    title_years = F.when(graduate, year_tokens(title_key)).otherwise(cycle_years(title_key))
    body_years = F.when(graduate, context_years(body_key)).otherwise(
        context_years(body_key, ignore_eligibility=True)
    )
    return F.coalesce(evidence(title_years), evidence(body_years), F.lit("unknown"))


def date_label(value: Column) -> Column:
    """Short display date such as "5 May 2026"."""
    return F.date_format(value, "d MMM yyyy")


def collection_label(value: Column) -> Column:
    """Collection time for display, "Never" when absent."""
    text = F.date_format(value, "MMMM d, yyyy 'at' HH:mm 'UTC'")
    return F.coalesce(text, F.lit("Never"))


def recency_bound(date_posted: Column, observed_at: Column) -> Column:
    """Earliest posting time a search window admits, null for an unbounded search."""
    bound = F.when(date_posted == "cycle", F.lit(K.MINIMUM_POSTED_AT).cast("timestamp_ntz"))
    for name, seconds in K.RECENCY_SECONDS.items():
        bound = bound.when(date_posted == name, observed_at - seconds_interval(F.lit(seconds)))
    return bound


def in_recency_window(posted_at: Column, date_posted: Column, observed_at: Column) -> Column:
    """Whether a posting time lies inside the window of its search."""
    bound = recency_bound(date_posted, observed_at)
    return F.coalesce(bound.isNull() | (posted_at >= bound), F.lit(False))


def policy_date() -> Column:
    """Earliest eligible posting time."""
    return F.lit(K.MINIMUM_POSTED_AT).cast("timestamp_ntz")


def posting_is_eligible(posted_at: Column, minimum: Column | None = None) -> Column:
    """Posting evidence on or after the policy date; a missing date is not evidence."""
    bound = policy_date() if minimum is None else minimum
    return F.coalesce(posted_at >= bound, F.lit(False))
