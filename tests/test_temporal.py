import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from listings_spark import constants as K
from listings_spark.functions import temporal as D

NOW = datetime(2026, 7, 18, 12, 30)
TERMS = [*K.CYCLE_CONTEXT_TERMS, "graduating", "graduation", "date", "class of", "must", "to",
         "in", "by", "graduate", "a", "founded", "internet", "expected", "2027", "2026", "2050",
         "2019", "x" * 9, "of", "planning"]


def keys(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choices(TERMS, k=rng.randrange(1, 16))) for _ in range(n)]


def year_spots(key):
    at = 0
    for word in key.split(" "):
        if re.fullmatch(r"20[2-4]\d", word):
            yield at, word
        at += len(word) + 1


def term_spots(key):
    for term in K.CYCLE_CONTEXT_TERMS:
        for m in re.finditer(rf"(?<![^ ]){term}(?![^ ])", key):
            yield m.start(), m.end()


def describes_applicants(key, start):
    tails = ["", "in ", "by "]
    leads = [f"{lead} graduate " for lead in K.GRADUATE_LEADS]
    leads += ["graduating ", "graduation ", "graduation date "]
    endings = [lead + tail for lead in leads for tail in tails] + ["class of "]
    return any(key[:start].endswith(e) for e in endings)


def in_context(key, start):
    return any(
        0 <= start - e <= 24 or 0 <= s - (start + 4) <= 24 for s, e in term_spots(key)
    )


def test_context_years_against_positions(values):
    items = keys(5, 3000)
    assert values(items, D.year_tokens) == [[y for _, y in year_spots(k)] for k in items]
    assert values(items, D.context_years) == [
        [y for s, y in year_spots(k) if in_context(k, s)] for k in items
    ]
    assert values(items, lambda c: D.context_years(c, ignore_eligibility=True)) == [
        [y for s, y in year_spots(k) if in_context(k, s) and not describes_applicants(k, s)]
        for k in items
    ]
    assert values(items, D.cycle_years) == [
        [y for s, y in year_spots(k) if not describes_applicants(k, s)] for k in items
    ]


def test_relative_age(values):
    items = ["5 days ago", "30+ days ago", "Reposted 2 weeks ago", "today", "Just now",
             "1 month ago", "1 year ago", "soon", None, "90 minutes ago",
             "99999999999999999999 days ago", "999999 years ago"]
    assert values(items, lambda c: D.relative_age(c, F.lit(NOW).cast("timestamp_ntz"))) == [
        NOW - timedelta(days=5), None, NOW - timedelta(days=14), NOW, NOW,
        NOW - timedelta(days=31), NOW - timedelta(days=365), None, None,
        NOW - timedelta(minutes=90), None, None,
    ]


def test_start_period(values):
    titles = ["Intern SUMMER 2027", "Intern", "Fall  2026 and Spring 2027"]
    assert values(titles, lambda c: D.start_period(c, F.lit(None).cast("string"))) == [
        "Summer 2027", None, "Fall 2026"
    ]
    bodies = ["Starting in September 2027.", "Founded in May 2021", "The winter 2026 intake",
              "Join our team. January 2027", "Begins 5 or 12 march 2027", None]
    assert values(bodies, lambda c: D.start_period(F.lit("Intern"), c)) == [
        "September 2027", None, "Winter 2026", None, "March 2027", None
    ]


def test_cycle_window_counts_from_policy_date(spark):
    row = spark.range(1).select(
        D.recency_bound(F.lit("cycle"), F.lit(NOW).cast("timestamp_ntz")).alias("cycle"),
        D.recency_bound(F.lit("any"), F.lit(NOW).cast("timestamp_ntz")).alias("any"),
        D.recency_bound(F.lit("week"), F.lit(NOW).cast("timestamp_ntz")).alias("week"),
    ).first()
    assert row["cycle"] == datetime(2026, 5, 1)
    assert row["any"] is None
    assert row["week"] == NOW - timedelta(days=7)


def test_ensure_utc(spark):
    df = spark.sql("SELECT timestamp'2026-05-01 12:00:00' AS t, '+02:00' AS z")
    row = df.select(D.ensure_utc(F.col("t"), F.col("z")).cast("string").alias("u")).first()
    assert row["u"] == "2026-05-01 10:00:00"
