"""Card collection against a plain loop over pages, and a whole run from documents."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from listings_spark.operators import collect as G
from listings_spark.operators.lifecycle import known_listings
from listings_spark.plans import state as S
from listings_spark.plans.collection import collect_run
from test_pages import URN, card

NOW = datetime(2026, 7, 18)


def loop(pages, eligible, max_pages, max_results):
    """Pages in order until an empty or repeated one, the quota or the page limit."""
    seen, found, read = set(), {}, []
    for number in range(max_pages):
        ids = pages.get(number, [])
        if not ids or not set(ids) - seen:
            break
        read.append(number)
        seen.update(ids)
        for i in ids:
            if i in eligible:
                found.setdefault(i, number)
        if len(found) >= max_results:
            break
    return read, list(found)[:max_results]


def test_pages_and_cap_against_loop(spark):
    rng = random.Random(8)
    cards, searches, want = [], [], {}
    for s in range(40):
        pages = {
            p: [str(rng.randrange(25)) for _ in range(rng.choice([0, 3, 6, 6, 6]))]
            for p in range(5)
        }
        max_pages, max_results = rng.randrange(1, 6), rng.randrange(1, 12)
        eligible = {str(i) for i in range(25) if i % 3}
        searches.append((f"s{s}", max_pages, max_results))
        want[f"s{s}"] = loop(pages, eligible, max_pages, max_results)
        cards += [(f"s{s}", p, n, i, i in eligible)
                  for p, ids in pages.items() for n, i in enumerate(ids)]
    cards = spark.createDataFrame(
        cards, "search_slug string, page int, pos int, listing_id string, eligible boolean"
    )
    searches = spark.createDataFrame(searches, "slug string, max_pages int, max_results int")
    read = G.read_pages(G.page_totals(cards, F.col("eligible")), searches, first_page=0)
    first = G.first_cards(G.cards_on(cards, read).filter("eligible"))
    chosen = G.cap_per_search(first, searches).orderBy("search_slug", "rank").collect()
    got = {slug: ([], []) for slug in want}
    for r in read.orderBy("search_slug", "page").collect():
        got[r["search_slug"]][0].append(r["page"])
    for r in chosen:
        got[r["search_slug"]][1].append(r["listing_id"])
    assert got == want


def detail(title, company="Acme", age="5 days ago", place="Oslo, Norway"):
    return (
        f'<h2 class="topcard__title">{title}</h2><a class="topcard__org-name-link">{company}</a>'
        f'<div class="top-card-layout__second-subline"><p class="topcard__flavor-row">'
        f'<i class="topcard__flavor--bullet">{place}</i></p></div>'
        f'<span class="posted-time-ago__text">{age}</span>'
    )


def test_collection_run(spark, tmp_path):
    searches = spark.createDataFrame(
        [("a", 2, 50, 1, []), ("b", 1, 25, 5, ["ACME!"]), ("c", 1, 25, 0, []), ("d", 1, 25, 0, []),
         ("e", 1, 25, 0, [])],
        "slug string, max_pages int, max_results int, max_rechecks int,"
        " company_names array<string>",
    )
    pages = spark.createDataFrame(
        [
            ("a", 0, card(URN + "1", "Software Intern") + card(URN + "2", "Senior Manager")
             + card(URN + "3", "Software Intern")),
            ("a", 1, card(URN + "1", "Software Intern") + card(URN + "4", "Data Intern")),
            ("b", 0, card(URN + "1", "Software Intern") + card(URN + "5", "Intern", "Other")),
            ("c", 0, "<p>challenge-page</p>"),
            ("d", 0, card(URN + "6", "Intern")),
            ("e", 0, card(URN + "7", "Intern")),
        ],
        "search_slug string, page int, html string",
    )
    ok, shell = detail("Software Intern 2027"), "<p>shell</p>"
    details = spark.createDataFrame(
        [
            ("1", ok, 200), ("3", None, 404), ("4", detail("Data Science Intern 2027",
             age="9 months ago"), 200), ("6", None, 503), ("7", "unusual activity", 200),
            ("8", detail("Cloud Intern 2027", age="2 years ago"), 200), ("9", None, 410),
            ("5", shell, 200),
        ],
        "listing_id string, html string, http_status int",
    )
    known = spark.createDataFrame(
        [("a", "3"), ("a", "8"), ("a", "99"), ("b", "9")],
        "search_slug string, listing_id string",
    ).select(
        "search_slug", "listing_id", F.lit("Acme").alias("company"),
        F.lit("Cloud Intern").alias("title"), F.lit("Oslo").alias("location"),
        F.lit("x").alias("link"),
    )
    run = collect_run(
        searches, pages, details, known, first_seq=100, run_prefix="run",
        observed_at=F.lit(NOW).cast("timestamp_ntz"),
    )
    log = {(r["search_slug"], r["listing_id"], r["kind"], r["run_seq"]) for r in run.log.collect()}
    assert log == {
        ("a", "1", "observed", 100), ("a", "3", "unavailable", 100), ("a", "8", "observed", 100),
        ("b", "1", "observed", 101), ("b", "9", "unavailable", 101),
    }
    runs = {r["search_slug"]: r for r in run.runs.collect()}
    assert {s: (r["status"], r["error_code"]) for s, r in runs.items()} == {
        "a": ("success", None), "b": ("success", None), "c": ("failed", "invalid_html"),
        "d": ("failed", "http_error"), "e": ("failed", "invalid_html"),
    }
    # Search a: the listing 4 is too old, the listing 3 is gone.
    assert (runs["a"]["found_count"], runs["a"]["accepted_count"], runs["a"]["warning_count"]) == (
        3, 2, 2
    )
    row = run.log.filter("search_slug = 'a' AND listing_id = '8'").first()
    assert (row["title"], row["category"], row["link"]) == (
        "Cloud Intern 2027", "infrastructure", "https://www.linkedin.com/jobs/view/8"
    )
    S.apply_log(run.log, str(tmp_path / "state"))
    state = S.load_state(spark, str(tmp_path / "state"))
    assert {r["listing_id"]: r["status"] for r in state["listings"].collect()} == {
        "1": "open", "8": "open"
    }
    held = known_listings(state["listings"], state["provenance"]).collect()
    assert {(r["search_slug"], r["listing_id"]) for r in held} == {
        ("a", "1"), ("a", "8"), ("b", "1")
    }


def test_invalid_details_and_card_warnings(spark):
    """A record that breaks any bound is a malformed detail; malformed cards of all parsed pages warn."""
    def listed(*ids):
        return "".join(card(URN + (i if i.isdigit() else "none"), "Software Intern") for i in ids)

    def with_industries(size):
        return detail("Software Intern 2027") + (
            '<ul><li><h3 class="description__job-criteria-subheader">Industries</h3>'
            f'<span class="description__job-criteria-text">{"x" * size}</span></li></ul>'
        )

    searches = spark.createDataFrame(
        [("f", 3, 50, 0, []), ("g", 1, 25, 0, []), ("h", 1, 25, 0, [])],
        "slug string, max_pages int, max_results int, max_rechecks int, company_names array<string>",
    )
    pages = spark.createDataFrame(
        [
            ("f", 0, listed("1", "2", "3", "x")), ("f", 1, listed("1", "2", "x", "4")),
            ("f", 2, listed("1", "2", "x")),  # nothing new: parsed, then reading ends
            ("g", 0, listed("5", "6")), ("h", 0, listed("1", "x")),
        ],
        "search_slug string, page int, html string",
    )
    details = spark.createDataFrame(
        [(i, with_industries(n), 200) for i, n in
         (("1", 500), ("2", 10), ("3", 10), ("4", 501), ("5", 501), ("6", 501))],
        "listing_id string, html string, http_status int",
    )
    known = spark.createDataFrame(
        [], "search_slug string, listing_id string, company string, title string, location string,"
        " link string",
    )
    run = collect_run(
        searches, pages, details, known, first_seq=1, run_prefix="run",
        observed_at=F.lit(NOW).cast("timestamp_ntz"),
    )
    runs = {
        r["search_slug"]: (r["status"], r["error_code"], r["accepted_count"], r["excluded_count"], r["warning_count"])
        for r in run.runs.collect()
    }
    assert runs["f"] == ("success", None, 3, 0, 4)
    assert runs["g"][:2] == ("failed", "invalid_html")
    assert runs["h"] == ("success", None, 1, 0, 1)
    assert {(r["search_slug"], r["listing_id"]) for r in run.log.collect()} == {
        ("f", "1"), ("f", "2"), ("f", "3"), ("h", "1")
    }


def test_overrides_and_capacity(spark):
    import pytest

    from listings_spark.sources.searches import effective_searches

    df = spark.createDataFrame(
        [("a", 2, 40, 9, True), ("b", 1, 25, 9, False)],
        "slug string, max_pages int, max_results int, max_rechecks int, enabled boolean",
    )
    row = effective_searches(df, max_pages=1, max_rechecks=0).first()
    assert (row["slug"], row["max_pages"], row["max_results"], row["max_rechecks"]) == (
        "a", 1, 25, 0
    )
    with pytest.raises(Exception, match="exceeds page capacity"):
        effective_searches(df, max_pages=1, max_results=26).collect()


def test_bounds_hold_whichever_columns_are_read(spark):
    from pyspark.errors import PySparkException

    from listings_spark.operators.collect import _limits
    from listings_spark.sources.searches import effective_searches

    df = spark.createDataFrame([("a", True, 2, 40, 900)], "slug string, enabled boolean, max_pages int, max_results int, max_rechecks int")
    with pytest.raises(PySparkException, match="recheck limit"):
        effective_searches(df).select("max_results").collect()
    with pytest.raises(PySparkException, match="max_rechecks is over 250"):
        _limits(df, "max_rechecks", 250).select("search_slug").collect()


def test_company_lists_notes_and_place_ids_are_bounded(spark):
    from listings_spark.sources.searches import company_list, search_violations

    good = ("s", "Name", "intern", "Berlin", "any", "any", 1, 25, 0)
    rows = [
        (*good, ["Acme &amp; Co", " ACME &amp; co ", "Other"], "12", "note"), (*good, ["x"] * 51, None, None),
        (*good, ["x" * 201, " "], "1a", "n" * 501), (*good, None, None, None), (*good, [None], "1", ""),
    ]
    df = spark.createDataFrame(
        rows, "slug string, name string, keywords string, location string, date_posted string, workplace string,"
        " max_pages int, max_results int, max_rechecks int, company_names array<string>, geo_id string, notes string"
    )
    found = [r[0] for r in df.select(search_violations(df.columns)).collect()]
    assert found == [
        [], ["company_names.size"], ["company_names.length", "geo_id.pattern", "notes.length"], [],
        ["company_names.length"],
    ]
    assert df.select(company_list()).first()[0] == ["Acme & Co", "Other"]
