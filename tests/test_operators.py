import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from listings_spark.functions import text as X
from listings_spark.operators import audit as U
from listings_spark.operators import collect as G
from listings_spark.operators import directory as V
from listings_spark.operators import lifecycle as L
from listings_spark.operators import ordering as O
from listings_spark.operators import phrases as P
from listings_spark.operators import quality as Q
from listings_spark.plans.directory import checked_links, directory
from listings_spark.sources import searches as R
from listings_spark.sources.snapshots import table_digest
from test_lifecycle import SCHEMA, history

NOW = datetime(2026, 7, 1)
PREFIX = "https://www.linkedin.com/jobs/view/"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def listings(spark):
    rng = random.Random(2)
    places = ["Lisbon, Portugal", "Madrid, Spain; Porto, Portugal", "Oslo", "Rome, Italy"]
    rows = []
    for i in range(300):
        rows.append((
            str(1000 + i), f"Company {rng.randrange(9)}", rng.choice(["Data Intern", "data intern",
            "Cloud Engineer"]), rng.choice(places), f"{PREFIX}{1000 + i}",
            rng.choice(["data-science", "other-tech"]), rng.choice([None, "", "Software"]),
            rng.choice(["internship", "new-grad"]), None, NOW - timedelta(hours=rng.randrange(90)),
            NOW, NOW, rng.choice(["open", "open", "closed"]),
        ))
    schema = ("listing_id string, company string, title string, location string, link string,"
              " category string, industries string, employment_type string, start_date string,"
              " first_seen_at timestamp_ntz, last_seen_at timestamp_ntz,"
              " updated_at timestamp_ntz, status string")
    return spark.createDataFrame(rows, schema).repartition(5).cache()


def test_rank_is_a_total_order(listings):
    got = O.with_rank(O.open_listings(listings), O.publication_order()).collect()
    rows = sorted(got, key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    keys = [(r["company"].lower(), r["title"].lower(), r["location"], r["listing_id"])
            for r in rows]
    assert keys == sorted(keys)


def test_latest_per_type_and_pages(listings):
    opened = [r for r in listings.collect() if r["status"] == "open"]
    newest = sorted(opened, key=lambda r: (r["first_seen_at"], r["listing_id"]), reverse=True)
    for kind in ("internship", "new-grad"):
        want = [r["listing_id"] for r in newest if r["employment_type"] == kind][:10]
        got = O.latest_per_type(listings).filter(F.col("employment_type") == kind)
        assert [r["listing_id"] for r in got.orderBy("rank").collect()] == want
    page = O.result_page(O.open_listings(listings), O.directory_order(), 3, 20)
    assert [(r["rank"], r["listing_id"]) for r in page.orderBy("rank").collect()] == [
        (61 + i, r["listing_id"]) for i, r in enumerate(newest[60:80])
    ]
    plan = plan_of(page)
    assert "TakeOrderedAndProject" in plan or "GlobalLimit" in plan
    assert O.page_count(listings.limit(0)).first()["pages"] == 1
    with pytest.raises(ValueError):
        O.result_page(listings, O.directory_order(), 0, 25)


def test_top_k_is_cut_before_the_shuffle(spark, listings):
    assert "WindowGroupLimit" in plan_of(O.latest_per_type(listings))
    cards = spark.createDataFrame([], "search_slug string, listing_id string, page int, pos int")
    searches = spark.createDataFrame([], "slug string, max_results int, max_rechecks int")
    assert "WindowGroupLimit" in plan_of(G.cap_per_search(cards, searches))
    assert "WindowGroupLimit" in plan_of(G.absent_known(cards, cards, searches))


def test_fold_shuffles_the_log_once(spark):
    log = spark.createDataFrame(history(1, commits=5), SCHEMA)
    folded = L.fold(log)
    for result in (L.listings_from(folded), L.provenance_from(folded), folded):
        assert plan_of(result).count("Exchange ") == 1


def test_filters_reach_the_scan(spark, listings, tmp_path):
    listings.write.parquet(str(tmp_path / "l"))
    stored = spark.read.parquet(str(tmp_path / "l"))
    plan = plan_of(O.latest_per_type(stored).select("listing_id", "rank"))
    assert "EqualTo(status,open)" in plan
    assert "title" not in plan.split("ReadSchema")[-1]


def test_directory_filters(listings):
    opened = [r for r in listings.collect() if r["status"] == "open"]

    def count(**filters):
        return V.matches(O.open_listings(listings), **filters).count()

    assert count() == len(opened)
    assert count(company="Company 3") == sum(r["company"] == "Company 3" for r in opened)
    assert count(company="Nobody", employment_type="boss") == len(opened)
    assert count(country="Portugal") == sum("Portugal" in r["location"] for r in opened)
    assert count(query="  DATA intern ") == sum("ata" in r["title"] for r in opened)
    assert count(query="software internship") == sum(
        r["industries"] == "Software" and r["employment_type"] == "internship" for r in opened
    )
    rows = directory(listings, sort="company", descending=False, size=10).collect()
    assert len(rows) == 10 and rows[0]["company"] == "Company 0"


def test_wrong_link_fails_the_read(listings):
    bad = listings.withColumn("link", F.lit(PREFIX + "1"))
    with pytest.raises(Exception, match="invalid listing address"):
        checked_links(bad).collect()
    assert checked_links(listings).count() == 300


def test_facets_and_type_counts(listings):
    got = {(r["facet"], r["value"]) for r in V.facets(listings).collect()}
    assert {v for f, v in got if f == "country"} == {"Portugal", "Spain", "Oslo", "Italy"}
    assert {v for f, v in got if f == "employment_type"} == {"internship", "new-grad"}
    none = V.type_counts(listings.filter("employment_type = 'internship'").limit(3))
    assert {r["employment_type"]: r["n"] for r in none.collect()} == {
        "internship": 3, "new-grad": 0
    }


def test_reconcile_counts_duplicates(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    got = {(r["x"], r["side"], r["n"]) for r in Q.reconcile(a, b).collect()}
    assert got == {(1, "unexpected", 1), (3, "missing", 1)}
    assert Q.reconcile(a, a).count() == 0


def test_record_violations(spark):
    rows = [
        ("1", "C", "T", ["L"], PREFIX + "1", None, None),
        ("x", " ", "t" * 501, ["p"] * 21, PREFIX + "2", "d" * 200_001, "i" * 501),
        ("2", "C", "T", ["p" * 501], PREFIX + "3", None, None),
    ]
    df = spark.createDataFrame(
        rows, "listing_id string, company string, title string, locations array<string>,"
        " link string, description string, industries string",
    )
    got = [r["v"] for r in df.select(Q.record_violations().alias("v")).collect()]
    assert got == [
        [], ["listing_id.pattern", "company.required", "title.length", "locations.count",
             "link.identity", "description.length", "industries.length"],
        ["locations.length", "link.identity"],
    ]


def test_search_violations(spark):
    rows = [("data-eng", "N", "ab", "EU", "cycle", "any", 2, 50, 5),
            ("Bad Slug", "Example Search", "a", "", "year", "sea", 11, 300, 251)]
    df = spark.createDataFrame(
        rows, "slug string, name string, keywords string, location string, date_posted string,"
        " workplace string, max_pages int, max_results int, max_rechecks int",
    )
    ok, bad = [r["v"] for r in df.select(R.search_violations().alias("v")).collect()]
    assert ok == []
    assert bad == ["slug.pattern", "keywords.length", "location.length", "date_posted.value",
                   "workplace.value", "max_pages.range", "max_results.range",
                   "max_results.pages", "max_rechecks.range", "name.placeholder"]


def test_phrase_join_equals_direct_search(spark):
    rng = random.Random(6)
    words = ["data", "cloud", "big", "site", "reliability", "x", "machine"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 9)))) for i in range(400)]
    phrases = [("a", "big data", 3), ("b", "cloud", 1), ("c", "site reliability x machine", 0),
               ("a", "machine machine", 2), ("b", "natural language processing and speech", 4)]
    texts += [(400, "on natural language processing and speech today"), (401, "")]
    df = spark.createDataFrame(texts, "i int, k string")
    rules = spark.createDataFrame(phrases, "category string, phrase string, position int")
    rules = P.rule_dictionary(rules.withColumn("kind", F.lit("category")))
    got = {(r["i"], r["phrase"]) for r in P.phrase_hits(df, "k", rules, "i").collect()}
    assert got == {(i, p) for i, k in texts for _, p, _ in phrases if f" {p} " in f" {k} "}
    first = {r["i"]: r["category"]
             for r in P.first_category_by_rules(df, "k", rules, "i").collect()}
    ranks = {"c": 0, "b": 1, "a": 2}
    want = {}
    for i, k in texts:
        hit = [c for c, p, _ in phrases if f" {p} " in f" {k} "]
        want[i] = min(hit, key=ranks.get, default="unknown")
    assert first == want


def test_limits_over_the_bound_fail(spark):
    cards = spark.range(400).selectExpr(
        "'s' AS search_slug", "CAST(id AS STRING) AS listing_id", "0 AS page", "id AS pos"
    )
    for most, works in ((250, True), (251, False)):
        searches = spark.createDataFrame(
            [("s", most, most)], "slug string, max_results int, max_rechecks int"
        )
        none = cards.filter("false")
        for rows in (G.cap_per_search(cards, searches), G.absent_known(cards, none, searches)):
            if works:
                assert rows.count() == 250
            else:
                with pytest.raises(Exception, match="is over 250"):
                    rows.collect()


def test_digest_tells_separators_and_nulls_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a,1:b", "c"), (None, ""), ("", None), (None, None), ("", "")]
    found = {
        tuple(table_digest(spark.createDataFrame([r], "x string, y string")).first()) for r in rows
    }
    assert len(found) == len(rows)
    nested = spark.createDataFrame([([1, None],), ([1],)], "x array<int>")
    assert table_digest(nested).first()["row_count"] == 2


def test_rule_dictionary_refuses_unusable_phrases(spark):
    rows = [("category", "a", 0, "Cloud &amp; Co"), ("category", "a", 1, "cloud co"),
            ("category", "b", 2, "cloud-co"), ("category", "b", 3, "漢字"),
            ("category", "b", 4, "  "), ("category", "b", 5, "x" * 201)]
    df = spark.createDataFrame(rows, "kind string, category string, position int, phrase string")
    rules = P.rule_dictionary(df)
    got = {(r["category"], r["phrase"], r["problem"], r["position"]) for r in rules.collect()}
    assert got == {
        ("a", "cloud co", None, 0), ("b", "cloud co", None, 2),
        ("b", None, "no searchable text", 3), ("b", None, "empty", 4), ("b", None, "too long", 5),
    }
    conflict = P.phrase_conflicts(rules).first()
    assert (conflict["phrase"], conflict["owners"], conflict["first_owner"]) == ("cloud co", 2, "a")


def test_audit_outcomes(spark):
    rows = [
        ("a", 200, False, 200, True, "available"), ("b", 404, None, None, None, "unavailable"),
        ("c", 410, None, None, None, "unavailable"), ("d", 503, None, None, None, "inconclusive"),
        ("e", 200, True, None, None, "unavailable"), ("f", 200, False, 404, None, "unavailable"),
        ("g", 200, False, 429, None, "inconclusive"), ("h", 200, False, 200, False, "inconclusive"),
        ("i", None, None, None, None, "inconclusive"),
    ]
    df = spark.createDataFrame(
        rows, "listing_id string, public_status int, closed_notice boolean, detail_status int,"
        " identity_ok boolean, want string",
    )
    assert all(r["outcome"] == r["want"] for r in U.outcomes(df).collect())


def test_one_listing_with_a_third_of_all_rows(spark):
    """A hot listing is reduced on the map side: the fold sees one row per commit."""
    rows = spark.range(30_000).select(
        (F.col("id") % 50).alias("run_seq"), F.col("id").alias("pos"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias(
            "listing_id"
        ),
        F.lit("observed").alias("kind"),
    )
    collapsed = L.collapse_log(rows)
    assert "partial_max" in plan_of(collapsed)
    assert collapsed.filter("listing_id = 'hot'").count() == 50
    assert collapsed.filter("listing_id != 'hot'").count() == 20_000


def test_prefilter_uses_given_terms(values):
    items = ["Werkstudent Data", "Summer Intern"]
    assert values(items, lambda c: X.title_allowed(c, ("werkstudent",), ())) == [True, False]
