from datetime import datetime, timedelta

from listings_spark.sources import pages as P

NOW = datetime(2026, 7, 18, 12, 30)


def card(urn, title="Data Intern", company="Acme", place="Oslo"):
    return (
        f'<li><div data-entity-urn="{urn}"><h3 class="base-search-card__title"> {title} </h3>'
        f'<h4 class="base-search-card__subtitle"><a>{company}</a></h4>'
        f'<span class="x job-search-card__location">{place}</span></div></li>'
    )


URN = "urn:li:jobPosting:"


def test_search_cards(spark):
    pages = [
        ("good", card(URN + "1") + card(URN + "2", title="R&amp;D <b>Intern</b>")),
        ("half", card(URN + "3") + card(URN + "x")),
        ("bad", card(URN + "4") + card(URN + "5", company="") + card(URN + "6", title="t" * 501)),
        ("blocked", "<p>Security Verification</p>" + card(URN + "7")),
        ("empty", "<ul></ul>"),
        ("other", card("urn:li:company:8")),
    ]
    df = spark.createDataFrame(pages, "name string, html string")
    got = {r["name"]: r for r in P.search_cards(df).collect()}
    assert {n: (r["status"], r["malformed"], [c["listing_id"] for c in r["cards"]])
            for n, r in got.items()} == {
        "good": ("ok", 0, ["1", "2"]), "half": ("ok", 1, ["3"]), "bad": ("rejected", 2, []),
        "blocked": ("blocked", 0, []),
        "empty": ("ok", 0, []), "other": ("ok", 0, []),
    }
    assert got["good"]["cards"][1]["title"] == "R&D Intern"
    rows = P.explode_cards(P.search_cards(df)).filter("name = 'good'").collect()
    assert [(r["pos"], r["link"]) for r in rows] == [
        (0, "https://www.linkedin.com/jobs/view/1"), (1, "https://www.linkedin.com/jobs/view/2")
    ]


DETAIL = """<!doctype html><section><h2 class="top-card-layout__title">Data Intern 2027</h2>
<div class="top-card-layout__second-subline"><div class="topcard__flavor-row">
<span><a class="topcard__org-name-link">Acme &amp; Co</a></span>
<span class="topcard__flavor topcard__flavor--bullet">Oslo, Norway</span></div>
<div class="topcard__flavor-row"><span class="topcard__flavor--bullet">9 applicants</span></div>
</div></section><span class="posted-time-ago__text">5 days ago</span>
<div class="show-more-less-html__markup">Join our <b>Summer 2027</b> team.</div><ul>
<li><h3>Employment type</h3><span class="a-criteria-text">Internship</span></li>
<li><h3 class="description__job-criteria-subheader">Industries:</h3><p>Software</p></li></ul>"""


def details(spark, pages):
    rows = [(str(i), p, NOW, "Card title", "Card company", "Card place")
            for i, p in enumerate(pages)]
    df = spark.createDataFrame(
        rows, "listing_id string, html string, observed_at timestamp_ntz, card_title string,"
        " card_company string, card_location string",
    )
    return P.detail_records(df).orderBy("listing_id").collect()


def test_detail_record(spark):
    full, bare, blocked, missing = details(
        spark, [DETAIL, "<p>shell</p>", "<p>unusual activity</p>", None]
    )
    assert (full["title"], full["company"], full["location"]) == (
        "Data Intern 2027", "Acme & Co", "Oslo, Norway"
    )
    assert full["description"] == "Join our Summer 2027 team."
    assert full["industries"] == "Software"
    assert full["start_date"] == "Summer 2027"
    assert full["posted_at"] == NOW - timedelta(days=5)
    assert full["problem"] is None and full["identity_ok"] and not full["closed_notice"]
    assert (bare["title"], bare["location"]) == ("Card title", "Card place")
    assert bare["description"] is None and not bare["identity_ok"] and bare["problem"] is None
    assert blocked["problem"] == "blocked" and not blocked["identity_ok"]
    assert missing["title"] == "Card title" and not missing["identity_ok"]


def test_closure_notice_only_in_alerts(spark):
    words = "No longer accepting applications"
    pages = [
        f'<div role="alert">{words}</div>', f'<div aria-live="assertive"><b>{words}</b>.</div>',
        f'<figure class="a closed-job__flavor--closed">{words}</figure>',
        f'<div class="show-more-less-html__markup">{words}</div>', f'<p aria-live="polite">{words}</p>',
    ]
    assert [r["closed_notice"] for r in details(spark, pages)] == [True, True, True, False, False]


def test_binary_files_become_pages(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>é</p>", encoding="utf-8")
    row = P.read_pages(spark, str(tmp_path), "files").first()
    assert row["html"] == "<p>é</p>" and row["url"].endswith("a.html")


def told(page):
    """A page as plain values: each element with its classes, parent and text."""
    return [
        (e.tag, list(e.classes), e.parent.place if e.parent else None, page.text(e),
         [x.place for x in page.inside(e)], [x.place for x in page.children(e)])
        for e in page.elements
    ]


def test_plain_markup_is_read_the_short_way_and_alike():
    rows = "".join(card(URN + str(n)) for n in range(3))
    plain = [
        DETAIL, rows, "", "text &amp;amp; more", "<p>a<br>b<br/>c</p><img src='x'>".replace("'", '"'),
        "<div><p>open<b>deep</div>after</p></b>", '<script>var a = "b";</script><p>seen</p>',
        "<title>T &lt;</title><template><p>no</p></template><p hidden class>yes</p>",
        "<!DOCTYPE html><DIV>".replace("DIV", "div") + '<p class="a b" class="c">&am',
    ]
    for page in plain:
        assert P._plain(page) is not None, page
        assert told(P._plain(page)) == told(P._parsed(page)), page


def test_other_markup_takes_the_long_way():
    for page in (
        "a < b", "<P>x</P>", "<p class='a'>x</p>", "<p class=a>x</p>", "<!-- c --><p>x</p>",
        '<p class="a&amp;b">x</p>', "<script>if (a < b) {}</script>", "<script>open", "<p", "<a/b>x",
        '<a title="x>y">z</a>', "</p a>", "<title><b>x</b></title>", "<x-y>z</x-y>",
    ):
        assert P._plain(page) is None, page
        assert P._read(page).elements


def few_narrow_rows(spark, folder):
    """Orders and customers that lie in one task each."""
    orders = spark.createDataFrame(
        [(n, n % 5, "O", 1.0, NOW, "1-URGENT") for n in range(200)],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string",
    )
    customers = spark.createDataFrame([(n, f"C{n}") for n in range(5)], "c_custkey long, c_name string")
    orders.coalesce(1).write.parquet(f"{folder}/orders.parquet")
    customers.coalesce(1).write.parquet(f"{folder}/customer.parquet")


def test_detail_pages_are_dealt_to_all_cores(spark, tmp_path):
    # Few narrow rows lie in one task after the join; reading their pages is the work.
    from listings_spark.checks.page_checks import detail_pages

    few_narrow_rows(spark, tmp_path)
    pages = detail_pages(spark, str(tmp_path))
    sizes = pages.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    cores = spark.sparkContext.defaultParallelism
    assert sum(sizes) == 200 and len(sizes) >= 3 * cores and max(sizes) <= 2 * 200 / len(sizes) + cores


def test_listings_to_classify_lie_in_files_for_all_cores(spark, tmp_path, monkeypatch):
    from listings_spark.checks import state_checks

    few_narrow_rows(spark, tmp_path)
    monkeypatch.setattr(state_checks, "place", lambda _: f"{tmp_path}/stream")
    assert state_checks.QUERIES["stream_classify"](spark, str(tmp_path)).count() == 200
    files = list((tmp_path / "stream" / "raw").glob("part-*.parquet"))
    assert len(files) >= spark.sparkContext.defaultParallelism
