from datetime import datetime

import pytest

from listings_spark import constants as K
from listings_spark.functions import cascade as C

FRESH, OLD = datetime(2026, 6, 1), datetime(2026, 4, 30, 23, 59)
CASES = [
    # title, description, locations, posted, include, category, type, reason
    ("Software Engineering Intern 2027", "", ["London, UK"], None,
     True, "software-engineering", "internship", None),
    ("Software Engineer", "internship", ["Berlin, Germany"], FRESH,
     False, "unknown", None, K.REASON_NO_TYPE),
    ("Senior Software Intern 2027", "", ["Berlin"], FRESH,
     False, "unknown", None, K.REASON_SENIORITY),
    ("Marketing Intern 2027", "software", ["Berlin"], FRESH,
     False, "unknown", None, K.REASON_NO_ROLE),
    ("Summer Intern 2027", "<p>machine learning</p>", ["Paris"], None,
     True, "machine-learning", "internship", None),
    ("Technology Intern 2027", "nothing here", ["Paris"], None,
     True, "other-tech", "internship", None),
    ("Co-op Technology 2027", "software", ["Paris"], None,
     False, "unknown", None, K.REASON_NO_ROLE),
    ("Software Intern 2026", "cycle 2027", ["Paris"], FRESH,
     False, "software-engineering", "internship", K.REASON_OTHER_CYCLE % 2026),
    ("Software Intern", "internship 2025 and 2026", ["Paris"], FRESH,
     False, "software-engineering", "internship", K.REASON_OTHER_CYCLE % 2025),
    ("Software Intern (class of 2028)", "summer 2027", ["Paris"], None,
     True, "software-engineering", "internship", None),
    ("Graduate Software Engineer class of 2028", "", ["Paris"], FRESH,
     False, "software-engineering", "new-grad", K.REASON_OTHER_CYCLE % 2028),
    ("Software Intern", "no year", ["Paris"], FRESH,
     True, "software-engineering", "internship", None),
    ("Software Intern", "no year", ["Paris"], OLD,
     False, "software-engineering", "internship", K.REASON_UNKNOWN_CYCLE % 2027),
    ("Software Intern", None, ["Paris"], None,
     False, "software-engineering", "internship", K.REASON_UNKNOWN_CYCLE % 2027),
    ("Software Intern 2027", "", ["London, Ontario, Canada"], FRESH,
     False, "software-engineering", "internship", K.REASON_OUTSIDE_EUROPE),
    ("Software Intern 2027", "", ["Paris, TX"], FRESH,
     False, "software-engineering", "internship", K.REASON_OUTSIDE_EUROPE),
    ("Software Intern 2027", "", ["New York", "Dublin, IE"], FRESH,
     True, "software-engineering", "internship", None),
    ("Software Intern 2027", "", ["Somewhere"], FRESH,
     False, "software-engineering", "internship", K.REASON_NOT_EUROPEAN),
    ("Software Intern 2027", "", ["EMEA remote"], FRESH,
     True, "software-engineering", "internship", None),
    ("Software Intern 2027", "", [], FRESH,
     False, "software-engineering", "internship", K.REASON_NOT_EUROPEAN),
    ("Security Engineer &amp; Data Science Intern 2027", "", ["Zürich"], FRESH,
     True, "cybersecurity", "internship", None),
    ("Graduate Software Intern 2027", "", ["Belfast, Northern Ireland"], FRESH,
     True, "software-engineering", "internship", None),
]


@pytest.fixture(scope="module")
def decided(spark):
    rows = [(i, *c[:4]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(
        rows,
        "i int, title string, description string, locations array<string>,"
        " posted_at timestamp_ntz",
    )
    return {r["i"]: r for r in C.classify(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_decision(decided, i):
    d = decided[i]["decision"]
    assert (d["include"], d["category"], d["employment_type"], d["exclusion_reason"]) == CASES[i][4:]


def test_geo_codes(decided):
    assert decided[21]["geo"]["country_codes"] == ["GB", "IE"]
    assert decided[16]["geo"]["country_codes"] == ["IE"]
    assert decided[0]["geo"]["locations"] == ["London, United Kingdom"]


def test_filter_on_decision_computes_rules_once(spark):
    rows = [("Software Intern 2027", "x", ["Paris"], None)]
    df = spark.createDataFrame(
        rows, "title string, description string, locations array<string>, posted_at timestamp_ntz"
    )
    plan = C.classify(df).filter("decision.include")._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("industrial placement") == 1


def test_rules_from_a_table_classify_like_their_literals(spark):
    from listings_spark import constants as K
    from listings_spark.functions.cascade import classify
    from listings_spark.operators import phrases as P

    lists = {"internship": K.INTERNSHIP_PHRASES, "new_grad": K.NEW_GRAD_PHRASES, "seniority": K.SENIORITY_PHRASES}
    rows = [(kind, None, i, p) for kind, phrases in lists.items() for i, p in enumerate(phrases)]
    at = 0
    for category, phrases in K.CATEGORY_PHRASES.items():
        for p in phrases:
            rows.append(("category", category, at, p))
            at += 1
    rules = P.rule_literals(
        P.rule_dictionary(spark.createDataFrame(rows, "kind string, category string, position int, phrase string"))
    )
    titles = ["Data Science Intern", "Senior Intern", "Graduate Programme Finance", "Intern", "Trainee, Cloud 2027"]
    raw = spark.createDataFrame(
        [(str(i), t, "Python and big data", ["Madrid, Spain"], None) for i, t in enumerate(titles)],
        "listing_id string, title string, description string, locations array<string>, posted_at timestamp_ntz",
    )
    assert classify(raw, **rules).collect() == classify(raw).collect()
    only = [("category", "harps", 0, "harp tuning and quiet stage rehearsal work")]
    own = P.rule_literals(
        P.rule_dictionary(spark.createDataFrame(only, "kind string, category string, position int, phrase string"))
    )
    assert own == {"categories": {"harps": [only[0][3]]}}
    many = [("seniority", None, i, f"word{i}") for i in range(K.MAX_PHRASES_PER_LIST + 1)]
    with pytest.raises(ValueError, match="more than"):
        P.rule_literals(
            P.rule_dictionary(spark.createDataFrame(many, "kind string, category string, position int, phrase string"))
        )
