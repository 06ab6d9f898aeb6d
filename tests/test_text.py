import html
import random
import re
import unicodedata
from html import entities

import pytest

from listings_spark.functions import text as X

PIECES = [
    "é", "Straße", "ﬁ", "½", "™", "…", "①", "𝐀", "漢字", " ", " ", "\x1c", "\x85",
    "&amp;", "&eacute;", "&amp;amp;", "&#39;", "a", "B", " ", "-", "Ⅷ", "㎏", "İ", "ı", "ſ",
    "\t\n", "co-op", "C++", "naïve", "Ångström", "x̂", "?", "2027", "ǆ", "℡", " ", "😀",
]


def spelled(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randrange(1, 12))) for _ in range(n)]


def plain_key(value):
    text = re.sub(r"\s+", " ", html.unescape(value)).strip()
    folded = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return " ".join(re.findall("[a-z0-9]+", folded))


@pytest.mark.parametrize("seed", [1, 2])
def test_normalized_key_matches_unicode_folding(values, seed):
    items = spelled(seed, 1500)
    assert values(items, X.normalized_key) == [plain_key(x) for x in items]


def test_every_folding_character(values):
    chars = [chr(p) for p in range(0x80, 0x1F000) if not 0xD800 <= p <= 0xDFFF
             and unicodedata.normalize("NFKD", chr(p)) != chr(p)]
    items = ["".join(chars[i:i + 40]) for i in range(0, len(chars), 40)]
    assert values(items, X.normalized_key) == [plain_key(x) for x in items]


def test_clean_text(values):
    items = [*spelled(3, 300), "", None]
    want = [re.sub(r"\s+", " ", html.unescape(x)).strip() if x else "" for x in items]
    assert values(items, X.clean_text) == want


def test_character_references(values):
    rng = random.Random(9)
    names = [*entities.html5, "amp", "ampx", "notit;", "copyy;", "unknown;", "lt", "l", "frac12x",
             "#0", "#13", "#x80", "#x9f;", "#129;", "#xD800;", "#x110000;", "#99999999999;", "#11;",
             "#xFFFE;", "#x1FFFF;", "#x1F600;", "#", "#x", "#xG", "#65", "#x41;", "&amp;amp;", "", ";",
             "é;", "a" * 40, "#0000000000065;", "#127;", "#64976;", "amp;lt;", "x\x00y;", "#x0"]
    items = ["&" + n for n in names]
    items += ["".join(f"{rng.choice(['', ' ', 'x', '&', '<'])}&{rng.choice(names)}"
              for _ in range(rng.randrange(1, 5))) for _ in range(1500)]
    items += ["no reference", "&", "a && b", "tail &", ""]
    assert values(items, X.decode_entities) == [html.unescape(x) for x in items]


def test_html_to_text(values):
    items = [
        "<p>One<b>two</b></p>three", "a &lt; b", "<script>var x = '</p>';</script>Text",
        "<ruby>k<rt>kan</ruby> more", "<p>open <i>never closed", "no markup", None,
        "x<!-- gone -->y", "<template><p>t</p></template>z", "1 < 2 and 3 > 2",
        "<a title='a>b'>link</a>", "&amp;lt;b&amp;gt;", "<br>line<br/>line",
    ]
    assert values(items, X.html_to_text) == [
        "One two three", "a < b", "Text", "k more", "open never closed", "no markup", "",
        "x y", "z", "1 < 2 and 3 > 2", "link", "<b>", "line line",
    ]


def test_normalize_title(values):
    items = ["– Software Intern – Apply Now", "Intern | apply", "R&amp;D | Intern |",
             "Apply Now", "Intern - Apply Nowhere"]
    assert values(items, X.normalize_title) == [
        "Software Intern", "Intern", "R&D | Intern", "Apply Now", "Intern - Apply Nowhere",
    ]


def test_display_location(values):
    items = ["London, UK", "uk remote", "U.K.", "Remote Europe", " ,Paris- ", "éUK", "UKraine",
             "U.K., Leeds"]
    assert values(items, X.display_location) == [
        "London, United Kingdom", "Remote — United Kingdom", "United Kingdom",
        "Remote — Europe", "Paris", "éUK", "UKraine", "United Kingdom., Leeds",
    ]


def test_phrases(values):
    items = ["intern", "internal audit", "summer intern team", "co op", ""]
    assert values(items, lambda c: X.contains_any(c, ["intern", "Co-Op"])) == [
        True, False, True, True, False
    ]
    assert values(items, lambda c: X.contains_phrase(c, "")) == [False] * 5


def test_extract_id(values):
    items = ["urn:li:jobPosting:123", "urn:li:jobPosting:12a", "jobPosting:" + "1" * 31, None]
    assert values(items, X.extract_id) == ["123", None, None, None]


def test_category_label(values):
    assert values(["data-science", "a", "other-tech"], X.category_label) == [
        "Data Science", "A", "Other Tech"
    ]
