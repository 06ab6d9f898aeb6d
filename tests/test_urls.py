import random
from urllib.parse import parse_qsl, quote, urlencode, urlsplit

from pyspark.sql import functions as F

from listings_spark import constants as K
from listings_spark.functions import urls as U


def test_canonical_cases(values):
    cases = {
        " https://EXAMPLE.com:443/jobs/?b=2&utm_source=x&A=1&trk=z#frag ":
            ("https://example.com/jobs?A=1&b=2", None),
        "https://example.com": ("https://example.com/", None),
        "https://example.com:8443/a b/ü?q=a+b&e=&x=%zz~*":
            ("https://example.com:8443/a%20b/%C3%BC?e=&q=a+b&x=%25zz~%2A", None),
        "http://example.com/": (None, "scheme"),
        "https://localhost/x": (None, "host"),
        "https://printer.local/": (None, "host"),
        "https://intranet/": (None, "host"),
        "https://127.0.0.1/": (None, "host"),
        "https://10.0.0.8/": (None, "host"),
        "https://8.8.8.8/dns": ("https://8.8.8.8/dns", None),
        "https://[2001:4860:4860::8888]/": ("https://[2001:4860:4860::8888]/", None),
        "https://[::1]/": (None, "host"),
        "https://user:pw@example.com/": (None, "credentials"),
        "https://example.com:99999/": (None, "port"),
        "https://example.com:x/": (None, "port"),
        "https://bücher.example/": ("https://xn--bcher-kva.example/", None),
        "https://bad_label.example/": (None, "host"),
        "https://example.com./a/": ("https://example.com/a", None),
        "": (None, "empty"),
        "https://[::1/": (None, "malformed"),
    }
    got = values(list(cases), U.canonicalize)
    assert {k: (g["url"], g["reason"]) for k, g in zip(cases, got)} == cases


def test_canonical_against_standard_library(values):
    rng = random.Random(4)
    parts = ["a", "B", "%20", "+", "é", "=", "&", "~", "*", "%", "utm_x=1", "ref=2", "k=v", "'",
             "(", "|", "\"", "/", ":", "@", ","]
    items = []
    for _ in range(600):
        path = "".join(rng.choices(parts, k=rng.randrange(6))).replace("&", "")
        query = "".join(rng.choices(parts, k=rng.randrange(9)))
        items.append(f"https://Example.com/{path}?{query}")

    def expected(url):
        parsed = urlsplit(url)
        pairs = [
            (k, v) for k, v in parse_qsl(parsed.query, keep_blank_values=True)
            if k.lower() not in K.TRACKING_PARAMETERS and not k.lower().startswith("utm_")
        ]
        pairs.sort(key=lambda p: (p[0].lower(), p[1]))
        path = quote(parsed.path, safe="/%:@!$&'()*+,;=-._~").rstrip("/") or "/"
        return "https://example.com" + path + ("?" + urlencode(pairs) if pairs else "")

    assert [g["url"] for g in values(items, U.canonicalize)] == [expected(u) for u in items]


def test_link_identity(spark):
    rows = [
        ("1", "https://www.linkedin.com/jobs/view/1", True),
        ("1", "https://WWW.LinkedIn.com:443/jobs/view/1/?trackingId=x#top", True),
        ("1", "https://www.linkedin.com/jobs/view/2", False),
        ("1", "https://www.linkedin.com/jobs/view/1?lang=en", False),
        ("1", "https://evil.example/jobs/view/1", False),
        ("x", "https://www.linkedin.com/jobs/view/x", False),
        ("1", None, False),
    ]
    df = spark.createDataFrame(rows, "id string, link string, ok boolean")
    got = df.select("ok", U.link_matches_identity(F.col("link"), F.col("id")).alias("g")).collect()
    assert [r["g"] for r in got] == [r["ok"] for r in got]
