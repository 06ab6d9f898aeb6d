"""Fetched pages: search-result cards, detail records, closure notices.

A page table has one row per document (`html`). One Arrow function per page kind turns markup
into raw texts; identifiers, bounds, fallbacks, ages and gates are column expressions on its
output. Cheap card tests belong before details: Spark cannot move filters past the extractor.
"""

from __future__ import annotations

import functools
import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listings_spark import constants as K
from listings_spark.functions import temporal as D
from listings_spark.functions import text as X
from listings_spark.functions import urls as U

# Class names and attributes of the source markup.
CARD_FIELDS = {
    "title": "base-search-card__title",
    "company": "base-search-card__subtitle",
    "location": "job-search-card__location",
}
FIELD_OF = {css: name for name, css in CARD_FIELDS.items()}
NO_CARD = dict.fromkeys(CARD_FIELDS, "")
TITLE_CLASSES = {"top-card-layout__title", "topcard__title"}
COMPANY_CLASS = "topcard__org-name-link"
SUBLINE_CLASS = "top-card-layout__second-subline"
ROW_CLASS = "topcard__flavor-row"
BULLET_CLASS = "topcard__flavor--bullet"
DESCRIPTION_CLASS = "show-more-less-html__markup"
AGE_CLASS = "posted-time-ago__text"
HEADING_CLASS = "description__job-criteria-subheader"
HEADING_TAGS = {"dt", "h3"}
VALUE_CLASS_PART = "criteria-text"
CLOSED_CLASS = "closed-job__flavor--closed"
URN_ATTRIBUTE = "data-entity-urn"

_TEXT = T.StringType()
CARDS = T.ArrayType(T.StructType([
    T.StructField(n, _TEXT) for n in ("urn", "title", "company", "location")
]))
DETAIL = T.StructType([
    *[T.StructField(n, _TEXT) for n in ("title", "company", "location", "description", "age")],
    T.StructField("criteria", T.ArrayType(T.StructType([
        T.StructField("heading", _TEXT), T.StructField("value", _TEXT)
    ]))),
    T.StructField("alerts", T.ArrayType(_TEXT)),
])


# Attributes that are read; all others are passed over.
READ_ATTRIBUTES = frozenset({"class", URN_ATTRIBUTE, "aria-live", "role"})

# Plain markup: tags in small letters with quoted or bare attributes. One split takes a page apart.
_SPLIT = re.compile(r'<([^<>"]*+(?:"[^"<>]*"[^"<>]*+)*+)>')
_SPACE = r"[ \t\n\r\f]"
_PLAIN_TAG = re.compile(
    rf'(/?)([a-z][a-z0-9]*)((?:{_SPACE}+[a-zA-Z][a-zA-Z0-9_-]*(?:="[^"<>]*")?)*){_SPACE}*(/?)'
)
_ATTRIBUTE = re.compile(r'([a-zA-Z][a-zA-Z0-9_-]*)(="[^"<>]*")?')
_DOCTYPE = re.compile(r"\s*<!doctype[^<>]*>", re.IGNORECASE)
# Elements whose content parsers do not read as markup.
_RAW_ELEMENTS = frozenset({
    "script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "plaintext",
    "noscript",
})


class _Element:
    """One element: its place in document order, and the run of text nodes inside it."""

    __slots__ = ("tag", "attrs", "classes", "parent", "place", "end", "first", "last")

    def __init__(self, tag, attrs, classes, parent, place, first):
        self.tag, self.attrs, self.classes, self.parent = tag, attrs, classes, parent
        self.place, self.end = place, place + 1  # until it closes
        self.first = self.last = first


class _Page:
    """Elements and visible text nodes of one page, each in document order.

    No element refers to its page, so pages hold no cycles and go as soon as they are read.
    """

    __slots__ = ("elements", "texts")

    def __init__(self):
        self.elements = [_Element("", {}, (), None, 0, 0)]
        self.texts: list[str] = []

    def closed(self, element):
        element.end, element.last = len(self.elements), len(self.texts)
        return element.parent

    def inside(self, element):
        return map(self.elements.__getitem__, range(element.place + 1, element.end))

    def children(self, element):
        at = element.place + 1
        while at < element.end:
            yield self.elements[at]
            at = self.elements[at].end

    def text(self, element):
        """Visible text nodes of an element joined by spaces; none for no element."""
        if element is None:
            return ""
        text = " ".join(self.texts[element.first:element.last])
        return entities.unescape(text) if "&" in text else text


class _Tree(X.OpenElements):
    """Reads any markup into a page."""

    def __init__(self):
        super().__init__()
        self.page = _Page()
        self.here = self.page.elements[0]

    def _added(self, tag, attrs):
        page, attrs = self.page, dict(attrs)
        classes = (attrs.get("class") or "").split()
        element = _Element(tag, attrs, classes, self.here, len(page.elements), len(page.texts))
        page.elements.append(element)
        return element

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        element = self._added(tag, attrs)
        if tag not in K.VOID_ELEMENTS:
            self.here = element

    def handle_startendtag(self, tag, attrs):
        self._added(tag, attrs)

    def closed(self):
        self.here = self.page.closed(self.here)

    def handle_data(self, data):
        if not self.hidden:
            self.page.texts.append(data)


def _parsed(page: str) -> _Page:
    parser = _Tree()
    parser.feed(page)
    parser.close()
    while parser.here is not None:
        parser.closed()
    return parser.page


_END, _OPEN, _CHILDLESS = range(3)


@functools.lru_cache(4096)
def _plain_tag(text: str) -> tuple | None:
    """(kind, name, is hidden, read attributes, classes) of a tag; null when it is not plain."""
    found = _PLAIN_TAG.fullmatch(text)
    if not found:
        return None
    slash, tag, attributes, own_end = found.groups()
    if slash:
        return None if attributes or own_end else (_END, tag, False, None, None)
    read = {}
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in READ_ATTRIBUTES:
            if "&" in value:
                return None
            read[name] = value[2:-1] if value else None
    childless = own_end or tag in K.VOID_ELEMENTS
    if childless and tag in _RAW_ELEMENTS:
        return None
    classes = (read.get("class") or "").split()
    return _CHILDLESS if childless else _OPEN, tag, tag in X.HIDDEN_ELEMENTS, read, classes


def _plain(text: str) -> _Page | None:
    """What `_parsed` gives, for plain markup; null when anything in the page is not plain."""
    doctype = _DOCTYPE.match(text)
    parts = _SPLIT.split(text[doctype.end():] if doctype else text)
    if len(parts) // 2 + (doctype is not None) != text.count("<"):
        return None
    page = _Page()
    elements, texts = page.elements, page.texts
    here, hidden, raw = elements[0], 0, None
    counts: dict[str, int] = {}
    nodes = iter(parts)
    node = next(nodes)
    if node:
        texts.append(entities.unescape(node) if "&" in node else node)
    for inner, node in zip(nodes, nodes, strict=True):
        plain = _plain_tag(inner)
        if plain is None:
            return None
        kind, tag, hides, attrs, classes = plain
        if raw:
            if kind != _END or tag != raw:
                return None
            raw = None
        if kind == _END:
            # It closes all that it encloses; a stray one does nothing.
            while counts.get(tag):
                last = here.tag
                counts[last] -= 1
                hidden -= last in X.HIDDEN_ELEMENTS
                here.end, here.last, here = len(elements), len(texts), here.parent
                if last == tag:
                    break
        else:
            element = _Element(tag, attrs, classes, here, len(elements), len(texts))
            elements.append(element)
            if kind == _OPEN:
                here = element
                counts[tag] = counts.get(tag, 0) + 1
                hidden += hides
                if tag in _RAW_ELEMENTS:
                    raw = tag
        if node and not hidden:
            texts.append(entities.unescape(node) if "&" in node else node)
    if raw:
        return None
    while here is not None:
        here = page.closed(here)
    return page


def _read(text: str) -> _Page:
    """Any page; plain markup takes a short way to the same."""
    return _plain(text) or _parsed(text)


def _card_of(page: _Page, node: _Element) -> dict:
    """Fields of a card: for each the first element of its class, in one walk."""
    found = {"urn": node.attrs[URN_ATTRIBUTE]}
    for element in page.inside(node):
        for css in element.classes:
            name = FIELD_OF.get(css)
            if name and name not in found:
                found[name] = page.text(element)
        if len(found) > len(CARD_FIELDS):
            break
    return {**NO_CARD, **found}


def _cards_of(text: str) -> list[dict]:
    if URN_ATTRIBUTE not in text.lower():  # names of attributes are never escaped
        return []
    page = _read(text)
    return [
        _card_of(page, e) for e in page.elements
        if e.attrs and K.LISTING_URN in (e.attrs.get(URN_ATTRIBUTE) or "")
    ]


def _is_place(page: _Page, element: _Element) -> bool:
    """A bullet in a flavor row that is the first of its kind, inside the second subline."""
    row = element.parent
    while row is not None:
        if ROW_CLASS in row.classes and row.parent is not None:
            if next(x for x in page.children(row.parent) if x.tag == row.tag) is row:
                outer = row.parent
                while outer is not None:
                    if SUBLINE_CLASS in outer.classes:
                        return True
                    outer = outer.parent
        row = row.parent
    return False


def _criterion(page: _Page, heading: _Element) -> str:
    for element in page.inside(heading.parent):
        if element.tag == "dd" or VALUE_CLASS_PART in (element.attrs.get("class") or ""):
            value = page.text(element)
            if value.strip():
                return value
            break
    if heading.end == heading.parent.end:  # the last of its siblings
        return ""
    return page.text(page.elements[heading.end])


def _detail_of(text: str) -> dict:
    """Texts of a detail page, each of the first element that holds it."""
    page = _read(text)
    title = company = location = description = age = None
    headings, alerts = [], []
    for element in page.elements[1:]:
        classes = element.classes
        if classes:
            if title is None and not TITLE_CLASSES.isdisjoint(classes):
                title = element
            if company is None and COMPANY_CLASS in classes:
                company = element
            if location is None and BULLET_CLASS in classes and _is_place(page, element):
                location = element
            if description is None and DESCRIPTION_CLASS in classes:
                description = element
            if age is None and AGE_CLASS in classes:
                age = element
        if element.tag in HEADING_TAGS or HEADING_CLASS in classes:
            headings.append(element)
        attrs = element.attrs
        if attrs and (
            attrs.get("aria-live") == "assertive" or attrs.get("role") == "alert"
            or CLOSED_CLASS in classes
        ):
            alerts.append(element)
    return {
        "title": page.text(title), "company": page.text(company), "location": page.text(location),
        "description": None if description is None else page.text(description),
        "age": page.text(age),
        "criteria": [{"heading": page.text(h), "value": _criterion(page, h)} for h in headings],
        "alerts": [page.text(e) for e in alerts],
    }


@F.arrow_udf(CARDS)
def _extract_cards(pages: pa.Array) -> pa.Array:
    text = pa.string()
    card = pa.struct([(n, text) for n in ("urn", *CARD_FIELDS)])
    found = [None if p is None else _cards_of(p) for p in pages.to_pylist()]
    return pa.array(found, pa.list_(card))


@F.arrow_udf(DETAIL)
def _extract_detail(pages: pa.Array) -> pa.Array:
    text = pa.string()
    criterion = pa.struct([("heading", text), ("value", text)])
    kinds = {"criteria": pa.list_(criterion), "alerts": pa.list_(text)}
    detail = pa.struct([(n, kinds.get(n, text)) for n in DETAIL.names])
    found = [{} if p is None else _detail_of(p) for p in pages.to_pylist()]
    return pa.array(found, detail)


def is_blocked(page: Column) -> Column:
    """Authentication, challenge and block pages."""
    return F.lower(page).rlike("|".join(K.BLOCK_MARKERS))


def read_pages(spark, path: str, kind: str = "parquet") -> DataFrame:
    """Page table: parquet as stored, or raw files with their path as address."""
    if kind == "parquet":
        return spark.read.parquet(path)
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.col("path").alias("url"), F.col("content").cast("string").alias("html"),
        F.col("modificationTime").alias("observed_at"),
    )


def search_cards(pages: DataFrame, page: str = "html") -> DataFrame:
    """Pages with their cards and malformed count, one row per page, no shuffle.

    `status` is "blocked", "rejected" (more than half of the cards malformed) or "ok"; only ok
    pages keep cards.
    """

    def bounded(card: Column) -> Column:
        return F.struct(
            X.extract_id(card["urn"]).alias("listing_id"),
            *[X.collapse_space(card[n]).alias(n) for n in CARD_FIELDS],
        )

    def well_formed(card: Column) -> Column:
        return (
            card["listing_id"].isNotNull()
            & F.length(card["title"]).between(1, K.MAX_TITLE)
            & F.length(card["company"]).between(1, K.MAX_COMPANY)
            & F.length(card["location"]).between(1, K.MAX_LOCATION)
        )

    blocked = is_blocked(F.col(page))
    found = F.coalesce(_extract_cards(F.when(~blocked, F.col(page))), F.array().cast(CARDS))
    out = X.bind(
        pages.withColumn("_blocked", blocked), _all=F.transform(found, bounded)
    )
    out = X.bind(out, _good=F.filter("_all", well_formed))
    malformed = F.size("_all") - F.size("_good")
    status = F.when(F.col("_blocked"), "blocked").when(
        malformed * 2 > F.size("_all"), "rejected"
    ).otherwise("ok")
    return out.withColumn("malformed", malformed).withColumn("status", status).withColumn(
        "cards", F.when(status == "ok", F.col("_good")).otherwise(F.slice("_good", 1, 0))
    ).drop("_all", "_good", "_blocked")


def explode_cards(extracted: DataFrame) -> DataFrame:
    """One row per card of the accepted pages, in page order, with its public address."""
    kept = [c for c in extracted.columns if c not in ("cards", "html")]
    rows = extracted.select(*kept, F.posexplode("cards").alias("pos", "card"))
    return rows.select(*kept, "pos", "card.*").withColumn(
        "link", U.listing_link(F.col("listing_id"))
    )


def parse_details(details: DataFrame, page: str = "html") -> DataFrame:
    """Raw texts of each detail page in `_d`, and whether it is a block page.

    This is the only Python step; run it once per distinct page, before joining searches.
    """
    blocked = F.coalesce(is_blocked(F.col(page)), F.lit(False))
    return X.bind(
        details.withColumn("_blocked", blocked),
        _d=_extract_detail(F.when(~blocked, F.col(page))),
    )


def detail_records(details: DataFrame, page: str = "html") -> DataFrame:
    """Parsed detail pages completed with their card fields."""
    return complete_details(parse_details(details, page))


def complete_details(parsed: DataFrame) -> DataFrame:
    """Records from parsed details with per-field fallback to their card.

    Needs `listing_id`, `observed_at`, `card_title`, `card_company`, `card_location` and the
    output of `parse_details`. Adds the record fields, `closed_notice`, `identity_ok` and
    `problem`.
    """

    def own(name: str) -> Column:
        return X.collapse_space(F.col(f"_d.{name}"))

    def or_card(name: str) -> Column:
        return F.coalesce(
            F.nullif(F.col(f"_own_{name}"), F.lit("")), F.col(f"card_{name}"), F.lit("")
        )

    notice = F.exists(
        "_d.alerts", lambda a: F.contains(X.fold_key(a), F.lit(K.CLOSED_NOTICE))
    )
    hits = F.filter(
        "_d.criteria",
        lambda c: (X.fold_key(c["heading"]) == "industries")
        & (X.collapse_space(c["value"]) != ""),
    )
    described = F.when(
        F.col("_d.description").isNotNull(), X.collapse_space(F.col("_d.description"))
    )
    parsed = X.bind(
        parsed,
        _own_title=own("title"), _own_company=own("company"), _own_location=own("location"),
        description=described,
        industries=F.get(F.transform(hits, lambda c: X.collapse_space(c["value"])), 0),
        closed_notice=F.coalesce(notice, F.lit(False)),
        age_text=own("age"),
    )
    parsed = parsed.withColumns(
        {"title": or_card("title"), "company": or_card("company"),
         "location": or_card("location")}
    )
    too_long = (
        (F.length("title") > K.MAX_TITLE) | (F.length("company") > K.MAX_COMPANY)
        | (F.length("location") > K.MAX_LOCATION)
        | F.coalesce(F.length("description") > K.MAX_DESCRIPTION, F.lit(False))
    )
    problem = (
        F.when(F.col("_blocked"), "blocked")
        .when((F.col("title") == "") | (F.col("company") == ""), "identity")
        .when(too_long, "bounds")
    )
    identity = (
        ~F.col("_blocked")
        & F.length("_own_title").between(1, K.MAX_TITLE)
        & F.length("_own_company").between(1, K.MAX_COMPANY)
    )
    return parsed.withColumns(
        {
            "problem": problem,
            "identity_ok": F.coalesce(identity, F.lit(False)),
            "start_date": D.start_period(F.col("title"), F.col("description")),
            "posted_at": D.relative_age(F.col("age_text"), F.col("observed_at")),
            "link": U.listing_link(F.col("listing_id")),
        }
    ).drop("_blocked", "_d", "_own_title", "_own_company", "_own_location")
