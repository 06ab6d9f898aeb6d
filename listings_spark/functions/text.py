"""Text cleaning, comparison keys and phrase matching as Spark column expressions.

Everything stays in the JVM except markup removal, which goes through Arrow only for texts
that hold a tag; all other rows are passed as null.
"""

from __future__ import annotations

import functools
import html
import sys
import unicodedata
from html import entities
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listings_spark import constants as K

# Python's whitespace class, spelled for java.util.regex (whose \s is ASCII-only).
WHITESPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"


# A character reference as HTML reads it: numeric, or a name of up to 32 characters.
REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)"


def let(value: Column, body) -> Column:
    """Evaluate `value` once and pass it to `body` as a variable.

    Keeps expression trees small when a computed value is read several times. Python
    functions cannot stand inside `body`.
    """
    return F.get(F.transform(F.array(value), body), 0)


def quoted(value: str) -> str:
    """A string as SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def string_array(values) -> Column:
    """Array literal of strings, built in one expression."""
    return F.expr(f"array({', '.join(map(quoted, values))})")


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator that yields one row per row.

    Later filters and Python functions then read the finished values. Without this boundary
    the optimizer may copy a long expression into each place that uses it.
    """
    kept = [c for c in df.columns if c not in columns]
    bound = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*df.columns, bound.alias("_bound")).select(
        *kept, *[F.col(f"_bound.{n}").alias(n) for n in columns]
    )


@functools.cache
def _named_references() -> tuple[str, str]:
    """All named references as one searchable text, and a pattern of those that may stand
    without a semicolon, longest first."""
    table = "\x01" + "".join(f"{n}\x00{v}\x01" for n, v in entities.html5.items())
    bare = sorted((n for n in entities.html5 if not n.endswith(";")), key=len, reverse=True)
    return table, "|".join(bare)


def _named(body: Column) -> Column:
    """Value of a reference name, null when there is none."""
    table, _ = _named_references()
    at = F.call_function("instr", F.lit(table), F.concat(F.lit("\x01"), body, F.lit("\x00")))
    tail = F.substr(F.lit(table), at + F.length(body) + 2)
    known = body.rlike("^[A-Za-z0-9]+;?$") & (at > 0)
    return F.when(known, F.substring_index(tail, "\x01", 1))


def _numbered(number: Column) -> Column:
    """Character of a numeric reference; null numbers are out of range."""
    # References into the C1 block mean Windows-1252 characters.
    c1 = "".join(
        bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)
    )
    noncharacter = (
        number.between(0x1, 0x8) | number.isin(0xB, 0x7F) | number.between(0xE, 0x1F)
        | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    )
    return (
        F.when(
            number.isNull() | (number == 0) | number.between(0xD800, 0xDFFF)
            | (number > 0x10FFFF),
            F.lit("\ufffd"),
        )
        .when(number.between(0x80, 0x9F), F.substr(F.lit(c1), number - 0x7F, F.lit(1)))
        .when(noncharacter, F.lit(""))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    )


def _reference(reference: Column) -> Column:
    """Text of one character reference."""

    def numeric(ref: Column) -> Column:
        hexadecimal = F.regexp_extract(ref, "^&#[xX]0*([0-9a-fA-F]*)", 1)
        decimal = F.regexp_extract(ref, "^&#0*([0-9]*)", 1)
        number = F.when(
            ref.rlike("^&#[xX]"),
            F.when(
                F.length(hexadecimal) <= 6,
                F.coalesce(F.conv(F.nullif(hexadecimal, F.lit("")), 16, 10), F.lit("0")),
            ),
        ).otherwise(
            F.when(
                F.length(decimal) <= 7, F.coalesce(F.nullif(decimal, F.lit("")), F.lit("0"))
            )
        )
        return let(number.cast("int"), _numbered)

    def named(body: Column) -> Column:
        _, bare = _named_references()
        prefix = F.nullif(F.regexp_extract(body, f"(?s)^({bare})(.*)$", 1), F.lit(""))
        rest = F.regexp_extract(body, f"(?s)^({bare})(.*)$", 2)
        return F.coalesce(
            _named(body), F.concat(_named(prefix), rest), F.concat(F.lit("&"), body)
        )

    return (
        F.when(reference == "&amp;", F.lit("&"))
        .when(reference.startswith("&#"), numeric(reference))
        .otherwise(let(F.substr(reference, F.lit(2)), named))
    )


def _decoded(text: Column) -> Column:
    references = F.transform(
        F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), _reference
    )
    between = F.split(text, REFERENCE, -1)
    pieces = F.zip_with(
        between, references, lambda t, r: F.concat(t, F.coalesce(r, F.lit("")))
    )
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def decode_entities(value: Column) -> Column:
    """Decode HTML character references, once, inside the JVM."""
    return F.when(value.contains("&"), let(value, _decoded)).otherwise(value)


def decode_entity_items(values: Column) -> Column:
    """Decode HTML character references in every item of a string array."""
    return F.transform(values, _decoded)


def collapse_space(value: Column) -> Column:
    """Null to empty, every whitespace run to one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), WHITESPACE, " "))


def clean_text(value: Column) -> Column:
    """Decode entities and collapse whitespace."""
    return collapse_space(decode_entities(value))


# Elements whose text is not shown.
HIDDEN_ELEMENTS = frozenset({"script", "style", "template", "rt", "rp"})


class OpenElements(HTMLParser):
    """Keeps the names of open elements; an end tag closes all that it encloses."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.count: dict[str, int] = {}
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag not in K.VOID_ELEMENTS:
            self.stack.append(tag)
            self.count[tag] = self.count.get(tag, 0) + 1
            self.hidden += tag in HIDDEN_ELEMENTS

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        # A stray end tag does nothing.
        while self.count.get(tag):
            last = self.stack.pop()
            self.count[last] -= 1
            self.hidden -= last in HIDDEN_ELEMENTS
            self.closed()
            if last == tag:
                break

    def closed(self) -> None:
        """Called for each element that closes."""

    def updatepos(self, i, j):
        """Line numbers are never asked for; counting them costs a scan of all text."""
        return j


class _TextNodes(OpenElements):
    """Visible text nodes of a fragment, in document order."""

    def __init__(self) -> None:
        super().__init__()
        self.nodes: list[str] = []

    def handle_data(self, data):
        if not self.hidden:
            self.nodes.append(data)


def markup_to_text(fragment: str) -> str:
    """Text nodes of one fragment joined by spaces (whitespace is collapsed by the caller)."""
    parser = _TextNodes()
    parser.feed(fragment)
    parser.close()
    return html.unescape(" ".join(parser.nodes))


@F.pandas_udf(T.StringType())
def _strip_markup(values: pd.Series) -> pd.Series:
    return values.map(markup_to_text, na_action="ignore")


def html_to_text(value: Column) -> Column:
    """Visible text of an HTML fragment; only text with a tag leaves the JVM."""
    stripped = _strip_markup(F.when(value.contains("<"), value))
    # Without tags, reading the fragment and cleaning its text each decode references once.
    decoded = F.when(value.contains("&"), let(let(value, _decoded), _decoded)).otherwise(value)
    return collapse_space(
        F.coalesce(stripped, F.when(~value.contains("<"), decoded))
    )


@functools.cache
def _folding() -> tuple[str, str, str, list[str]]:
    """ASCII folding derived from Unicode compatibility decomposition.

    Returns one-to-one source and target characters, then the characters that expand to
    several ASCII characters with their expansions. Whitespace folds to a space. A
    decomposition without letters or digits also folds to a space, since keys treat every
    such run as one separator.
    """
    single_from, single_to, multi_from, multi_to = [], [], [], []
    for point in range(0x80, sys.maxunicode + 1):
        char = chr(point)
        if 0xD800 <= point <= 0xDFFF:
            continue
        if char.isspace():
            single_from.append(char)
            single_to.append(" ")
            continue
        folded = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if not folded:
            continue
        if not any(c.isalnum() for c in folded):
            folded = " "
        if len(folded) == 1:
            single_from.append(char)
            single_to.append(folded)
        else:
            multi_from.append(char)
            multi_to.append(folded)
    return "".join(single_from), "".join(single_to), "".join(multi_from), multi_to


def _character_class(chars: str) -> str:
    """Regex class of the given characters, written as ranges."""
    points = sorted(map(ord, chars))
    ranges: list[list[int]] = []
    for point in points:
        if ranges and point == ranges[-1][1] + 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "[" + "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in ranges) + "]"


def fold_ascii(value: Column) -> Column:
    """Reduce accented and compatibility characters to ASCII; drop what has no ASCII form."""
    single_from, single_to, multi_from, multi_to = _folding()
    expansions = F.split(F.lit("\n".join(multi_to)), "\n")
    multi = F.lit(_character_class(multi_from))

    def expand(text: Column, char: Column) -> Column:
        at = F.call_function("instr", F.lit(multi_from), char) - 1
        return F.replace(text, char, F.get(expansions, at))

    def finish(text: Column) -> Column:
        # What is left beyond ASCII is rare, so the wide class only sees those characters.
        rest = F.regexp_replace(text, r"[\x00-\x7F]+", "")
        present = F.array_distinct(F.regexp_extract_all(rest, multi, F.lit(0)))
        expanded = F.aggregate(present, text, expand)
        return F.regexp_replace(expanded, r"[^\x00-\x7F]+", "")

    def whole(text: Column) -> Column:
        return F.when(F.length(text) == F.octet_length(text), text).otherwise(finish(text))

    return let(F.translate(value, single_from, single_to), whole)


def fold_key(value: Column) -> Column:
    """Comparison key of text whose entities are already decoded."""

    def key(text: Column) -> Column:
        ascii_only = F.length(text) == F.octet_length(text)
        folded = F.when(ascii_only, text).otherwise(fold_ascii(text))
        return F.trim(F.regexp_replace(F.lower(folded), "[^a-z0-9]+", " "))

    return let(F.coalesce(value, F.lit("")), key)


def normalized_key(value: Column) -> Column:
    """Lower-case ASCII words separated by single spaces."""
    return fold_key(decode_entities(value))


def normalize_title(value: Column) -> Column:
    """Title without surrounding dashes or pipes and without a trailing apply suffix."""
    return title_from_clean(clean_text(value))


def title_from_clean(cleaned: Column) -> Column:
    """`normalize_title` for text that is already cleaned."""
    trimmed = F.regexp_replace(cleaned, r"^[-–—| ]+|[-–—| ]+$", "")
    return F.regexp_replace(trimmed, r"(?iU)\s+[-–—|]\s+Apply(?: Now)?$", "")


def display_location(value: Column) -> Column:
    """Display spelling of one location."""
    return location_from_decoded(decode_entities(value))


def location_from_decoded(value: Column) -> Column:
    """`display_location` for text whose entities are already decoded."""

    def respelled(text: Column) -> Column:
        text = F.regexp_replace(text, r"(?iU)\bUK Remote\b", "Remote — United Kingdom")
        text = F.regexp_replace(text, r"(?iU)\bU\.?K\.?(?=\b|$)", "United Kingdom")
        text = F.regexp_replace(text, r"(?iU)\bRemote,? Europe\b", "Remote — Europe")
        return collapse_space(text)

    def shown(text: Column) -> Column:
        # Most places hold none of the spellings; one plain test spares them the rewrites.
        return F.when(text.rlike(r"(?iu)u\.?k|remote"), respelled(text)).otherwise(F.trim(text))

    return let(F.regexp_replace(collapse_space(value), r"^[ ,\-|]+|[ ,\-|]+$", ""), shown)


def _padded(key: Column) -> Column:
    return F.concat(F.lit(" "), key, F.lit(" "))


def contains_phrase(key: Column, phrase: Column | str) -> Column:
    """Whole-phrase containment on keys; an empty phrase never matches."""
    other = F.lit(phrase) if isinstance(phrase, str) else phrase
    return (other != "") & F.contains(_padded(key), _padded(other))


@functools.cache
def _key_of(phrase: str) -> str:
    decoded = unicodedata.normalize("NFKD", html.unescape(phrase))
    ascii_text = decoded.encode("ascii", "ignore").decode().lower()
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in ascii_text)
    return " ".join(words.split())


def phrase_keys(phrases) -> list[str]:
    """Keys of a short literal phrase list, first spelling kept, order kept."""
    return list(dict.fromkeys(k for k in map(_key_of, phrases) if k))


def contains_any(key: Column, phrases) -> Column:
    """True when any phrase of a short literal list occurs in the key.

    A phrase that contains another phrase of the list as whole words adds nothing and is
    left out. Lists held in tables go through `operators.phrases` instead.
    """
    keys = phrase_keys(phrases)
    kept = [k for k in keys if not any(o != k and f" {o} " in f" {k} " for o in keys)]
    if not kept:
        return F.lit(False)
    return key.rlike(f"(?:^| )(?:{'|'.join(kept)})(?: |$)")


def title_allowed(
    title: Column,
    internship_terms=K.PREFILTER_INTERNSHIP_TERMS,
    new_grad_terms=K.PREFILTER_NEW_GRAD_TERMS,
) -> Column:
    """Cheap card-title test made before the costly detail step."""
    return contains_any(normalized_key(title), (*internship_terms, *new_grad_terms))


def extract_id(urn: Column) -> Column:
    """Digits of a trailing listing URN, null when there are none."""
    label = K.LISTING_URN.rsplit(":", 2)[1]
    found = F.regexp_extract(urn, rf"{label}:([0-9]{{1,{K.MAX_ID_DIGITS}}})$", 1)
    return F.nullif(found, F.lit(""))


def category_label(slug: Column) -> Column:
    """Kebab-case slug as words with initial capitals."""
    words = F.split(slug, "-")
    return F.array_join(
        F.transform(
            words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), _rest(w))
        ),
        " ",
    )


def _rest(word: Column) -> Column:
    return F.when(F.length(word) > 1, F.substr(word, F.lit(2))).otherwise(F.lit(""))


def text_search(columns, query: Column | str) -> Column:
    """Case-insensitive substring test over several columns; empty values are skipped."""
    needle = F.lit(query) if isinstance(query, str) else query
    needle = F.lower(F.regexp_replace(needle, rf"^{WHITESPACE}|{WHITESPACE}$", ""))
    haystack = F.lower(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in columns]))
    return (needle == "") | F.contains(haystack, needle)


def config_hash(columns: dict[str, Column]) -> Column:
    """SHA-256 over key-sorted compact JSON of the given columns."""
    pairs = [columns[name].alias(name) for name in sorted(columns)]
    return F.sha2(F.to_json(F.struct(*pairs), {"ignoreNullFields": "false"}), 256)
