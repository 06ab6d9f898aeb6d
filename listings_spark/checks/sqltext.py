"""DuckDB renderings of the text rules, used to build the SQL twins."""

from __future__ import annotations

from listings_spark import constants as K
from listings_spark.functions.text import phrase_keys

ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&nbsp;": " ",
    "&copy;": "©", "&middot;": "·", "&eacute;": "é", "&amp;": "&",
}


def unescape(x: str) -> str:
    for entity, char in ENTITIES.items():
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def collapse(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[\s\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g'))"


def clean(x: str) -> str:
    return collapse(unescape(x))


def key(x: str) -> str:
    folded = (
        rf"regexp_replace(strip_accents({collapse(unescape(x))}), '[^\x00-\x7F]+', '', 'g')"
    )
    return f"trim(regexp_replace(lower({folded}), '[^a-z0-9]+', ' ', 'g'))"


def title(x: str) -> str:
    trimmed = f"regexp_replace({clean(x)}, '^[-–—| ]+|[-–—| ]+$', '', 'g')"
    return rf"regexp_replace({trimmed}, '(?i)\s+[-–—|]\s+Apply(?: Now)?$', '')"


def display(x: str) -> str:
    x = rf"regexp_replace({clean(x)}, '^[ ,\-|]+|[ ,\-|]+$', '', 'g')"
    x = rf"regexp_replace({x}, '(?i)\bUK Remote\b', 'Remote — United Kingdom', 'g')"
    # RE2 has no look-ahead; the places at hand end with the mark or go on with a space.
    x = rf"regexp_replace({x}, '(?i)\bU\.?K(\.$|\b)', 'United Kingdom', 'g')"
    x = rf"regexp_replace({x}, '(?i)\bRemote,? Europe\b', 'Remote — Europe', 'g')"
    return collapse(x)


def html_text(x: str) -> str:
    for tag in ("script", "style", "template", "rt", "rp"):
        x = rf"regexp_replace({x}, '(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?s)<[a-zA-Z/!][^>]*>', ' ', 'g')"
    return clean(unescape(x))


def any_phrase(k: str, phrases) -> str:
    return f"regexp_matches({k}, '(^| )({'|'.join(phrase_keys(phrases))})( |$)')"


def first_category(k: str) -> str:
    branches = "".join(
        f" WHEN {any_phrase(k, phrases)} THEN '{name}'"
        for name, phrases in K.CATEGORY_PHRASES.items()
    )
    return f"CASE{branches} END"


def employment(k: str) -> str:
    return (
        f"CASE WHEN {any_phrase(k, K.INTERNSHIP_PHRASES)} THEN 'internship'"
        f" WHEN {any_phrase(k, K.NEW_GRAD_PHRASES)} THEN 'new-grad' END"
    )


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def fallback(k: str) -> str:
    words = (
        f"list_filter(string_split({k}, ' '), lambda w: w <> ''"
        f" AND NOT regexp_matches(w, '^[0-9]+$')"
        f" AND NOT list_contains({sql_list(K.TITLE_NOISE_WORDS)}, w)"
        f" AND NOT list_contains({sql_list(K.FALLBACK_TITLE_WORDS)}, w))"
    )
    return f"(len({words}) = 0)"


def years(k: str, context: bool = False, cycle_only: bool = False) -> str:
    """List of years of a key; RE2 has no look-around, so positions are enumerated."""
    tests = [
        f"regexp_matches(substr({k}, i, 5), '^{K.YEAR_PATTERN}( |$)')",
        f"(i = 1 OR substr({k}, i - 1, 1) = ' ')",
    ]
    if context:
        terms = "|".join(K.CYCLE_CONTEXT_TERMS)
        gap = "{0,%d}" % K.YEAR_CONTEXT_GAP
        tests.append(
            rf"(regexp_matches(substr({k}, 1, i - 1), '\b(?:{terms})\b.{gap}$')"
            rf" OR regexp_matches(substr({k}, i + 4), '^.{gap}\b(?:{terms})\b'))"
        )
    if cycle_only:
        leads = "|".join(K.GRADUATE_LEADS)
        tests.append(
            f"NOT regexp_matches(substr({k}, 1, i - 1), '(?:class of|(?:{leads}) graduate"
            "(?: in| by)?|graduating(?: in| by)?|graduation(?: date)?(?: in| by)?) $')"
        )
    positions = f"list_filter(range(1, length({k}) + 1), lambda i: {' AND '.join(tests)})"
    return f"list_transform({positions}, lambda i: substr({k}, i, 4))"


def joined(values: str, sep: str = "|") -> str:
    return f"coalesce(array_to_string({values}, '{sep}'), '')"


def cycle(title_key: str, body_key: str, kind: str, target: int = K.TARGET_CYCLE) -> str:
    def pick(graduate: str, other: str) -> str:
        return f"CASE WHEN {kind} = 'new-grad' THEN {graduate} ELSE {other} END"

    titles = pick(years(title_key), years(title_key, cycle_only=True))
    bodies = pick(years(body_key, context=True), years(body_key, context=True, cycle_only=True))

    def conflict(ys: str) -> str:
        return f"list_filter({ys}, lambda y: y <> '{target}')[1]"

    def hit(ys: str) -> str:
        return f"CASE WHEN list_contains({ys}, '{target}') THEN '{target}' END"

    return (
        f"coalesce({conflict(titles)}, {hit(titles)}, {conflict(bodies)}, {hit(bodies)},"
        " 'unknown')"
    )


POLICY = f"TIMESTAMP '{K.MINIMUM_POSTED_AT}'"


def values(rows, columns: str, name: str) -> str:
    body = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS {name}({columns})"


def geo_ctes(source: str) -> str:
    """CTEs `place_raw`, `place_codes` and `geo` over (listing_id, place) with ";" lists."""
    countries = values(K.COUNTRY_NAMES.items(), "phrase, code", "n")
    cities = values(K.CITY_NAMES.items(), "phrase, code", "n")
    outside = any_phrase("k", K.NON_EUROPEAN_NAMES)
    tokens = "regexp_extract_all(concat(' ', raw2), '[^A-Za-z]([A-Z]{2})[^A-Za-z]', 1)"
    return f"""
place_split AS (
  SELECT listing_id, unnest(string_split(place, ';')) AS raw,
    unnest(range(1, len(string_split(place, ';')) + 1)) AS pos FROM {source}),
place_key AS (
  SELECT *, {key('raw')} AS k, {display('raw')} AS shown,
    regexp_replace(raw, '[^A-Za-z]', '  ', 'g') || ' ' AS raw2 FROM place_split),
place_ev AS (
  SELECT *, {tokens} AS tokens,
    {outside} OR list_has_any({tokens}, {sql_list(K.NON_EUROPEAN_CODES)}) AS outside,
    contains(k, 'europe') OR contains(k, 'emea') AS europe FROM place_key),
place_codes AS (
  SELECT DISTINCT listing_id, code FROM (
    SELECT listing_id, code FROM place_ev JOIN {countries}
      ON contains(' ' || k || ' ', ' ' || phrase || ' ')
    UNION ALL
    SELECT listing_id, code FROM place_ev JOIN {cities}
      ON contains(' ' || k || ' ', ' ' || phrase || ' ') WHERE NOT outside
    UNION ALL
    SELECT listing_id, code FROM (
      SELECT listing_id, unnest(tokens) AS code FROM place_ev)
      WHERE code IN ({", ".join(f"'{c}'" for c in K.EUROPEAN_CODES)}))),
code_list AS (
  SELECT listing_id, string_agg(code, ',' ORDER BY code) AS codes
  FROM place_codes GROUP BY listing_id),
shown AS (
  SELECT listing_id, string_agg(shown, '; ' ORDER BY pos) AS locations FROM (
    SELECT listing_id, shown, min(pos) AS pos FROM place_ev WHERE shown <> ''
    GROUP BY listing_id, shown) GROUP BY listing_id),
geo AS (
  SELECT p.listing_id, any_value(coalesce(s.locations, '')) AS locations,
    any_value(coalesce(c.codes, '')) AS codes,
    bool_or(europe) OR any_value(c.codes) IS NOT NULL AS europe_signal,
    bool_or(outside) AS non_europe_signal,
    any_value(c.codes) IS NOT NULL AS explicit
  FROM place_ev p LEFT JOIN code_list c USING (listing_id) LEFT JOIN shown s USING (listing_id)
  GROUP BY p.listing_id)"""


GEO_REASON = (
    f"CASE WHEN non_europe_signal AND NOT explicit THEN '{K.REASON_OUTSIDE_EUROPE}'"
    f" WHEN NOT (explicit OR europe_signal) THEN '{K.REASON_NOT_EUROPEAN}' END"
)


def cascade_ctes(source: str) -> str:
    """CTEs ending in `decided` over listing_raw-shaped rows."""
    other_cycle = K.REASON_OTHER_CYCLE.replace("%s", "' || cyc || '")
    unknown_cycle = K.REASON_UNKNOWN_CYCLE % K.TARGET_CYCLE
    generic = any_phrase("tk", K.OTHER_TECH_PHRASES)
    generic_body = any_phrase("bk", K.OTHER_TECH_PHRASES)
    return f"""
cleaned AS (SELECT *, {title('title')} AS clean_title,
  {html_text("coalesce(description, '')")} AS body FROM {source}),
keyed AS (SELECT *, {key('clean_title')} AS tk, {key('body')} AS bk FROM cleaned),
typed AS (SELECT *, {employment('tk')} AS typ,
  {any_phrase('tk', K.SENIORITY_PHRASES)} AS senior,
  coalesce({first_category('tk')}, CASE WHEN {generic} THEN 'other-tech' END,
    'unknown') AS tcat FROM keyed),
categorised AS (SELECT *, CASE WHEN tcat = 'unknown' AND {fallback('tk')}
  THEN coalesce({first_category('bk')}, CASE WHEN {generic_body} THEN 'other-tech' END,
    'unknown') ELSE tcat END AS cat FROM typed),
early AS (SELECT *, CASE WHEN typ IS NULL THEN '{K.REASON_NO_TYPE}'
  WHEN senior THEN '{K.REASON_SENIORITY}'
  WHEN cat = 'unknown' THEN '{K.REASON_NO_ROLE}' END AS early_reason FROM categorised),
cycled AS (SELECT *, {cycle('tk', 'bk', 'typ')} AS cyc FROM early),
{geo_ctes(source)},
decided AS (SELECT c.*, g.locations AS shown_locations, g.codes, coalesce(early_reason, CASE
    WHEN cyc = '{K.TARGET_CYCLE}' THEN NULL
    WHEN cyc <> 'unknown' THEN '{other_cycle}'
    WHEN posted_at IS NULL OR posted_at < {POLICY} THEN '{unknown_cycle}' END,
    {GEO_REASON}) AS exclusion_reason
  FROM cycled c JOIN geo g USING (listing_id))"""
