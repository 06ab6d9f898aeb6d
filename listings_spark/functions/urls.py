"""Public-address checks and canonical addresses as Spark column expressions.

Only hosts that are IP literals or hold non-ASCII characters go through Arrow.
"""

from __future__ import annotations

import ipaddress
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listings_spark import constants as K
from listings_spark.functions import arrays as A
from listings_spark.functions import text as X

_LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
DNS_NAME = rf"^(?=.{{1,253}}$){_LABEL}(?:\.{_LABEL})+$"
ADDRESS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

_HOST = T.StructType([
    T.StructField("ascii", T.StringType()),
    T.StructField("is_global", T.BooleanType()),
])


def _special_host(host: str | None) -> tuple[str | None, bool | None]:
    """ASCII form of a host, and whether an IP literal is globally reachable."""
    if host is None:
        return None, None
    try:
        return host, ipaddress.ip_address(host).is_global
    except ValueError:
        pass
    try:
        return host.encode("idna").decode("ascii"), None
    except UnicodeError:
        return None, False


@F.pandas_udf(_HOST)
def _resolve_special(hosts: pd.Series) -> pd.DataFrame:
    rows = [_special_host(None if pd.isna(h) else h) for h in hosts]
    return pd.DataFrame(rows, columns=["ascii", "is_global"]).astype(
        {"ascii": object, "is_global": object}
    )


def _special(host: Column) -> Column:
    return host.rlike(r"[^\x00-\x7F]|:|^[0-9.]+$")


def _facts(host: Column, resolved: Column) -> Column:
    """Struct of the ASCII host and whether it is public; `host` is lower-case, undotted."""
    ascii_host = F.when(_special(host), resolved["ascii"]).otherwise(host)
    local = host.isin("localhost", "localhost.localdomain") | host.endswith(".local")
    public = ~local & F.coalesce(
        F.when(_special(host), resolved["is_global"]), ascii_host.rlike(DNS_NAME), F.lit(False)
    )
    return F.struct(ascii_host.alias("ascii"), F.coalesce(public, F.lit(False)).alias("public"))


def is_public_host(host: Column) -> Column:
    """Syntactically valid public DNS name or globally reachable IP address."""
    name = F.lower(F.rtrim(host, F.lit(".")))
    bound = F.struct(
        name.alias("name"), _resolve_special(F.when(_special(name), name)).alias("resolved")
    )
    return X.let(bound, lambda b: _facts(b["name"], b["resolved"])["public"])


def _quote_path(path: Column) -> Column:
    """Percent-encode what may not stand in a path; existing escapes are kept."""
    encoded = F.url_encode(path)
    encoded = F.replace(encoded, F.lit("+"), F.lit("%20"))
    for char in "/:@!$&'()+,;=~":
        encoded = F.replace(encoded, F.lit(f"%{ord(char):02X}"), F.lit(char))
    encoded = F.replace(encoded, F.lit("%25"), F.lit("%"))
    clean = path.rlike(r"^[A-Za-z0-9/%:@!$&'()*+,;=\-._~]*$")
    return F.when(clean, path).otherwise(encoded)


def _decode_part(part: Column) -> Column:
    # A percent sign that starts no escape stands for itself.
    return F.url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode_part(part: Column) -> Column:
    encoded = F.replace(F.url_encode(part), F.lit("%7E"), F.lit("~"))
    return F.replace(encoded, F.lit("*"), F.lit("%2A"))


def canonical_query(query: Column, extra_tracking=()) -> Column:
    """Query without tracking parameters, sorted by lower-case key, then value."""
    ignored = sorted({*K.TRACKING_PARAMETERS, *(p.lower() for p in extra_tracking)})

    def pair(item: Column, position: Column) -> Column:
        parts = F.split(item, "=", 2)
        key = _decode_part(F.get(parts, 0))
        value = _decode_part(F.coalesce(F.get(parts, 1), F.lit("")))
        return F.struct(
            F.lower(key).alias("lower_key"), value.alias("value"),
            position.alias("position"), key.alias("key"),
        )

    items = F.filter(F.split(query, "&"), lambda x: x != "")
    pairs = F.filter(
        F.transform(items, pair),
        lambda p: ~p["lower_key"].isin(*ignored)
        & ~p["lower_key"].startswith(K.TRACKING_PREFIX),
    )
    rendered = F.transform(
        F.array_sort(pairs),
        lambda p: F.concat(_encode_part(p["key"]), F.lit("="), _encode_part(p["value"])),
    )
    return F.array_join(rendered, "&")


def _candidate(url: Column) -> Column:
    stripped = F.coalesce(A.strip_space(url), F.lit(""))
    return F.regexp_replace(stripped, r"[\t\r\n]|^[\x00-\x20]+", "")


def _host_info(candidate: Column) -> Column:
    """Host and port part of an address, without user information."""
    return F.regexp_replace(F.regexp_extract(candidate, ADDRESS, 2), "^.*@", "")


def _host_name(host_info: Column) -> Column:
    named = F.when(
        host_info.startswith("["), F.regexp_extract(host_info, r"^\[([^\]]*)\]", 1)
    ).otherwise(F.regexp_extract(host_info, "^([^:]*)", 1))
    return F.rtrim(F.lower(named), F.lit("."))


def split_address(url: Column) -> Column:
    """Struct of the parts of an address; absent parts are empty."""

    def parts(candidate: Column) -> Column:
        def group(n: int) -> Column:
            return F.regexp_extract(candidate, ADDRESS, n)

        def with_host(info: Column) -> Column:
            port = F.when(
                info.startswith("["), F.regexp_extract(info, r"^\[[^\]]*\]:(.*)$", 1)
            ).otherwise(F.regexp_extract(info, "^[^:]*:(.*)$", 1))
            return F.struct(
                (candidate == "").alias("empty"),
                F.lower(group(1)).alias("scheme"),
                F.contains(group(2), F.lit("@")).alias("userinfo"),
                (F.contains(info, F.lit("[")) != F.contains(info, F.lit("]"))).alias(
                    "unbalanced"
                ),
                _host_name(info).alias("host"),
                port.alias("port"),
                group(3).alias("path"),
                group(4).alias("query"),
            )

        return X.let(_host_info(candidate), with_host)

    return X.let(_candidate(url), parts)


def canonicalize(url: Column, extra_tracking=()) -> Column:
    """Struct (url, reason): the canonical HTTPS address, or why it is refused."""

    def result(bound: Column) -> Column:
        parts, facts = bound["parts"], bound["facts"]
        host, port_text = parts["host"], parts["port"]
        port = port_text.try_cast("int")
        port_ok = (port_text == "") | (
            port_text.rlike("^[0-9]+$") & F.coalesce(port <= 65535, F.lit(False))
        )
        reason = (
            F.when(parts["empty"], "empty")
            .when(parts["unbalanced"], "malformed")
            .when(parts["scheme"] != "https", "scheme")
            .when((host == "") | ~facts["public"], "host")
            .when(parts["userinfo"], "credentials")
            .when(~port_ok, "port")
        )
        name = F.when(
            F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]"))
        ).otherwise(facts["ascii"])
        shown_port = F.when(
            (port_text != "") & (port != 443), F.concat(F.lit(":"), port.cast("string"))
        ).otherwise(F.lit(""))
        path = X.let(
            F.rtrim(_quote_path(parts["path"]), F.lit("/")),
            lambda p: F.when(p == "", F.lit("/")).otherwise(p),
        )
        query = X.let(
            canonical_query(parts["query"], extra_tracking),
            lambda q: F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)),
        )
        full = F.concat(F.lit("https://"), name, shown_port, path, query)
        return X.let(
            reason, lambda r: F.struct(F.when(r.isNull(), full).alias("url"), r.alias("reason"))
        )

    def with_facts(pair: Column) -> Column:
        parts = pair["parts"]
        return F.struct(
            parts.alias("parts"), _facts(parts["host"], pair["resolved"]).alias("facts")
        )

    # Arguments of the Arrow function are plain expressions: it cannot read variables.
    host = _host_name(_host_info(_candidate(url)))
    bound = F.struct(
        split_address(url).alias("parts"),
        _resolve_special(F.when(_special(host), host)).alias("resolved"),
    )
    return X.let(X.let(bound, with_facts), result)


def listing_link(listing_id: Column, prefix: str = K.LISTING_URL_PREFIX) -> Column:
    """The one public address of a listing."""
    return F.concat(F.lit(prefix), listing_id)


def link_matches_identity(
    link: Column, listing_id: Column, prefix: str = K.LISTING_URL_PREFIX
) -> Column:
    """Whether the canonical form of a link is exactly the address of its own listing.

    The host is one fixed ASCII name, so plain comparisons decide and no address is resolved.
    """
    numeric = listing_id.rlike(f"^[0-9]{{1,{K.MAX_ID_DIGITS}}}$")
    fixed = urlsplit(prefix)

    def same(parts: Column) -> Column:
        port = parts["port"]
        path = F.rtrim(_quote_path(parts["path"]), F.lit("/"))
        return (
            ~parts["empty"] & ~parts["unbalanced"] & ~parts["userinfo"]
            & (parts["scheme"] == fixed.scheme)
            & (F.lower(F.rtrim(parts["host"], F.lit("."))) == fixed.hostname)
            & ((port == "") | (port.rlike("^[0-9]+$") & F.coalesce(port.try_cast("int") == 443, F.lit(False))))
            & (path == F.concat(F.lit(fixed.path), listing_id))
            & (canonical_query(parts["query"], ()) == "")
        )

    return F.coalesce(numeric & X.let(split_address(link), same), F.lit(False))
