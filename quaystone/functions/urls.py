"""URL identities. All are column expressions; none needs Python."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_URL = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(\?([^#]*))?"
#: Parameters that carry tracking, not identity.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|yclid|mc_cid|mc_eid)(=|$)"
TRACKING_LOOSE = r"^(utm_[^=]*|gclid|fbclid)(=|$)"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 5 query; empty if there is none."""
    return F.regexp_extract(url, _URL, n)


def valid(url: Column) -> Column:
    return url.isNotNull() & url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]")


def _params(url: Column, drop: str) -> Column:
    return F.filter(F.split(part(url, 5), "&"), lambda p: (p != "") & ~p.rlike(drop))


def canonical_serp_url(url: Column) -> Column:
    """no fragment or tracking, host in lower case, no trailing slash but the root's, parameters sorted. Invalid: null."""
    path = F.when(part(url, 3).isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(part(url, 3), "/+$", ""))
    kept = F.array_join(F.array_sort(_params(url, TRACKING)), "&")
    return F.when(valid(url), F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def canonical_url(url: Column) -> Column:
    """no fragment, no utm/gclid/fbclid, root path given as a slash; parameters keep their order. Invalid: null."""
    kept = F.array_join(_params(url, TRACKING_LOOSE), "&")
    path = F.when(part(url, 3) == "", F.lit("/")).otherwise(part(url, 3))
    return F.when(valid(url), F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def citation_url(url: Column) -> Column:
    """The page a citation names: no fragment, no utm parameters, no trailing slash but the root's; parameters keep their order. Invalid: null."""
    path = F.when(part(url, 3).rlike("^/*$"), F.lit("/")).otherwise(F.regexp_replace(part(url, 3), "/+$", ""))
    kept = F.array_join(_params(url, "(?i)^utm_"), "&")
    return F.when(valid(url), F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def page_key(url: Column) -> Column:
    """scheme, host and path without a trailing slash."""
    path = F.regexp_replace(part(url, 3), "/+$", "")
    return F.when(valid(url), F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), F.when(path == "", "/").otherwise(path)))


def host(url: Column) -> Column:
    """F8: the host without ``www.``."""
    return F.when(valid(url), F.regexp_replace(F.lower(part(url, 2)), r"^www\.", ""))


def first_directory(url: Column) -> Column:
    """F8: host and first path segment; null for the root."""
    segment = F.regexp_extract(part(url, 3), "^/([^/]+)", 1)
    return F.when(valid(url) & (segment != ""), F.concat(host(url), F.lit("/"), segment, F.lit("/")))


def is_redacted(url: Column) -> Column:
    """a placeholder is no identity, whether percent-encoded or not."""
    plain = F.regexp_replace(F.regexp_replace(url, "(?i)%3C", "<"), "(?i)%3E", ">")
    return F.coalesce(plain.rlike(r"(?i)<redacted([-_][^<>]*)?>"), F.lit(False))
