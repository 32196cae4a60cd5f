"""URL column functions.

Parsing uses the generic syntax of RFC 3986 as a regular expression instead of
``parse_url``: it never fails on the malformed links found in real pages (spaces,
IDN hosts, ports) and keeps the port in the authority.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditspan.knowledge import fixed_values as fixed

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_FRAGMENT = r"#(.*)$"


def _clean(url: Column) -> Column:
    """Drop the control characters URL parsers ignore."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


@dataclass(frozen=True)
class UrlParts:
    scheme: Column
    authority: Column
    path: Column
    query: Column
    fragment: Column

    def as_struct(self) -> Column:
        return F.struct(*(getattr(self, f).alias(f) for f in self.__dataclass_fields__))

    @classmethod
    def from_struct(cls, col: Column) -> UrlParts:
        return cls(*(col.getField(f) for f in cls.__dataclass_fields__))


def split_url(url: Column) -> UrlParts:
    u = _clean(url)
    return UrlParts(
        scheme=F.lower(F.regexp_extract(u, _SCHEME, 1)),
        authority=F.regexp_extract(u, _AUTHORITY, 1),
        path=F.regexp_extract(u, _PATH, 1),
        query=F.regexp_extract(u, _QUERY, 1),
        fragment=F.regexp_extract(u, r"(?s)" + _FRAGMENT, 1),
    )


def _bare_path(path: Column) -> Column:
    """Path without the ``;parameters`` of its last segment."""
    return F.regexp_replace(path, r";[^/]*$", "")


def normalize_url(url: Column) -> Column:
    """scheme://authority/path; no query, no fragment, no trailing slash."""
    parts = split_url(url)
    path = F.regexp_replace(_bare_path(parts.path), "/+$", "")
    return F.concat(
        parts.scheme, F.lit("://"), parts.authority,
        F.when(path == "", F.lit("/")).otherwise(path))


def host_of(url: Column) -> Column:
    """Lower-cased authority (host and port)."""
    return F.lower(F.regexp_extract(_clean(url), _AUTHORITY, 1))


def strip_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def site_of(url: Column) -> Column:
    """Key of the site a URL belongs to: its host, with or without ``www.``."""
    return strip_www(host_of(url))


def is_same_site(url: Column, base_host: Column) -> Column:
    return site_of(url) == strip_www(base_host)


def path_of(url: Column) -> Column:
    return _bare_path(F.regexp_extract(_clean(url), _PATH, 1))


def is_skipped(url: Column) -> Column:
    """True for links to images, archives and other non-HTML files."""
    return F.lower(path_of(url)).rlike(r"\.(" + "|".join(fixed.SKIP_EXTENSIONS) + r")$")


def with_default_scheme(url: Column) -> Column:
    return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(
        F.concat(F.lit("https://"), url))


def is_https(url: Column) -> Column:
    return split_url(url).scheme == "https"


def policy_url_priority(url: Column) -> Column:
    path = F.lower(path_of(url))
    rank = F.lit(0)
    for word, score in reversed(fixed.POLICY_URL_PRIORITY):
        rank = F.when(path.contains(word), F.lit(score)).otherwise(rank)
    return rank


def is_policy_url(url: Column) -> Column:
    return url.rlike("(?iu)" + fixed.POLICY_URL_PATTERN)


def is_policy_page(url: Column, title: Column) -> Column:
    """Policy page by its URL, by its title, or by legal folder plus title."""
    title = F.coalesce(title, F.lit(""))
    return (
        is_policy_url(url)
        | title.rlike("(?iud)" + fixed.PRIVACY_LINK_PATTERN)
        | (url.rlike("(?iu)" + fixed.LEGAL_PATH_PATTERN)
           & title.rlike("(?iu)" + fixed.LEGAL_TITLE_PATTERN))
    )


def is_crawlable(url: Column) -> Column:
    """HTML pages, and policy documents in any format."""
    return ~is_skipped(normalize_url(url)) | is_policy_url(url)


def is_allowed_domain(url: Column, domains=fixed.RESEARCH_DOMAINS) -> Column:
    """Host contains one of the allowed domains (substring test)."""
    host = host_of(url)
    found = F.lit(False)
    for domain in domains:
        found = found | host.contains(domain)
    return found


def _without_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..``; only paths that have them pay for the fold."""
    segments = F.split(path, "/")
    folded = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    closed = F.when(
        F.element_at(segments, -1).isin(".", ".."), F.concat(folded, F.array(F.lit("")))
    ).otherwise(folded)
    resolved = F.array_join(closed, "/")
    return F.when(
        path.rlike(r"(^|/)\.\.?(/|$)"), F.when(resolved == "", F.lit("/")).otherwise(resolved)
    ).otherwise(path)


def resolve_url(
    base: Column, link: Column,
    base_parts: UrlParts | None = None, link_parts: UrlParts | None = None,
) -> Column:
    """Absolute form of a link found on page ``base``.

    Callers that have already split the URLs into columns pass the parts in, so
    that each URL is parsed once.
    """
    b, r = base_parts or split_url(base), link_parts or split_url(link)
    same_scheme = (r.scheme == "") | (r.scheme == b.scheme)
    folder = F.regexp_replace(b.path, "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    joined = F.when(r.path.startswith("/"), r.path).otherwise(
        # empty inner segments are dropped when paths are merged
        F.regexp_replace(F.concat(folder, r.path), "/{2,}", "/"))
    path = _without_dot_segments(joined)
    path = F.when(r.path == "", b.path).otherwise(path)
    path = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    inherits = (r.authority == "") & (r.path == "") & (r.query == "")
    query = F.when(inherits, b.query).otherwise(r.query)
    tail = F.concat(
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
        F.when(r.fragment == "", F.lit("")).otherwise(F.concat(F.lit("#"), r.fragment)))
    return (
        F.when(link == "", base)
        .when(~same_scheme, link)
        .when(r.authority != "", F.concat(b.scheme, F.lit("://"), r.authority, r.path, tail))
        .otherwise(F.concat(b.scheme, F.lit("://"), b.authority, path, tail))
    )
