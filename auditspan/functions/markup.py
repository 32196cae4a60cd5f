"""Flat HTML tags as arrays of structs, without leaving the JVM.

Tags whose meaning lies in their own attributes (links, scripts, stylesheets,
frames, images) need no document tree: one regular expression finds the tags,
small ones read the attributes.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditspan.functions import text as tx
from auditspan.knowledge import fixed_values as fixed

_ATTRS, _END = tx.ATTRS, tx.TAG_END


def flat_source(html: Column) -> Column:
    """Markup without comments and without the code inside scripts and styles."""
    return F.regexp_replace(
        F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", ""),
        rf"(?is)(<(script|style)\b[^>]*+{_END}).*?(</\2\s*>|\z)", "$1$3")


def raw_attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag as written; NULL when absent."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    raw = F.regexp_extract(tag, pattern, 1)
    return F.when(raw != "", F.regexp_replace(raw, r"""^["']|["']$""", ""))


def attribute(tag: Column, name: str) -> Column:
    """Decoded value of an attribute of an opening tag; NULL when absent."""
    return tx.decode_entities(raw_attribute(tag, name))


def open_tags(source: Column, name: str) -> Column:
    return F.regexp_extract_all(source, F.lit(rf"(?is)<{name}\b{_ATTRS}{_END}"), F.lit(0))


def anchors(source: Column) -> Column:
    """Links with ``href``: array<struct<ord, href, text>> in page order."""
    found = F.regexp_extract_all(
        source, F.lit(rf"(?is)<a\b{_ATTRS}{_END}(?:(?!</a\s*>|<a\b).)*+"), F.lit(0))
    parsed = F.transform(found, lambda t: F.struct(
        attribute(F.regexp_extract(t, rf"(?is)^<a\b{_ATTRS}{_END}", 0), "href").alias("href"),
        tx.inner_text(F.regexp_replace(t, rf"(?is)^<a\b{_ATTRS}{_END}", "")).alias("text")))
    with_href = F.filter(parsed, lambda a: a.getField("href").isNotNull())
    return F.transform(with_href, lambda a, i: F.struct(
        i.alias("ord"), a.getField("href").alias("href"), a.getField("text").alias("text")))


def is_privacy_anchor(anchor: Column) -> Column:
    return (tx.matches(anchor.getField("text"), fixed.PRIVACY_LINK_PATTERN)
            | tx.matches(anchor.getField("href"), fixed.PRIVACY_LINK_PATTERN))


def first_privacy_href(links: Column) -> Column:
    """href of the first privacy link; NULL when there is none."""
    return F.get(F.filter(links, is_privacy_anchor), F.lit(0)).getField("href")


def footer_privacy_href(source: Column, links: Column) -> Column:
    """Privacy link of the first footer, else among the last quarter of links."""
    footer = F.regexp_extract(source, r"(?is)<footer\b.*?(?:</footer\s*>|\z)", 0)
    tail_start = F.floor(F.size(links) * 3 / 4)
    tail = F.filter(links, lambda a, i: i >= tail_start)
    return F.coalesce(
        F.when(footer != "", first_privacy_href(anchors(footer))), first_privacy_href(tail))


_KINDS = ("js", "css", "font", "iframe", "pixel")


def is_tracking_pixel(width: Column, height: Column) -> Column:
    """Both sizes given and between 0 and 2 pixels."""
    def side(value: Column) -> Column:
        return F.regexp_replace(F.coalesce(value, F.lit("")), r"\D", "").try_cast("int").between(0, 2)
    return F.coalesce(side(width) & side(height), F.lit(False))


def resource_tags(source: Column) -> Column:
    """Candidate external resources: array<struct<kind_ord, tag_ord, kind, ref>>.

    Kinds are tried in the order js, css, font, iframe, pixel; a preconnect link
    counts as a font.
    """
    def tags(name: str, attr: str, kind: str, keep=None) -> Column:
        found = open_tags(source, name)
        if keep is not None:
            found = F.filter(found, keep)
        return F.transform(found, lambda t, i: F.struct(
            F.lit(_KINDS.index(kind)).alias("kind_ord"), i.alias("tag_ord"),
            F.lit(kind).alias("kind"), raw_attribute(t, attr).alias("raw")))

    def rel(tag: Column) -> Column:
        return F.lower(F.coalesce(raw_attribute(tag, "rel"), F.lit("")))

    found = F.concat(
        tags("script", "src", "js"),
        tags("link", "href", "css", lambda t: rel(t).contains("stylesheet")),
        tags("link", "href", "font",
             lambda t: rel(t).contains("font") | rel(t).contains("preconnect")),
        tags("iframe", "src", "iframe"),
        tags("img", "src", "pixel",
             lambda t: is_tracking_pixel(raw_attribute(t, "width"), raw_attribute(t, "height"))))
    named = F.filter(found, lambda r: r.getField("raw").isNotNull())
    return F.transform(named, lambda r: F.struct(
        r.getField("kind_ord").alias("kind_ord"), r.getField("tag_ord").alias("tag_ord"),
        r.getField("kind").alias("kind"), tx.decode_entities(r.getField("raw")).alias("ref")))
