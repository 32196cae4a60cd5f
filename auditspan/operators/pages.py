"""From crawl rows to page facts: one narrow pass over the stored HTML.

``page_facts`` keeps one row per fetch and drops the markup.  Everything the
site level needs (flags, masks, counts, short arrays) is computed here, before
any shuffle, so no HTML and no policy text is ever shuffled.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspan.functions import forms as fm
from auditspan.functions import markup, page_elements, registries, urls
from auditspan.functions import text as tx
from auditspan.knowledge import fixed_values as fixed
from auditspan.session import small_page_batches
from auditspan.sources import crawl as crawl_source


def with_source(crawl: DataFrame) -> DataFrame:
    """Site key, page kind and the cleaned markup of HTML pages."""
    url = F.col("url")
    is_html = crawl_source.is_html_page(url, F.col("status_code"), F.col("content_type"))
    return (
        crawl.withColumns({"site": urls.site_of(url), "host": urls.host_of(url), "is_html": is_html})
        .withColumn("html", F.when(F.col("is_html"), F.col("html")))
        .withColumn("source", markup.flat_source(F.col("html")))
    )


def outlinks(crawl: DataFrame) -> DataFrame:
    """One row per link of every HTML page: absolute and normalised target."""
    links = with_source(crawl).select(
        "site", "page_ord", "url", F.explode(markup.anchors(F.col("source"))).alias("a"))
    parsed = links.select(
        "site", "page_ord", F.col("url").alias("page_url"), F.col("a.ord").alias("link_ord"),
        F.col("a.href").alias("href"), F.col("a.text").alias("link_text"),
        urls.split_url(F.col("url")).as_struct().alias("_b"),
        urls.split_url(F.col("a.href")).as_struct().alias("_r"))
    absolute = parsed.withColumn("abs_url", urls.resolve_url(
        F.col("page_url"), F.col("href"),
        urls.UrlParts.from_struct(F.col("_b")), urls.UrlParts.from_struct(F.col("_r"))))
    return absolute.withColumn("norm_url", urls.normalize_url(F.col("abs_url"))).select(
        "site", "page_ord", "page_url", "link_ord", "href", "link_text", "abs_url", "norm_url",
        (urls.site_of(F.col("norm_url")) == F.col("site")).alias("same_site"))


def _external(page_url: Column, host: Column, found: Column) -> Column:
    """Resolved resources of other hosts: struct<kind_ord, tag_ord, kind, url, domain>."""
    base = urls.split_url(page_url)
    # parts first, so that the lambda below reads fields instead of parsing again
    parts = F.transform(found, lambda r: F.struct(
        r.getField("kind_ord").alias("kind_ord"), r.getField("tag_ord").alias("tag_ord"),
        r.getField("kind").alias("kind"), r.getField("ref").alias("ref"),
        urls.split_url(r.getField("ref")).as_struct().alias("parts")))
    absolute = F.transform(parts, lambda r: F.struct(
        r.getField("kind_ord").alias("kind_ord"), r.getField("tag_ord").alias("tag_ord"),
        r.getField("kind").alias("kind"),
        urls.resolve_url(page_url, r.getField("ref"), base,
                         urls.UrlParts.from_struct(r.getField("parts"))).alias("url")))
    hosted = F.transform(absolute, lambda r: F.struct(
        r.getField("kind_ord").alias("kind_ord"), r.getField("tag_ord").alias("tag_ord"),
        r.getField("kind").alias("kind"), r.getField("url").alias("url"),
        urls.host_of(r.getField("url")).alias("domain")))
    return F.filter(hosted, lambda r: (r.getField("domain") != "") & (r.getField("domain") != host))


def with_resources(pages: DataFrame) -> DataFrame:
    return pages.withColumn("_res", markup.resource_tags(F.col("source"))).withColumn(
        "resources", _external(F.col("url"), F.col("host"), F.col("_res"))).drop("_res")


def policy_struct(text: Column, url: Column, page_ord: Column, in_footer: Column,
                  method: Column) -> Column:
    """Everything later stages need to know about a policy text, without the text."""
    facts = tx.provenance(text)
    lower = F.lower(text)
    flags = {name: F.coalesce(flag, F.lit(False)) for name, flag in tx.content_flags(text).items()}
    elements = [F.coalesce(tx.any_of(lower, words), F.lit(False)) for _, words in fixed.CONSENT_ELEMENTS]

    def marker(words):
        return F.coalesce(tx.any_of(lower, words), F.lit(False))

    return F.struct(
        url.alias("url"), page_ord.alias("page_ord"), method.alias("extraction_method"),
        in_footer.alias("in_footer"), F.coalesce(F.length(text) > 0, F.lit(False)).alias("has_text"),
        facts["text_hash"].alias("text_hash"), facts["content_length"].alias("content_length"),
        facts["text_truncated"].alias("text_truncated"),
        tx.is_cyrillic_text(text).alias("is_russian"),
        F.lit(True).alias("is_separate_page"),
        *[flag.alias(name) for name, flag in flags.items()],
        marker(fixed.OFFER_MARKERS).alias("has_offer"),
        marker(fixed.CONSENT_MARKERS).alias("has_consent_wording"),
        F.array(*elements).alias("consent_elements"),
        marker(fixed.WITHDRAWAL_MARKERS).alias("has_withdrawal"),
        marker(fixed.WITHDRAWAL_STEMS).alias("has_withdrawal_stem"),
        marker(fixed.CROSS_BORDER_STEMS).alias("discloses_transfer"),
        F.coalesce(registries.disclosed_tracker_mask(lower), F.lit(0)).alias("disclosed_trackers"),
    )


def policy_candidates(crawl: DataFrame, keep_text: bool = True) -> DataFrame:
    """Policy texts of the crawl: policy pages as text, and extracted PDF texts."""
    pages = with_source(crawl).withColumn("title", tx.page_title(F.col("html")))
    url = F.col("url")
    answered = crawl_source.probe_answered(F.col("is_fallback"), F.col("status_code"))
    is_page = F.col("is_html") & answered & urls.is_policy_page(url, F.col("title"))
    is_file = answered & (crawl_source.is_pdf(url, F.col("content_type")) & urls.is_policy_url(url)
               & ~crawl_source.is_client_error(F.col("status_code")))
    found = pages.filter(is_page | is_file).withColumn(
        "text", F.when(F.col("is_html"), tx.visible_text(F.col("html"))).otherwise(F.col("pdf_text"))
    ).withColumn("in_footer", F.when(
        F.col("is_html"), markup.footer_privacy_href(F.col("source"), markup.anchors(F.col("source"))).isNotNull()
    ).otherwise(F.lit(False)))
    out = found.select(
        "site", "page_ord", "url", F.coalesce("is_fallback", F.lit(False)).alias("is_fallback"),
        *(["text"] if keep_text else []),
        policy_struct(F.col("text"), url, F.col("page_ord"), F.col("in_footer"),
                      F.when(F.col("is_html"), F.lit("html")).otherwise(F.col("pdf_method"))).alias("policy"))
    return out


def page_facts(crawl: DataFrame) -> DataFrame:
    """One narrow row per fetch, the input of every site-level operator."""
    small_page_batches(crawl.sparkSession)
    url = F.col("url")
    answered = crawl_source.probe_answered(F.col("is_fallback"), F.col("status_code"))
    pages = with_source(crawl).withColumns({
        "title": tx.page_title(F.col("html")),
        "links": markup.anchors(F.col("source")),
        "elements": page_elements.page_elements(F.col("html")),
    })
    pages = pages.withColumn("tree", F.struct(
        page_elements.page_forms(F.col("elements")).alias("forms"), page_elements.page_banner(F.col("elements")).alias("banner"),
        page_elements.banner_hrefs(F.col("elements")).alias("banner_hrefs"), F.col("elements.error").alias("error")))
    pages = with_resources(pages).withColumns({
        "footer_href": markup.footer_privacy_href(F.col("source"), F.col("links")),
        "page_href": markup.first_privacy_href(F.col("links")),
        "is_policy_page": F.col("is_html") & answered & urls.is_policy_page(url, F.col("title")),
        "is_policy_file": answered & (crawl_source.is_pdf(url, F.col("content_type")) & urls.is_policy_url(url)
                           & ~crawl_source.is_client_error(F.col("status_code"))),
        "library_banner": F.exists(
            markup.open_tags(F.col("source"), "script"),
            lambda t: F.coalesce(tx.matches(
                markup.raw_attribute(t, "src"), fixed.CONSENT_LIBRARY_PATTERN), F.lit(False))),
    })
    pages = pages.withColumn("policy_text", F.when(
        F.col("is_policy_page"), tx.visible_text(F.col("html"))).otherwise(
        F.when(F.col("is_policy_file"), F.col("pdf_text"))))
    forms = F.transform(F.col("tree.forms"), lambda f: F.struct(
        f.getField("form_ord").alias("form_ord"), f.getField("action").alias("action"),
        f.getField("method").alias("method"), f.getField("fields").alias("fields"),
        f.getField("has_consent_checkbox").alias("has_consent_checkbox"),
        f.getField("consent_prechecked").alias("consent_prechecked"),
        f.getField("consent_text").alias("consent_text"),
        F.lit(False).alias("has_marketing_checkbox"),
        F.coalesce(f.getField("form_privacy_href"), F.col("page_href")).alias("privacy_href"),
        fm.pd_categories(f.getField("fields")).alias("pd_categories")))
    analytics = F.exists(F.col("resources"), lambda r: tx.matches(
        r.getField("url"), fixed.ANALYTICS_URL_PATTERN))
    element = F.col("tree.banner")
    banner = F.when(element.isNotNull(), F.struct(
        F.lit(True).alias("found"), element["has_accept"].alias("has_accept"),
        element["has_decline"].alias("has_decline"), element["has_settings"].alias("has_settings"),
        element["has_policy_link"].alias("has_policy_link"),
        analytics.alias("analytics_before_consent"))
    ).when(F.col("library_banner"), F.struct(
        F.lit(True).alias("found"), F.lit(False).alias("has_accept"),
        F.lit(False).alias("has_decline"), F.lit(False).alias("has_settings"),
        F.lit(False).alias("has_policy_link"), analytics.alias("analytics_before_consent")))
    prohibited = F.aggregate(
        F.col("resources"), F.lit(0).cast("bigint"),
        lambda acc, r: acc.bitwiseOR(registries.prohibited_mask(r.getField("domain"))))
    trackers = F.aggregate(
        F.col("resources"), F.lit(0).cast("bigint"),
        lambda acc, r: acc.bitwiseOR(registries.tracker_mask(r.getField("domain"))))
    policy = F.when(F.col("is_policy_page") | F.col("is_policy_file"), policy_struct(
        F.col("policy_text"), url, F.col("page_ord"), F.col("footer_href").isNotNull(),
        F.when(F.col("is_html"), F.lit("html")).otherwise(F.col("pdf_method"))))
    return pages.select(
        "site", "page_ord", "url", "status_code", "is_html", "is_policy_page", "is_policy_file",
        F.coalesce("is_fallback", F.lit(False)).alias("is_fallback"), "title",
        F.col("footer_href").isNotNull().alias("has_footer_link"), "footer_href",
        F.coalesce(forms, F.array().cast(page_forms_type())).alias("forms"),
        "resources", banner.alias("banner"),
        F.col("tree.banner_hrefs").alias("banner_hrefs"), F.col("tree.error").alias("parse_error"),
        F.coalesce(prohibited, F.lit(0)).alias("prohibited_mask"),
        F.coalesce(trackers, F.lit(0)).alias("tracker_mask"),
        F.size(F.array_distinct(F.transform("resources", lambda r: r.getField("url")))).alias("external_scripts"),
        policy.alias("policy"), "cookies")


def page_forms_type() -> str:
    field = "struct<name:string,field_type:string,label:string,required:boolean,placeholder:string>"
    return (f"array<struct<form_ord:int,action:string,method:string,fields:array<{field}>,"
            "has_consent_checkbox:boolean,consent_prechecked:boolean,consent_text:string,"
            "has_marketing_checkbox:boolean,privacy_href:string,pd_categories:array<string>>>")


def forms(facts: DataFrame) -> DataFrame:
    """One row per form.

    ``explode_outer``: a plain explode makes the optimizer add a size filter that
    evaluates the form extraction a second time.
    """
    return facts.select(
        "site", "page_ord", F.col("url").alias("page_url"), F.explode_outer("forms").alias("f")
    ).filter("f IS NOT NULL").select(
        "site", "page_ord", "page_url", "f.*",
        F.col("f.privacy_href").isNotNull().alias("has_privacy_link"),
        (F.size("f.pd_categories") > 0).alias("collects_pd"))


def page_summary(facts: DataFrame) -> DataFrame:
    """Page list of a scan: title, footer link, counts of forms and scripts."""
    return facts.filter("is_html").select(
        "site", "page_ord", "url", "title", "status_code", "has_footer_link",
        F.size("forms").alias("forms_count"),
        F.col("external_scripts").alias("external_scripts_count"))


def banner_policy_links(facts: DataFrame) -> DataFrame:
    """Policy links inside banner elements, absolute, without repeats."""
    page = F.col("url")
    return facts.filter(F.size("banner_hrefs") > 0).select("site", "page_ord", "url", F.explode(
        F.array_distinct(F.transform("banner_hrefs", lambda h: urls.resolve_url(page, h)))).alias("policy_url"))
