"""Fold of page facts into one row per site.

The fold is a single two-phase aggregate.  Every input of the rules is a count,
a flag, a bit mask or a first/best struct, so a site that owns a third of all
pages is reduced on the map side like any other, and nothing is collected.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspan.functions import registries
from auditspan.functions import text as tx
from auditspan.functions import urls
from auditspan.knowledge import fixed_values as fixed
from auditspan.operators import policies
from auditspan.sources import crawl as crawl_source


def _count(forms: Column, test) -> Column:
    return F.coalesce(F.size(F.filter(forms, test)), F.lit(0))


def _is_pd(form: Column) -> Column:
    return F.size(form.getField("pd_categories")) > 0


def with_form_counts(facts: DataFrame) -> DataFrame:
    """Per-page counts over the (few) forms of a page."""
    pd = F.filter("forms", _is_pd)
    consent = F.transform(pd, lambda f: F.lower(F.coalesce(f.getField("consent_text"), F.lit(""))))

    def has_box(f):
        return f.getField("has_consent_checkbox")

    def has_text(f):
        return F.coalesce(f.getField("consent_text"), F.lit("")) != ""

    def any_text(words) -> Column:
        return F.exists(consent, lambda t: tx.any_of(t, words))

    return facts.withColumn("f", F.struct(
        F.size("forms").alias("forms"), F.size(pd).alias("pd"),
        _count(pd, lambda f: ~has_box(f)).alias("no_box"),
        _count(pd, lambda f: has_box(f) & f.getField("consent_prechecked")).alias("prechecked"),
        _count(pd, lambda f: f.getField("privacy_href").isNull()).alias("no_link"),
        _count(pd, lambda f: F.size(f.getField("pd_categories")) > 5).alias("excessive"),
        _count(pd, lambda f: ~has_box(f) & ~has_text(f)).alias("no_mechanism"),
        F.exists(pd, lambda f: has_box(f) & ~f.getField("has_marketing_checkbox") & has_text(f)
                 & tx.any_of(F.lower(f.getField("consent_text")), fixed.MARKETING_STEMS)).alias("mixed"),
        *[any_text(words).alias(f"element_{i}") for i, (_, words) in enumerate(fixed.CONSENT_ELEMENTS)],
        any_text(fixed.WITHDRAWAL_STEMS).alias("withdrawal")))


def site_facts(facts: DataFrame) -> DataFrame:
    """One row per site with everything the 42 checks need."""
    rows = with_form_counts(facts)
    policy, primary = F.col("policy"), ~F.col("is_fallback")
    html = F.col("is_html") & primary
    # a well-known-path document joins the page list only when it was needed
    extra = ~primary & policy.isNotNull()
    valid = policy.isNotNull() & policies.is_valid(policy)
    norm = urls.normalize_url(F.col("url"))
    # a probe of a well-known path is no visited page: its address and its failure say nothing
    seen = F.when(primary, F.col("page_ord"))

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(html, F.col(f"f.{name}"))), F.lit(0)).alias(f"forms_{name}")

    folded = rows.groupBy("site").agg(
        F.coalesce(F.min_by("url", seen), F.min_by("url", "page_ord")).alias("site_url"),
        F.count_if(html).alias("main_pages"),
        F.count_if(html & ~F.col("has_footer_link")).alias("main_without_link"),
        F.count_if(extra).alias("extra_pages"),
        F.count_if(extra & ~F.col("has_footer_link")).alias("extra_without_link"),
        F.coalesce(F.bool_or(primary & F.col("url").startswith("https")), F.lit(False)).alias("has_ssl"),
        F.count_if(primary & F.col("status_code").between(400, 499)).alias("client_errors"),
        F.coalesce(F.sum(F.when(html, F.col("external_scripts"))), F.lit(0)).alias("script_tags"),
        *[total(n) for n in ("forms", "pd", "no_box", "prechecked", "no_link", "excessive", "no_mechanism")],
        F.coalesce(F.bool_or("f.mixed"), F.lit(False)).alias("mixed_consent"),
        F.array(*[F.coalesce(F.bool_or(f"f.element_{i}"), F.lit(False))
                  for i in range(len(fixed.CONSENT_ELEMENTS))]).alias("form_elements"),
        F.coalesce(F.bool_or("f.withdrawal"), F.lit(False)).alias("form_withdrawal"),
        F.coalesce(F.bit_or(F.when(primary, F.col("prohibited_mask"))), F.lit(0)).alias("prohibited_mask"),
        F.coalesce(F.bit_or(F.when(primary, F.col("tracker_mask"))), F.lit(0)).alias("tracker_mask"),
        F.min_by("banner", F.when(F.col("banner").isNotNull() & primary, F.col("page_ord"))).alias("banner"),
        F.min(F.when(F.col("banner").isNotNull() & primary, F.col("page_ord"))).alias("banner_page"),
        F.count_if(policy.isNotNull() & primary).alias("crawled_policies"),
        F.count_if(policy.isNotNull()).alias("all_policies"),
        F.max_by(policy, F.when(valid & primary, policies.preference(policy))).alias("main_policy"),
        F.max_by(policy, F.when(valid & ~primary, policies.preference(policy))).alias("other_policy"),
        F.max_by(norm, F.when(urls.is_policy_url(norm) & primary, F.struct(
            urls.policy_url_priority(norm), -F.col("page_ord")))).alias("policy_url_only"),
    )
    chosen = F.when(F.col("crawled_policies") > 0, F.col("main_policy")).otherwise(F.col("other_policy"))
    by_url = (F.col("all_policies") == 0) & F.col("policy_url_only").isNotNull()
    needed = F.col("crawled_policies") == 0

    def with_extra(main: str, more: str) -> Column:
        return F.col(main) + F.when(needed, F.col(more)).otherwise(F.lit(0))

    return folded.withColumn("policy", chosen).withColumns({
        "pages_scanned": with_extra("main_pages", "extra_pages"),
        "pages_without_link": with_extra("main_without_link", "extra_without_link"),
        "policy_found": F.col("policy").isNotNull() | by_url,
        "policy_url": F.coalesce(F.col("policy.url"), F.when(by_url, F.col("policy_url_only"))),
        "policy_has_text": F.coalesce(F.col("policy.has_text"), F.lit(False)),
        "policy_separate": F.coalesce(F.col("policy.is_separate_page"), F.lit(False)),
        "banner_found": F.col("banner").isNotNull(),
        **registries.site_columns(F.col("prohibited_mask"), F.col("tracker_mask"),
                                  F.coalesce("policy.disclosed_trackers", F.lit(0))),
    }).drop("prohibited_mask", "tracker_mask", "main_pages", "main_without_link", "extra_pages", "extra_without_link", "main_policy", "other_policy", "policy_url_only", "crawled_policies", "all_policies")


def with_registry_tables(sites: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """Sites with ``columns`` from registry tables in place of the built-in ones; sites without a row have none."""
    none = F.array().cast("array<string>")
    return sites.drop(*columns).join(found.select("site", *columns), "site", "left").withColumns(
        {c: F.coalesce(c, none) for c in columns})


def with_request_log(sites: DataFrame, requests: DataFrame) -> DataFrame:
    """Browser mode: analytics before consent is what the page with the banner really requested.

    ``requests`` has one row (site, page_ord, analytics_before_consent) per page; a page without a row requested nothing.
    """
    flags = requests.select("site", F.col("page_ord").alias("banner_page"), F.col("analytics_before_consent").alias("_early"))
    joined = sites.join(flags, ["site", "banner_page"], "left")
    early = F.coalesce("_early", F.lit(False))
    return joined.withColumn("banner", F.when(F.col("banner").isNotNull(), F.col("banner").withField(
        "analytics_before_consent", early))).drop("_early")


def with_crawler_notes(sites: DataFrame, notes: DataFrame) -> DataFrame:
    """Sites with the notes that their crawl left: (site, note_ord, note), in order, in ``crawler_notes``."""
    gathered = notes.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("note_ord", "note"))).alias("n"))
    return sites.join(gathered.select("site", F.col("n.note").alias("crawler_notes")), "site", "left").withColumn(
        "crawler_notes", F.coalesce("crawler_notes", F.array().cast("array<string>")))


def site_cookies(crawl: DataFrame) -> DataFrame:
    """Cookies of a site by name, the first setter wins.

    Only pages that were read count: no failed fetches, no files, no probes.
    """
    read = crawl_source.is_html_page(F.col("url"), F.col("status_code"), F.col("content_type"))
    own = ~F.coalesce("is_fallback", F.lit(False))
    rows = crawl.filter(read & own & (F.size("cookies") > 0)).select(
        urls.site_of(F.col("url")).alias("site"), "page_ord", "url", F.posexplode("cookies").alias("i", "name"))
    return rows.groupBy("site", "name").agg(
        F.min_by("url", F.struct("page_ord", "i")).alias("page_url")
    ).select("site", "name", "page_url", F.col("page_url").startswith("https").alias("secure"),
             F.lit("unknown").alias("category"))


def poor_scans(sites: DataFrame) -> DataFrame:
    """Sites worth a second crawl: no pages, client errors, or no policy."""
    return sites.filter(
        (F.col("pages_scanned") == 0) | (F.col("client_errors") > 0) | ~F.col("policy_found")
    ).select("site", "pages_scanned", "client_errors", "policy_found")


def is_poor_result(pages: Column, errors: Column, policy_found: Column) -> Column:
    """The same test for stored scans with their list of error messages."""
    return (pages == 0) | F.exists(errors, lambda e: e.contains("HTTP 4")) | ~policy_found


def crawl_frontier(
    links: DataFrame, fetched: DataFrame, max_pages: int,
    banner_links: DataFrame | None = None,
) -> DataFrame:
    """Next URLs to fetch per site: unseen same-site links, policy links first.

    Links inside a cookie banner (``banner_links``: site, norm_url) go before
    everything else.  ``links`` has (site, page_ord, link_ord, abs_url, norm_url, link_text,
    same_site), ``fetched`` has (site, norm_url).  The rank filter is applied
    per map task before the shuffle (window group limit), so a site with very
    many links sends at most ``max_pages`` rows per task.
    """
    first = links.filter("same_site").groupBy("site", "norm_url").agg(
        F.min_by(F.struct("page_ord", "link_ord", "abs_url", "link_text"),
                 F.struct("page_ord", "link_ord")).alias("l")).select("site", "norm_url", "l.*")
    unseen = first.join(fetched.select("site", "norm_url").distinct(), ["site", "norm_url"], "left_anti")
    policy_first = urls.is_policy_page(F.col("abs_url"), F.col("link_text"))
    if banner_links is None:
        unseen = unseen.withColumn("in_banner", F.lit(False))
    else:
        marked = banner_links.select("site", "norm_url").distinct().withColumn("in_banner", F.lit(True))
        unseen = unseen.join(marked, ["site", "norm_url"], "left").withColumn(
            "in_banner", F.coalesce("in_banner", F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("site").orderBy(
        F.col("in_banner").desc(), F.col("is_policy").desc(), "page_ord", "link_ord", "norm_url"))
    return (unseen.withColumn("is_policy", policy_first)
            .filter(urls.is_crawlable(F.col("abs_url")))
            .withColumn("rank", rank).filter(F.col("rank") <= max_pages)
            .select("site", "norm_url", "abs_url", "is_policy", "rank"))


def unvisited_links(links: DataFrame, fetched: DataFrame) -> DataFrame:
    """Same-site links that were never fetched."""
    return links.filter("same_site").select("site", "norm_url").distinct().join(
        fetched.select("site", "norm_url"), ["site", "norm_url"], "left_anti")


def fetched_urls(crawl: DataFrame) -> DataFrame:
    return crawl.select(
        urls.site_of(F.col("url")).alias("site"), urls.normalize_url(F.col("url")).alias("norm_url")).distinct()


def probe_frontier(crawl: DataFrame, candidates: DataFrame, paths=fixed.WELL_KNOWN_POLICY_PATHS) -> DataFrame:
    """Well-known addresses to try on sites whose crawl met no policy candidate.

    Rows are (site, page_ord, url, norm_url); ``page_ord`` goes on after the site's pages, in the order of ``paths``.
    Addresses that were visited, as a page or as a probe, are left out.  Only visited rows
    whose path is one of ``paths`` can be among them, so no others reach the join.
    """
    own = ~F.coalesce("is_fallback", F.lit(False))
    host = urls.host_of(F.col("url"))
    homes = crawl.withColumn("site", urls.site_of(F.col("url"))).groupBy("site").agg(
        F.min_by(host, F.when(own, F.col("page_ord"))).alias("host"), F.max("page_ord").alias("last"))
    met = candidates.filter(own).select("site").distinct()
    wanted = homes.filter("host != ''").join(met, "site", "left_anti").select(
        "site", "host", "last", F.posexplode(F.array(*[F.lit(p) for p in paths])).alias("i", "path"))
    wanted = wanted.select("site", (F.col("last") + 1 + F.col("i")).alias("page_ord"),
                           F.concat(F.lit("https://"), "host", "path").alias("url"))
    norm = urls.normalize_url(F.col("url"))
    visited = crawl.filter(F.rtrim(urls.path_of(F.col("url")), F.lit("/")).isin(*paths)).select(
        urls.site_of(F.col("url")).alias("site"), norm.alias("norm_url")).distinct()
    return wanted.withColumn("norm_url", norm).join(visited, ["site", "norm_url"], "left_anti").select(
        "site", "page_ord", "url", "norm_url")


def with_probes(crawl: DataFrame, answers: DataFrame) -> DataFrame:
    """The crawl with what its probes answered (rows of a crawl); a probe is no visited page."""
    return crawl.unionByName(answers.withColumn("is_fallback", F.lit(True)), allowMissingColumns=True)
