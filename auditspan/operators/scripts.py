"""External scripts of pages and sites, and their match with the registries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspan.functions import registries, urls
from auditspan.functions import text as tx
from auditspan.knowledge import fixed_values as fixed
from auditspan.operators.pages import with_resources, with_source


def page_scripts(crawl: DataFrame) -> DataFrame:
    """External resources per page, the first kind of a URL wins.

    Works on the crawl table; rows stay in the task that read the page, because
    the repeats of one page are removed inside its own array.
    """
    pages = with_resources(with_source(crawl))
    return _explode(pages.select("site", "page_ord", "url", "resources"))


def scripts_of_facts(facts: DataFrame) -> DataFrame:
    return _explode(facts.select("site", "page_ord", "url", "resources"))


def _explode(pages: DataFrame) -> DataFrame:
    """One row per URL of a page; kinds come in order, so its first resource has the winning kind.

    Equal URLs are neighbours once sorted, so a page is never searched for each of its resources.
    """
    entries = F.transform("resources", lambda r, i: F.struct(
        r.getField("url").alias("url"), i.alias("place"), r.getField("kind").alias("kind"), r.getField("domain").alias("domain")))
    # a column of its own: the filter below looks at the entry before
    ordered = pages.withColumn("_r", F.array_sort(entries))
    first = F.filter("_r", lambda r, i: (i == 0) | (F.get(F.col("_r"), i - 1).getField("url") != r.getField("url")))
    in_order = F.array_sort(F.transform(first, lambda r: F.struct(
        r.getField("place").alias("place"), r.getField("kind").alias("kind"), r.getField("url").alias("url"),
        r.getField("domain").alias("domain"))))
    return ordered.select(
        "site", "page_ord", F.col("url").alias("page_url"), F.posexplode(in_order).alias("script_ord", "r")
    ).select("site", "page_ord", "page_url", "script_ord", F.col("r.kind").alias("script_type"),
             F.col("r.url").alias("url"), F.col("r.domain").alias("domain"))


def mark_prohibited(scripts: DataFrame) -> DataFrame:
    service = registries.prohibited_service(F.col("domain"))
    return scripts.withColumn("service_name", service).withColumn(
        "is_prohibited", F.col("service_name").isNotNull())


def site_scripts(scripts: DataFrame) -> DataFrame:
    """One row per (site, script URL): its first appearance.

    A two-phase aggregate, not a window: the map side already keeps one row per
    URL, so a tag present on every page of a huge site costs nothing extra.
    """
    payload = F.struct("page_url", "script_type", "domain", "page_ord", "script_ord")
    return (
        scripts.groupBy("site", "url")
        .agg(F.min_by(payload, F.struct("page_ord", "script_ord")).alias("first"),
             F.count("*").alias("occurrences"))
        .select("site", "url", "first.*", "occurrences"))


def match_services(scripts: DataFrame, services: DataFrame) -> DataFrame:
    """Join with a service table by "registry domain occurs in the host".

    A substring test is turned into an equality: hosts are short, so each host
    yields its substrings of the lengths that occur in the registry.  Equal keys
    can be broadcast or shuffled, whatever the registry's size; a theta join
    would have to broadcast it.
    """
    # domain names have at most 253 characters, so this is a short list
    lengths = services.agg(F.collect_set(F.length("domain")).alias("lengths")).scalar()
    hosts = scripts.select("domain").distinct()
    pieces = hosts.select(F.col("domain").alias("host"), lengths.alias("lengths")).select(
        "host", F.explode("lengths").alias("n")
    ).filter(F.length("host") >= F.col("n")).select(
        "host", F.explode(F.transform(
            F.sequence(F.lit(1), F.length("host") - F.col("n") + 1),
            lambda i: F.substring(F.col("host"), i, F.col("n")))).alias("domain"))
    matched = pieces.join(services, "domain").groupBy(F.col("host").alias("domain")).agg(
        F.min_by("name", F.struct("service_ord", "domain_ord")).alias("service_name"))
    return _spread_join(scripts, matched, "domain", "left").withColumn(
        "is_prohibited", F.col("service_name").isNotNull())


#: parts that the rows of one host are spread over when they meet a registry
SALTS = 16


def _spread_join(rows: DataFrame, registry: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join with a registry on a key that may stand in most rows, such as the host of a common counter."""
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    copies = registry.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(copies, [key, "_salt"], how).drop("_salt")


def host_suffixes(host):
    """``a.b.c`` -> [a.b.c, b.c, c]: the domains a host belongs to."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))


def match_trackers(hosts: DataFrame, trackers: DataFrame) -> DataFrame:
    """(site, tracker) pairs: equal domain or a sub-domain of it, as an equi-join."""
    registry = trackers.select(
        "tracker_ord", F.col("name").alias("tracker"), "keywords", "is_foreign",
        F.explode("domains").alias("suffix")).withColumn("suffix", F.lower("suffix"))
    # only suffixes of as many labels as the registry has: "com" would stand for every host
    labels = F.size(F.split("suffix", r"\."))
    sizes = registry.agg(F.collect_set(labels).alias("sizes")).scalar()
    wanted = hosts.select("site", F.lower("domain").alias("domain")).distinct().select(
        "site", F.explode(host_suffixes(F.col("domain"))).alias("suffix"))
    wanted = wanted.select("site", "suffix", sizes.alias("sizes")).filter(F.array_contains("sizes", labels)).drop("sizes")
    return _spread_join(wanted, registry, "suffix").select(
        "site", "tracker_ord", "tracker", "keywords", "is_foreign").distinct()


def primary_hosts(facts: DataFrame) -> DataFrame:
    """(site, domain) of the external resources on visited pages, each once."""
    return facts.filter(~F.col("is_fallback")).select("site", F.explode("resources.domain").alias("domain")).distinct()


def services_of_sites(hosts: DataFrame, services: DataFrame) -> DataFrame:
    """(site, services_used): names from a service table, in its order."""
    order = services.groupBy("name").agg(F.min("service_ord").alias("service_ord"))
    named = match_services(hosts, services).filter("is_prohibited").select(
        "site", F.col("service_name").alias("name")).distinct().join(order, "name")
    return named.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("service_ord", "name"))).alias("s")).select(
        "site", F.col("s.name").alias("services_used"))


def trackers_of_sites(hosts: DataFrame, trackers: DataFrame, policy_texts: DataFrame) -> DataFrame:
    """(site, trackers_used, trackers_hidden, trackers_foreign) by a tracker table.

    A site's trackers (at most the registry) are gathered first, so its policy text (site, text) is met once
    and searched for their keywords only.
    """
    entry = F.struct("tracker_ord", "tracker", "keywords", "is_foreign")
    used = match_trackers(hosts, trackers).groupBy("site").agg(F.array_sort(F.collect_list(entry)).alias("used"))
    joined = used.join(policy_texts.select("site", F.lower("text").alias("text")), "site", "left")

    def named(test) -> Column:
        return F.transform(F.filter("used", test), lambda t: t.getField("tracker"))

    def told(t: Column) -> Column:
        return F.coalesce(F.exists(t.getField("keywords"), lambda k: F.col("text").contains(F.lower(k))), F.lit(False))

    return joined.select("site", named(lambda t: F.lit(True)).alias("trackers_used"), named(lambda t: ~told(t)).alias("trackers_hidden"),
                         named(lambda t: t.getField("is_foreign")).alias("trackers_foreign"))


def undisclosed_trackers(site_trackers: DataFrame, policies: DataFrame) -> DataFrame:
    """Trackers none of whose keywords occurs in the site's policy text."""
    joined = site_trackers.join(policies.select("site", F.lower("text").alias("policy_lower")), "site")
    return joined.filter(~F.exists("keywords", lambda k: F.col("policy_lower").contains(k))).select(
        "site", "tracker_ord", "tracker")


def foreign_trackers_without_notice(site_trackers: DataFrame, policies: DataFrame) -> DataFrame:
    """Foreign trackers of sites whose policy has no cross-border wording."""
    silent = policies.filter(
        ~F.coalesce(tx.any_of(F.lower("text"), fixed.CROSS_BORDER_STEMS), F.lit(False))).select("site")
    return site_trackers.filter("is_foreign").join(silent, "site", "left_semi").select(
        "site", "tracker_ord", "tracker")


def tracker_requests(request_log: DataFrame, trackers: DataFrame | None = None) -> DataFrame:
    """Pages whose request log reaches a registered tracker (browser crawls), by the built-in registry or a table."""
    if trackers is not None:
        pages = request_log.select(
            F.struct(urls.site_of(F.col("page_url")).alias("site"), "page_ord", "page_url").alias("site"),
            urls.host_of(F.col("request_url")).alias("domain"))
        hit = match_trackers(pages, trackers).select("site").distinct().withColumn("analytics_before_consent", F.lit(True))
        return pages.select("site").distinct().join(hit, "site", "left").select(
            "site.*", F.coalesce("analytics_before_consent", F.lit(False)).alias("analytics_before_consent"))
    return request_log.groupBy(
        urls.site_of(F.col("page_url")).alias("site"), "page_ord", "page_url"
    ).agg(F.bool_or(registries.tracker_mask(urls.host_of(F.col("request_url"))) != 0)
          .alias("analytics_before_consent"))
