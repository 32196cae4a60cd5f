"""The full audit: crawl table in, reports out, for all sites at once.

    crawl -> page facts (no shuffle) -> one shuffle by site -> checks
          -> broadcast joins with the dimensions -> scores, fines, reports

The explode of the checks and the aggregates over them keep the partitioning by
site, so the whole report needs a single exchange of narrow page rows.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspan.operators import pages, rules, scoring, scripts
from auditspan.operators import sites as site_ops
from auditspan.session import cut_lineage
from auditspan.sources import dimensions


class Audit:
    """Results over one crawl; each is built when first asked for.

    ``materialise`` writes the page facts once to the shared checkpoint folder;
    use it when several of the results are wanted, so that the HTML is parsed a
    single time.
    """

    def __init__(self, crawl: DataFrame, materialise: bool = False,
                 checklist: DataFrame | None = None, fines: DataFrame | None = None, *,
                 services: DataFrame | None = None, trackers: DataFrame | None = None,
                 request_log: DataFrame | None = None, notes: DataFrame | None = None):
        spark = crawl.sparkSession
        self.checklist = checklist if checklist is not None else dimensions.checklist(spark)
        self.fine_schedule = fines if fines is not None else dimensions.fines(spark)
        self.crawl, self.services, self.trackers = crawl, services, trackers
        self.request_log, self.notes = request_log, notes
        facts = pages.page_facts(crawl)
        self.facts = cut_lineage(facts) if materialise else facts

    @cached_property
    def sites(self) -> DataFrame:
        sites = site_ops.site_facts(self.facts)
        if self.request_log is not None:
            sites = site_ops.with_request_log(sites, scripts.tracker_requests(self.request_log, self.trackers))
        chosen = sites.select("site", F.col("policy.page_ord").alias("page_ord")).filter("page_ord is not null")
        if self.services is not None:
            found = scripts.services_of_sites(self.hosts, self.services)
            sites = site_ops.with_registry_tables(sites, found, ["services_used"])
        if self.trackers is not None:
            texts = pages.policy_candidates(self.crawl).select("site", "page_ord", "text").join(chosen, ["site", "page_ord"])
            found = scripts.trackers_of_sites(self.hosts, self.trackers, texts)
            sites = site_ops.with_registry_tables(sites, found, ["trackers_used", "trackers_hidden", "trackers_foreign"])
        return sites if self.notes is None else site_ops.with_crawler_notes(sites, self.notes)

    @cached_property
    def hosts(self) -> DataFrame:
        """Hosts of each site, written once: both registries meet them, and pages are read again for every reader."""
        return cut_lineage(scripts.primary_hosts(self.facts), "hosts")

    @cached_property
    def forms(self) -> DataFrame:
        return pages.forms(self.facts.filter("NOT is_fallback"))

    @cached_property
    def checks(self) -> DataFrame:
        return scoring.enrich_checks(rules.site_checks(self.sites), self.checklist)

    @cached_property
    def violations(self) -> DataFrame:
        return scoring.enrich_violations(
            rules.violations(self.sites, self.forms), self.checklist, self.fine_schedule)

    @cached_property
    def reports(self) -> DataFrame:
        return reports(self.sites, self.checklist, self.fine_schedule)


def audit(crawl: DataFrame, materialise: bool = False, checklist: DataFrame | None = None, fines: DataFrame | None = None,
          **tables: DataFrame | None) -> Audit:
    """The audit of a crawl.

    ``tables`` may hold ``services`` and ``trackers`` (registries of any size in place of the built-in ones),
    ``request_log`` (browser mode: what the pages requested) and ``notes`` (what the crawler could not do).
    """
    return Audit(crawl, materialise, checklist, fines, **tables)


def reports(sites: DataFrame, checklist: DataFrame, fines: DataFrame) -> DataFrame:
    """Score, risk, fines and summary, one row per site.

    One branch from the site row: explode the outcomes of the 42 checks, look up
    the dimensions, fold back.  A self-join of several aggregates would read and
    parse the pages once per branch.
    """
    base = F.struct(
        "site_url", "pages_scanned", "policy_url",
        F.col("policy.text_hash").alias("policy_hash"),
        F.col("policy.content_length").alias("policy_length"),
        F.col("policy.text_truncated").alias("policy_truncated"),
        F.col("policy.extraction_method").alias("policy_method"),
        scoring.scan_limitations(F.col("crawler_notes") if "crawler_notes" in sites.columns else None)
        .alias("scan_limitations"))
    outcomes = rules.site_outcomes(sites.withColumn("base", base), "base")
    priced = scoring.price_outcomes(outcomes, checklist, fines)
    folded = scoring.fold_outcomes(priced, "site", F.any_value("base").alias("base"))
    return folded.select("site", "base.*", *[c for c in folded.columns if c not in ("site", "base")])
