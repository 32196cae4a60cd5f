"""Choice of the policy document of a site."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspan.functions import urls
from auditspan.knowledge import fixed_values as fixed


def is_valid(policy: Column) -> Column:
    """A policy without readable text passes; a readable one must be real."""
    length = policy.getField("content_length")
    return length.isNull() | (
        (length >= fixed.POLICY_TEXT_MINIMUM) & F.coalesce(policy.getField("is_russian"), F.lit(False)))


def preference(policy: Column) -> Column:
    """Sort key: longest text, then the more telling URL, then the first found."""
    return F.struct(
        F.coalesce(policy.getField("content_length"), F.lit(0)).alias("length"),
        urls.policy_url_priority(policy.getField("url")).alias("priority"),
        (-policy.getField("page_ord")).alias("earlier"))


def best_policies(candidates: DataFrame) -> DataFrame:
    """One chosen candidate per site.

    Documents fetched from well-known paths count only for sites where the crawl
    itself met no candidate at all, not even an invalid one.
    """
    policy = F.col("policy")
    carried = F.struct(*[F.col(c) for c in candidates.columns if c != "site"])
    chosen = candidates.groupBy("site").agg(
        F.count_if(~F.col("is_fallback")).alias("crawled"),
        F.max_by(carried, F.when(is_valid(policy) & ~F.col("is_fallback"), preference(policy))).alias("main"),
        F.max_by(carried, F.when(is_valid(policy) & F.col("is_fallback"), preference(policy))).alias("other"))
    return chosen.select(
        "site", F.when(F.col("crawled") > 0, F.col("main")).otherwise(F.col("other")).alias("best")
    ).filter("best IS NOT NULL").select("site", "best.*")


def first_valid_policies(candidates: DataFrame) -> DataFrame:
    """The first acceptable candidate in page order (browser crawls)."""
    carried = F.struct(*[F.col(c) for c in candidates.columns if c != "site"])
    return candidates.filter(is_valid(F.col("policy"))).groupBy("site").agg(
        F.min_by(carried, F.col("page_ord")).alias("best")).select("site", "best.*")


def with_fallback(candidates: DataFrame, fallback: DataFrame) -> DataFrame:
    """Union of crawl candidates and well-known-path candidates of other sites."""
    missing = fallback.join(candidates.select("site").distinct(), "site", "left_anti")
    return candidates.unionByName(missing)


def url_only_policies(facts: DataFrame) -> DataFrame:
    """Sites without any readable candidate: the policy is known by URL only.

    First the earliest crawled policy page, else the visited URL (errors
    included) whose path is the most telling.
    """
    norm = urls.normalize_url(F.col("url"))
    own = ~F.col("is_fallback")
    by_url = urls.is_policy_url(norm) & own
    return facts.groupBy("site").agg(
        F.count_if(F.col("policy").isNotNull()).alias("candidates"),
        F.min_by("url", F.when(F.col("is_policy_page") & own, F.col("page_ord"))).alias("page_url"),
        F.max_by(norm, F.when(by_url, F.struct(
            urls.policy_url_priority(norm), -F.col("page_ord")))).alias("visited_url"),
    ).filter("candidates = 0").select(
        "site", F.coalesce("page_url", "visited_url").alias("policy_url")).filter("policy_url IS NOT NULL")
