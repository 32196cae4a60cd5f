"""Enrichment of checks and violations, score, risk, fines and summary texts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspan.functions import text as tx
from auditspan.knowledge import fixed_values as fixed


def enrich_checks(checks: DataFrame, checklist: DataFrame) -> DataFrame:
    """Title, severity, law and recommendation from the checklist."""
    known = checklist.select(
        F.col("id").alias("check_id"), "title", "description", "severity", "law_reference", "recommendation")
    return checks.join(known, "check_id", "left").withColumns({
        "title": F.coalesce("title", "check_id"), "description": F.coalesce("description", F.lit("")),
        "severity": F.coalesce("severity", F.lit("medium"))})


def roubles(amount: Column) -> Column:
    return F.format_number(amount, 0)


def enrich_violations(violations: DataFrame, checklist: DataFrame, fines: DataFrame) -> DataFrame:
    """Severity, law, recommendation and, for grave ones, the fine range."""
    known = checklist.select(
        F.col("id").alias("check_id"), "severity", "law_reference",
        F.col("recommendation").alias("advice"), "fine_reference")
    priced = fines.select(
        F.col("id").alias("fine_reference"), "first_offense_min", "first_offense_max")
    joined = violations.join(known, "check_id", "left").join(priced, "fine_reference", "left")
    return joined.withColumns({
        "severity": F.coalesce("severity", F.lit("medium")),
        "law_reference": F.coalesce("law_reference", F.lit("")),
        "recommendation": F.coalesce("recommendation", "advice", F.lit("")),
    }).withColumn("fine_range", F.when(
        F.col("severity").isin("critical", "high") & F.col("first_offense_min").isNotNull(),
        tx.fill(fixed.FINE_RANGE, roubles(F.col("first_offense_min")), roubles(F.col("first_offense_max"))))
    ).drop("advice", "first_offense_min", "first_offense_max")


def score(passed: Column, total: Column) -> Column:
    """Whole per cent, truncated; double arithmetic, not decimal."""
    ratio = passed.cast("double") / F.when(total != 0, total).cast("double")
    return F.coalesce((ratio * F.lit(100.0)).cast("int"), F.lit(0))


def risk_level(score_: Column, critical: Column) -> Column:
    return (F.when((critical >= 3) | (score_ < 30), F.lit("critical"))
            .when((critical >= 1) | (score_ < 50), F.lit("high"))
            .when(score_ < 75, F.lit("medium")).otherwise(F.lit("low")))


def price_outcomes(outcomes: DataFrame, checklist: DataFrame, fines: DataFrame) -> DataFrame:
    """Severity and fine of every check outcome."""
    known = checklist.select(F.col("id").alias("check_id"), "severity", "fine_reference")
    priced = fines.select(
        F.col("id").alias("fine_reference"), "violation", "law_reference",
        "first_offense_min", "first_offense_max", "repeat_offense_max")
    return (
        outcomes.join(known, "check_id", "left").join(priced, "fine_reference", "left")
        .withColumn("severity", F.coalesce("severity", F.lit("medium"))))


def fold_outcomes(priced: DataFrame, key: str, *carry: Column) -> DataFrame:
    """Totals, score, risk and fine estimate from priced outcomes.

    Only unreadable checks (manual review) leave the denominator of the score.
    Each kind of fine counts once; the breakdown is in order of first appearance.
    """
    status, weight = F.col("status"), F.col("occurrences")
    item = F.struct(
        "check_ord", F.col("fine_reference").alias("fine_id"), "violation",
        F.col("first_offense_min").alias("min_fine"), F.col("first_offense_max").alias("max_fine"),
        "law_reference", "repeat_offense_max")
    failing = (weight > 0) & F.col("first_offense_min").isNotNull()

    def total(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, weight)), F.lit(0))

    folded = priced.groupBy(key).agg(
        F.count_if(status != "manual_review_needed").alias("total_checks"),
        F.count_if(status == "pass").alias("passed_checks"),
        F.count_if(status == "fail").alias("failed_checks"),
        F.count_if(status == "warning").alias("warnings"),
        total(F.lit(True)).alias("violations"),
        total(F.col("severity") == "critical").alias("critical_violations"),
        total(F.col("severity") == "high").alias("high_violations"),
        # bounded by the number of declared checks
        F.array_sort(F.collect_list(F.when(failing, item))).alias("_items"),
        *carry)
    ids = F.transform("_items", lambda x: x.getField("fine_id"))
    breakdown = F.filter("_items", lambda x, i: F.array_position(ids, x.getField("fine_id")) == i + 1)

    def amount(name: str) -> Column:
        return F.aggregate("fine_breakdown", F.lit(0).cast("bigint"), lambda acc, x: acc + x.getField(name))

    return (
        folded.withColumn("fine_breakdown", breakdown)
        .withColumn("overall_score", score(F.col("passed_checks"), F.col("total_checks")))
        .withColumns({
            "fine_min": amount("min_fine"), "fine_max": amount("max_fine"),
            "risk_level": risk_level(F.col("overall_score"), F.col("critical_violations")),
            "summary": fallback_summary(
                F.col("violations"), F.col("critical_violations"), F.col("high_violations")),
        }).drop("_items"))


def fallback_summary(total: Column, critical: Column, high: Column) -> Column:
    return tx.fill(fixed.FALLBACK_SUMMARY, total, critical, high)


def scan_limitations(crawler_notes: Column | None = None) -> Column:
    """Notes on what the scan could not see, crawler notes first."""
    has_forms = F.col("forms_pd") > 0
    accept = F.coalesce(F.col("banner.has_accept"), F.lit(False))
    notes = F.array(
        F.when(~has_forms, F.lit(fixed.NOTE_NO_FORMS)),
        F.when(~has_forms, F.lit(fixed.NOTE_NO_CHECKBOX)),
        F.when(has_forms, F.lit(fixed.NOTE_SPA_CHECKBOX)),
        F.when(~F.col("banner_found") | ~accept, F.lit(fixed.NOTE_BANNER)),
        F.when(F.col("policy_found") & ~F.col("policy_has_text"), F.lit(fixed.NOTE_POLICY_UNREADABLE)))
    own = F.array_compact(notes)
    return own if crawler_notes is None else F.concat(crawler_notes, own)


def violation_lines(violations: DataFrame, limit: int) -> DataFrame:
    """The first violations of a site as one text.

    The rank filter is a group limit: each map task forwards at most ``limit``
    rows per site, and only those are gathered.
    """
    order = ["check_ord", "page_ord", "form_ord"]
    rank = F.row_number().over(Window.partitionBy("site").orderBy(*order))
    line = F.concat(F.lit("- ["), F.col("severity"), F.lit("] "), F.col("title"), F.lit(": "), F.col("description"))
    top = violations.withColumn("rank", rank).filter(F.col("rank") <= limit)
    return top.groupBy("site").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))),
        lambda r: r.getField("line")), "\n").alias("violations_summary"))


def summary_inputs(sites: DataFrame, site_scripts: DataFrame, lines: DataFrame) -> DataFrame:
    """Facts a summary is written from, one row per site."""
    def word(kind: str, test: str) -> Column:
        yes, no = fixed.SUMMARY_WORDS[kind]
        return F.when(F.col(test), F.lit(yes)).otherwise(F.lit(no))

    prohibited = site_scripts.groupBy("site").agg(F.count_if("is_prohibited").alias("prohibited_scripts"))
    return sites.join(prohibited, "site", "left").join(lines, "site", "left").select(
        "site", "site_url", "pages_scanned", F.col("forms_forms").alias("forms_count"),
        F.col("forms_no_box").alias("forms_without_consent"),
        F.coalesce("prohibited_scripts", F.lit(0)).alias("prohibited_scripts"),
        word("banner", "banner_found").alias("cookie_banner_status"),
        word("policy", "policy_found").alias("privacy_policy_status"),
        word("https", "has_ssl").alias("https_status"),
        F.coalesce("violations_summary", F.lit(fixed.SUMMARY_WORDS["no_violations"])).alias("violations_summary"))
