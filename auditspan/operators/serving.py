"""Report serving: lists, groupings, previews and sentences."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspan.knowledge import fixed_values as fixed

_FIRST_SEEN = ("check_ord", "page_ord", "form_ord")


def _rank_of(value: Column, order, unknown: int = 9) -> Column:
    chain = F
    for name, position in order:
        chain = chain.when(value == name, F.lit(position))
    return chain.otherwise(F.lit(unknown))


def severity_rank(severity: Column) -> Column:
    return _rank_of(F.lower(severity), fixed.SEVERITY_ORDER)


def status_rank(status: Column) -> Column:
    return _rank_of(F.lower(status), fixed.STATUS_ORDER)


def by_severity(violations: DataFrame) -> DataFrame:
    """Violations of every site, gravest first, otherwise in emission order."""
    return violations.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy(
        "site", "severity_rank", *_FIRST_SEEN)


def by_status(checks: DataFrame) -> DataFrame:
    return checks.withColumn("status_rank", status_rank(F.col("status"))).orderBy(
        "site", "status_rank", "check_ord")


def violation_pages(violations: DataFrame) -> DataFrame:
    """(site, check, page) once, with its occurrences and first position."""
    return violations.groupBy("site", "check_id", "page_url").agg(
        F.count("*").alias("occurrences"), F.min(F.struct(*_FIRST_SEEN)).alias("seen"))


def violation_groups(violations: DataFrame, shown: int = 3) -> DataFrame:
    """One row per (site, check): occurrences, distinct pages, first pages.

    Pages are made distinct by a map-side aggregate first; the list holds only
    ``shown`` of them (group limit), and the full list stays in
    :func:`violation_pages`.
    """
    pages = violation_pages(violations)
    totals = pages.groupBy("site", "check_id").agg(
        F.sum("occurrences").alias("occurrences"), F.count("page_url").alias("pages"),
        F.min("seen").alias("seen"))
    rank = F.row_number().over(Window.partitionBy("site", "check_id").orderBy("seen", "page_url"))
    first = pages.filter("page_url IS NOT NULL").withColumn("rank", rank).filter(
        F.col("rank") <= shown).groupBy("site", "check_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "page_url"))).alias("first"))
    return totals.join(first, ["site", "check_id"], "left").select(
        "site", "check_id", "seen", "occurrences", "pages",
        F.coalesce(F.transform("first", lambda x: x.getField("page_url")),
                   F.array().cast("array<string>")).alias("first_pages"),
        F.greatest(F.col("pages") - shown, F.lit(0)).alias("more_pages"))


def violation_totals(groups: DataFrame) -> DataFrame:
    return groups.groupBy("site").agg(
        F.count("*").alias("types"), F.sum("occurrences").alias("occurrences"))


def critical_highlights(violations: DataFrame, shown: int = 5) -> DataFrame:
    """First occurrence of each critical check with its repeats, top ``shown``."""
    row = F.struct("title", "law_reference", "fine_range", "recommendation")
    first = violations.filter("severity = 'critical'").groupBy("site", "check_id").agg(
        F.min_by(row, F.struct(*_FIRST_SEEN)).alias("v"), F.min(F.struct(*_FIRST_SEEN)).alias("seen"),
        (F.count("*") - 1).alias("repeats"))
    rank = F.row_number().over(Window.partitionBy("site").orderBy("seen"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= shown).select(
        "site", "rank", "check_id", "v.*", "repeats")


def preview(violations: DataFrame, shown: int = 3, critical_last: bool = False) -> DataFrame:
    """First violation per check, gravest first.

    ``critical_last`` reproduces the order of the web preview, where critical
    rows fall behind all others.
    """
    first = violations.groupBy("site", "check_id").agg(
        F.min_by(F.struct("severity", "title", "fine_range"), F.struct(*_FIRST_SEEN)).alias("v"),
        F.min(F.struct(*_FIRST_SEEN)).alias("seen"))
    grade = severity_rank(F.col("v.severity"))
    if critical_last:
        grade = F.when(grade == 0, F.lit(9)).otherwise(grade)
    rank = F.row_number().over(Window.partitionBy("site").orderBy(grade, "seen"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= shown).select(
        "site", "rank", "check_id", "v.*")


def newest(table: DataFrame, time: str, limit: int, *tie: str) -> DataFrame:
    """Newest rows of a table (top-k, not a full sort)."""
    return table.orderBy(F.col(time).desc_nulls_last(), *[F.col(c).desc() for c in tie]).limit(limit)


def by_id(table: DataFrame, value: str, column: str = "id") -> DataFrame:
    """Row with a given id; searched in the whole table."""
    return table.filter(F.col(column) == value)


def score_sentence(score: Column) -> Column:
    chain = F
    for bottom, sentence in fixed.SCORE_SENTENCES[:-1]:
        chain = chain.when(score >= bottom, F.lit(sentence))
    return chain.otherwise(F.lit(fixed.SCORE_SENTENCES[-1][1]))


def generation_totals(documents: DataFrame) -> DataFrame:
    """Counts for a generation response: all documents and the successful ones."""
    return documents.groupBy("organization_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("successful"))
