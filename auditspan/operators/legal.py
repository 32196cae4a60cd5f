"""Legal updates: selection, novelty, text blocks, affected documents."""
from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspan.functions import replies
from auditspan.functions import text as tx
from auditspan.knowledge import fixed_values as fixed


def for_document(updates: DataFrame, doc_type: str) -> DataFrame:
    return updates.filter(F.array_contains("affected_documents", doc_type))


def active(updates: DataFrame, as_of: date | Column) -> DataFrame:
    """Updates in force on a day, that day included."""
    day = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return updates.filter(F.to_date("effective_date") <= day)


def per_document(updates: DataFrame) -> DataFrame:
    """One row per (document type, update)."""
    return updates.select("*", F.explode("affected_documents").alias("doc_type"))


def active_for_requests(requests: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates in force for (doc_type, as_of) requests: an equi-join, then the date."""
    return requests.join(per_document(updates), "doc_type").filter(
        F.to_date("effective_date") <= F.col("as_of"))


def selected(updates: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Updates named in a list of ids; without a list, all of them."""
    return updates if ids is None else updates.join(ids.select("id").distinct(), "id", "left_semi")


def new_updates(found: DataFrame, stored: DataFrame, order: str = "found_ord") -> DataFrame:
    """Found updates that are not stored yet, the first of each ``source:title``."""
    key = replies.content_key(F.col("source"), F.col("title"))
    keyed = found.withColumn("content_key", key)
    row = F.struct(*[F.col(c) for c in found.columns])
    first = keyed.groupBy("content_key").agg(F.min_by(row, F.col(order)).alias("u")).select("content_key", "u.*")
    return first.join(stored.select(key.alias("content_key")), "content_key", "left_anti")


def _requirement_lines(title: str) -> Column:
    lines = F.transform("requirements", lambda r: F.concat(F.lit("\n  - "), r))
    return F.when(F.size("requirements") > 0, F.concat(F.lit(f"\n{title}"), F.array_join(lines, ""))).otherwise(F.lit(""))


def context_block() -> Column:
    """Lines of one update inside a document's legal context."""
    return F.concat(tx.fill(
        fixed.CONTEXT_UPDATE, "title", "effective_date", "source", F.array_join("articles", ", "),
        F.coalesce("summary", F.lit(""))), _requirement_lines(fixed.CONTEXT_REQUIREMENTS), F.lit("\n"))


def legal_context(updates: DataFrame) -> DataFrame:
    """Context text per document type, newest update first.

    The gathered list is the set of known legal updates of one document type, a
    hand-curated table, never page or event data.
    """
    blocks = per_document(updates).withColumn("block", context_block())
    entry = F.struct((-F.unix_date(F.to_date("effective_date"))).alias("newest"), "id", "block")
    return blocks.groupBy("doc_type").agg(F.concat(
        F.lit(fixed.LEGAL_CONTEXT_HEADER + "\n\n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.getField("block")), "\n")
    ).alias("legal_context"))


def combined_context(stored: Column, web: Column) -> Column:
    """Stored context and web context, either may be empty."""
    return F.concat_ws(
        "\n\n", F.when(F.coalesce(stored, F.lit("")) != "", stored),
        F.when(F.coalesce(web, F.lit("")) != "", F.concat(F.lit(fixed.WEB_CONTEXT_HEADER + "\n\n"), web)))


def update_text() -> Column:
    """One update as a text block for a document rewrite."""
    return F.concat(tx.fill(
        fixed.UPDATE_BLOCK, "title", "source", "effective_date", F.array_join("articles", ", "),
        F.coalesce("summary", F.lit(""))), _requirement_lines(fixed.UPDATE_REQUIREMENTS))


def merge_hits(document_hits: DataFrame, general_hits: DataFrame, *by: str) -> DataFrame:
    """Search hits of two lists without repeats; document hits take precedence."""
    hits = document_hits.withColumn("list_ord", F.lit(0)).unionByName(general_hits.withColumn("list_ord", F.lit(1)))
    row = F.struct("list_ord", "hit_ord", "title", "content")
    return hits.groupBy(*by, "url").agg(F.min_by(row, F.struct("list_ord", "hit_ord")).alias("h")).select(
        *by, "url", "h.*")


def top_hits(hits: DataFrame, limits: dict[int, int], *by: str) -> DataFrame:
    """The first hits of each list, e.g. ``{0: 8, 1: 5}``."""
    rank = F.row_number().over(Window.partitionBy(*by, "list_ord").orderBy("hit_ord", "url"))
    cap = F
    for which, limit in limits.items():
        cap = cap.when(F.col("list_ord") == which, F.lit(limit))
    # one constant bound lets the optimiser limit each group before the shuffle
    return hits.withColumn("rank", rank).filter(F.col("rank") <= max(limits.values())).filter(
        F.col("rank") <= cap.otherwise(F.lit(0)))


def numbered_hits(hits: DataFrame, *by: str) -> DataFrame:
    """Top hits as one numbered text per group (``hits`` come from :func:`top_hits`)."""
    block = tx.fill(fixed.HIT_BLOCK, *[F.coalesce(c, F.lit("N/A")) for c in ("url", "title", "content")])
    rows = F.array_sort(F.collect_list(F.struct("list_ord", "rank", "url", block.alias("block"))))
    lines = F.transform(rows, lambda r, i: F.concat(tx.fill(fixed.HIT_HEADER, i + 1), r.getField("block")))
    return hits.groupBy(*by).agg(F.array_join(lines, "\n").alias("results_text"))


def recent_organizations(reports: DataFrame, since: Column | None = None) -> DataFrame:
    """Organisations that own a report, or one dated ``since`` or later."""
    kept = reports if since is None else reports.filter(F.col("report_date") >= since)
    return kept.select("organization_id").filter("organization_id IS NOT NULL").distinct()


def affected_documents(updates: DataFrame, documents: DataFrame, organizations: DataFrame | None = None) -> DataFrame:
    """Documents an update touches, optionally of some organisations only."""
    touched = per_document(updates).select(
        F.col("id").alias("update_id"), F.col("title").alias("update_title"), "doc_type")
    pool = documents if organizations is None else documents.join(organizations, "organization_id", "left_semi")
    return pool.join(touched, "doc_type")
