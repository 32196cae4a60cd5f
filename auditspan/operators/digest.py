"""Pending changes, alerts and the periodic digest text."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspan.functions import text as tx
from auditspan.knowledge import fixed_values as fixed


def pending_changes(changes: DataFrame, digested: DataFrame, limit: int) -> DataFrame:
    """Changes not yet part of a digest: highest score, then newest, top ``limit``.

    Digest membership is an append-only table (change_id, digest_id), so marking
    changes never rewrites them.
    """
    fresh = changes.join(digested.select(F.col("change_id").alias("id")), "id", "left_anti")
    return fresh.orderBy(
        F.col("threat_score").desc_nulls_last(), F.col("detected_at").desc(), F.col("id")).limit(limit)


def is_legal(change_type: Column, npa_critical: Column) -> Column:
    return F.coalesce((change_type == "npa") | F.coalesce(npa_critical, F.lit(False)), F.lit(False))


def split_pending(pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    legal = is_legal(F.col("change_type"), F.col("npa_critical"))
    return pending.filter(legal), pending.filter(~legal)


def mark_digested(pending: DataFrame, digest_id: int) -> DataFrame:
    """Membership rows to append once the digest has been delivered."""
    return pending.select(F.col("id").alias("change_id"), F.lit(digest_id).cast("bigint").alias("digest_id"))


def _label(value: Column, pairs, otherwise: Column) -> Column:
    chain = F
    for key, text in pairs:
        chain = chain.when(value == key, F.lit(text))
    return chain.otherwise(otherwise)


def threat_label(score: Column) -> Column:
    full = [(k, fixed.THREAT_OF_FIVE.format(v, k)) for k, v in fixed.THREAT_LABELS]
    other = tx.fill(fixed.THREAT_OTHER + "/5", score)
    return F.when(score.isNull(), F.lit(fixed.THREAT_UNKNOWN)).otherwise(_label(score, full, other))


def change_block(critical: Column | None = None) -> Column:
    """Markdown block of one change."""
    source = tx.fill("`{}`", "source_id")
    header = source if critical is None else F.when(
        critical, tx.fill(fixed.DIGEST_CRITICAL_BADGE, source)).otherwise(source)
    kind = F.coalesce("change_type", F.lit("?"))
    meta = tx.fill(fixed.DIGEST_META, _label(kind, fixed.CHANGE_TYPE_LABELS, kind), threat_label(F.col("threat_score")))
    summary = F.when(F.coalesce("diff_summary", F.lit("")) != "", F.col("diff_summary")).otherwise(
        F.lit(fixed.DIGEST_NO_SUMMARY))
    link = F.when(F.coalesce("url", F.lit("")) != "", tx.fill(fixed.DIGEST_LINK, "url"))
    return F.concat_ws("\n", header, meta, summary, link)


def digest_order(pending: DataFrame) -> DataFrame:
    """Pending rows with their section and sort key: critical first, then score."""
    legal = is_legal(F.col("change_type"), F.col("npa_critical"))
    critical = F.coalesce("npa_critical", F.lit(False))
    return pending.withColumns({
        "section": F.when(legal, F.lit("npa")).otherwise(F.lit("competitor")),
        "sort_key": F.struct(
            F.when(legal & critical, F.lit(0)).otherwise(F.lit(1)).alias("critical"),
            (-F.coalesce("threat_score", F.lit(0))).alias("score"),
            F.coalesce(F.col("threat_score").isNull(), F.lit(False)).alias("unscored"),
            (-F.unix_micros(F.col("detected_at").cast("timestamp"))).alias("newest"), F.col("id").alias("id"))})


def digest_text(pending: DataFrame, day: Column, *by: str) -> DataFrame:
    """One Markdown digest (per group ``by``); no row when nothing is pending.

    ``pending`` is the limited list of :func:`pending_changes`; the gathered
    blocks are bounded by that limit.
    """
    legal = F.col("section") == "npa"
    critical = F.when(legal, F.coalesce("npa_critical", F.lit(False))).otherwise(F.lit(False))
    entry = F.struct("sort_key", F.concat(change_block(critical), F.lit("\n\n")).alias("block"))

    def section(name: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("section") == name, entry)))
        blocks = F.array_join(F.transform(rows, lambda r: r.getField("block")), "")
        return F.when(F.size(rows) > 0, blocks).otherwise(F.lit(fixed.DIGEST_EMPTY_SECTION + "\n"))

    gathered = digest_order(pending).groupBy(*by).agg(
        F.count("*").alias("changes"), F.max("threat_score").alias("max_score"),
        section("npa").alias("npa"), section("competitor").alias("competitors"))
    rule = fixed.DIGEST_DIVIDER
    text = F.concat(
        tx.fill(fixed.DIGEST_HEADER, day, threat_label(F.col("max_score"))),
        F.lit(f"{rule}\n\n{fixed.DIGEST_LEGAL_SECTION}\n\n"), F.col("npa"),
        F.lit(f"\n{rule}\n\n{fixed.DIGEST_COMPETITOR_SECTION}\n\n"), F.col("competitors"))
    return gathered.filter("changes > 0").withColumn("content_md", F.regexp_replace(text, r"\s+\z", ""))


def truncate_message(text: Column, limit: int = fixed.MESSAGE_LIMIT) -> Column:
    suffix = fixed.MESSAGE_CUT_SUFFIX
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit - len(suffix)), F.lit(suffix)))


def alert_text() -> Column:
    """Message for one critical change; cut to the messenger's limit."""
    score = F.coalesce("threat_score", F.lit(0))
    label = _label(score, fixed.THREAT_LABELS, tx.fill(fixed.THREAT_OTHER, score))
    act = F.coalesce("action_required", F.lit(False)) & (F.coalesce("action", F.lit("")) != "")
    return truncate_message(F.concat_ws(
        "\n", F.lit(fixed.ALERT_HEADER), F.lit(""),
        tx.fill(fixed.ALERT_SOURCE, F.coalesce("source_name", "source_id", F.lit("?"))),
        tx.fill(fixed.ALERT_THREAT, label), tx.fill(fixed.ALERT_URL, F.coalesce("url", F.lit(""))), F.lit(""),
        F.lit(fixed.ALERT_CHANGE), F.coalesce("diff_summary", F.lit(fixed.ALERT_NO_SUMMARY)),
        F.when(act, tx.fill(fixed.ALERT_ACTION, "action"))))
