"""Change monitoring over the snapshot history."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspan.functions import diffs, replies
from auditspan.functions import text as tx
from auditspan.session import cut_lineage

KEYS = ("source_id", "url")
_IS_CHANGED = "fetch_status = 'ok' AND has_previous AND content_hash <> previous_hash"


def snapshot_rows(fetches: DataFrame) -> DataFrame:
    """Rows to store: whole texts; failed fetches have no text or hash."""
    ok = F.col("fetch_status") == "ok"
    text = F.when(ok, F.col("text")).otherwise(F.lit(""))
    return fetches.select(
        "id", *KEYS, F.when(ok, F.sha2("text", 256)).otherwise(F.lit("")).alias("content_hash"),
        text.alias("raw_text"), "fetch_status", "captured_at")


def snapshot_history(snapshots: DataFrame, bucket: str = "day") -> DataFrame:
    """Every snapshot, without its text, with the one before it.

    A page can be polled so often that its history alone is a large share of the
    table.  The history of a page is therefore cut into time buckets that are
    windowed in parallel; each bucket hands one small tail row to the next, and
    the tails of a page (one per bucket) form the only per-page sequence.

    Only ids, hashes and counts are sorted; :func:`with_texts` fetches the texts of the rows that need them.
    Adds ``has_previous``, ``previous_id``, ``previous_hash``, ``items`` and
    ``recent_items`` (counts of up to three good snapshots, newest first).
    """
    items = F.when(F.col("fetch_status") == "ok", tx.count_items(F.col("raw_text"))).otherwise(F.lit(0))
    rows = snapshots.withColumns({
        "bucket": F.date_trunc(bucket, "captured_at"), "items": items}).withColumn(
        "good", F.when(F.col("fetch_status") == "ok", F.col("items"))).drop("raw_text")
    order = ["captured_at", "id"]
    over = f"OVER (PARTITION BY {', '.join(KEYS)}, bucket ORDER BY captured_at, id)"
    here = Window.partitionBy(*KEYS, "bucket").orderBy(*order)
    within = rows.withColumns({
        "first_here": F.row_number().over(here) == 1,
        "last_here": F.lead(F.lit(True)).over(here).isNull(),
        "near_hash": F.lag("content_hash").over(here), "near_id": F.lag("id").over(here),
        "near_good": F.array_compact(F.array(*[F.expr(f"lag(good, {k}) IGNORE NULLS {over}") for k in (1, 2, 3)])),
    })
    # the last row of every bucket, with the good counts up to and including it
    tails = within.filter("last_here").select(
        *KEYS, "bucket", F.col("content_hash").alias("tail_hash"), F.col("id").alias("tail_id"),
        F.slice(F.array_compact(F.concat(F.array("good"), F.col("near_good"))), 1, 3).alias("tail_good"))
    across = Window.partitionBy(*KEYS).orderBy("bucket")
    across_sql = f"OVER (PARTITION BY {', '.join(KEYS)} ORDER BY bucket)"
    carried = tails.withColumn("full_tail", F.when(F.size("tail_good") > 0, F.col("tail_good"))).select(
        *KEYS, "bucket", F.lag(F.lit(True)).over(across).alias("far"),
        F.lag("tail_hash").over(across).alias("far_hash"), F.lag("tail_id").over(across).alias("far_id"),
        F.slice(F.concat(*[F.coalesce(F.expr(f"lag(full_tail, {k}) IGNORE NULLS {across_sql}"),
                                      F.array().cast("array<int>")) for k in (1, 2, 3)]), 1, 3).alias("far_good"))
    joined = within.join(carried, [*KEYS, "bucket"], "left")
    first = F.col("first_here")
    return joined.withColumns({
        "has_previous": ~first | F.coalesce("far", F.lit(False)),
        "previous_id": F.when(first, F.col("far_id")).otherwise(F.col("near_id")),
        "previous_hash": F.when(first, F.col("far_hash")).otherwise(F.col("near_hash")),
        "recent_items": F.slice(F.concat("near_good", F.coalesce("far_good", F.array().cast("array<int>"))), 1, 3),
    }).select(*[c for c in snapshots.columns if c != "raw_text"], "items", "has_previous", "previous_id", "previous_hash",
              "recent_items")


def with_texts(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``rows`` of a history with ``raw_text`` and ``previous_text``; ``id`` is a key of ``snapshots``.

    Texts are read once: a semi-join lets those of the rows and of the ones before them through, and both
    joins read its one exchange.  They are hash joins by id, so no text is sorted.
    """
    needed = rows.select(F.explode(F.array("id", "previous_id")).alias("id"))
    texts = snapshots.select("id", "raw_text").join(needed.hint("shuffle_hash"), "id", "left_semi")
    before = texts.select(F.col("id").alias("previous_id"), F.col("raw_text").alias("previous_text"))
    own = rows.hint("shuffle_hash").join(texts, "id")
    return own.join(before.hint("shuffle_hash"), "previous_id", "left")


def parse_warnings(history: DataFrame) -> DataFrame:
    """Nothing found now although the last three good snapshots all had content."""
    return history.filter(
        (F.col("items") == 0) & (F.size("recent_items") == 3)
        & F.forall("recent_items", lambda n: n > 0)).select("id", *KEYS, "captured_at", "fetch_status")


def last_good_baseline(snapshots: DataFrame, bucket: str = "day") -> DataFrame:
    """History in which failed fetches are left out, as if they never happened."""
    return snapshot_history(snapshots.filter("fetch_status = 'ok'"), bucket)


def changed_snapshots(history: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Good snapshots whose hash differs from the previous row (failed fetches
    count as an empty previous row), with both texts."""
    return with_texts(history.filter(_IS_CHANGED), snapshots).withColumn(
        "previous_text", F.coalesce("previous_text", F.lit("")))


def changed_diffs(history: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The same snapshots with the unified diff and without texts; each pair of texts is compared once.

    ``content_hash`` names a text, as :func:`snapshot_rows` makes it: a page that goes back and forth between
    two texts has two pairs, however often it is polled.  The changed rows, which have no texts, are written
    once, because pairs and result read them.
    """
    changed = cut_lineage(history.filter(_IS_CHANGED).select(
        "id", *KEYS, "content_hash", "previous_hash", "captured_at"), "changed")
    texts = snapshots.select("content_hash", "raw_text").distinct()
    before = texts.select(F.col("content_hash").alias("previous_hash"), F.col("raw_text").alias("previous_text"))
    pairs = changed.select("previous_hash", "content_hash").distinct()
    compared = with_diff(pairs.join(before, "previous_hash").join(texts, "content_hash"))
    return changed.join(compared.select("previous_hash", "content_hash", "diff"), ["previous_hash", "content_hash"])


def with_diff(changed: DataFrame) -> DataFrame:
    """Changed rows with the unified diff of their texts."""
    return diffs.with_snapshot_diff(changed, "previous_text", "raw_text")


def route(history: DataFrame) -> Column:
    """What happens to a snapshot before any diff is made."""
    return (F.when(F.col("fetch_status") != "ok", F.lit("failed"))
            .when(~F.col("has_previous"), F.lit("baseline"))
            .when(F.col("content_hash") == F.col("previous_hash"), F.lit("unchanged"))
            .otherwise(F.lit("changed")))


def competitor_changes(diffed: DataFrame, sources: DataFrame) -> DataFrame:
    """Class and route of competitor changes: saved at once, or queued."""
    known = sources.select("source_id", "llm_analyze").distinct()
    classed = diffed.join(known, "source_id", "left").withColumn(
        "change_type", diffs.change_class(F.col("diff")))
    queued = (F.col("change_type") != "minor") & F.coalesce("llm_analyze", F.lit(True))
    return classed.withColumn("route", F.when(queued, F.lit("analyse")).otherwise(F.lit("save")))


def merge_analyses(changes: DataFrame, analyses: DataFrame) -> DataFrame:
    """Queued changes with their analysis, by change id.

    A failed analysis leaves the heuristic class and no score.
    """
    # join first: only replies to queued changes are parsed
    answered = replies.with_json(changes.join(analyses.select("id", "reply"), "id", "left"))
    joined = answered.withColumn("a", replies.analysis(F.col("doc")))
    use = (F.col("route") == "analyse") & F.col("a").isNotNull()
    return joined.select(
        "id", *KEYS, F.when(use, F.col("a.summary")).alias("diff_summary"),
        F.when(use, F.col("a.change_type")).otherwise(F.col("change_type")).alias("change_type"),
        F.when(use, F.col("a.threat_score")).alias("threat_score"),
        F.lit(None).cast("boolean").alias("npa_critical"), F.col("captured_at").alias("detected_at"),
        use.alias("analysed"))


def legal_changes(diffed: DataFrame, sources: DataFrame, analyses: DataFrame) -> DataFrame:
    """Changes of legal sources: minor, analysed, or kept without a score."""
    known = sources.select("source_id", F.col("name").alias("source_name"), "keywords",
                           F.col("npa_critical").alias("source_critical"))
    named = diffed.join(known, "source_id", "left").withColumn(
        "meaningful", diffs.is_legally_meaningful(F.col("diff"), F.col("keywords")))
    answered = replies.with_json(named.join(analyses.select("id", "reply"), "id", "left"))
    joined = answered.withColumn("a", replies.analysis(F.col("doc"), legal=True))
    use = F.col("meaningful") & F.col("a").isNotNull()
    return joined.select(
        "id", *KEYS, F.coalesce("source_name", "source_id").alias("source_name"),
        F.when(use, F.col("a.summary")).alias("diff_summary"),
        F.when(~F.col("meaningful"), F.lit("minor")).when(use, F.col("a.change_type"))
        .otherwise(F.lit("npa")).alias("change_type"),
        F.when(use, F.col("a.threat_score")).alias("threat_score"),
        F.when(use, F.col("source_critical")).alias("npa_critical"),
        F.when(use, F.col("a.action_required")).alias("action_required"),
        F.when(use, F.col("a.action")).alias("action"), F.col("captured_at").alias("detected_at"))


def critical_alerts(changes: DataFrame) -> DataFrame:
    """Analysed changes of critical legal sources."""
    return changes.filter(F.coalesce("npa_critical", F.lit(False)) & F.col("threat_score").isNotNull())


def with_source_names(changes: DataFrame, sources: DataFrame) -> DataFrame:
    names = sources.groupBy("source_id").agg(F.min("name").alias("name"))
    return changes.join(names, "source_id", "left").withColumn(
        "source_name", F.coalesce("name", "source_id")).drop("name")
