"""Structured Streaming forms of the monitoring dataflows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditspan.functions import replies
from auditspan.functions import text as tx
from auditspan.operators import digest, monitoring, pages
from auditspan.streaming.processors import BestOfWeek, FirstSeen, SnapshotRouter, use_rocksdb

#: parts that the changes of one week are gathered in
WEEK_PARTS = 16
#: parts that the keys of known updates are kept in
KEY_PARTS = 256
_WEEK = 7 * 24 * 3600 * 1_000_000
#: microseconds of Monday 1970-01-05 10:00, the end of a digest period
_MONDAY = (4 * 24 + 10) * 3600 * 1_000_000


def snapshot_changes(snapshots: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Route of every arriving snapshot against the one before it in time.

    Snapshots may arrive up to ``delay`` out of order: each is held back until the watermark reaches it.
    Later ones, and those without a time, come out with route ``late``.  A snapshot leaves when the watermark,
    the newest time less ``delay``, has passed it.
    """
    use_rocksdb(snapshots.sparkSession)
    # the time goes on as a number: a watermarked column would drop late rows unseen
    none = F.lit(SnapshotRouter.NONE)
    rows = snapshots.withWatermark("captured_at", delay).select(
        F.coalesce("id", none).alias("id"), *monitoring.KEYS, "content_hash", "raw_text", "fetch_status",
        F.coalesce(F.unix_micros("captured_at"), none).alias("at"), tx.count_items(F.col("raw_text")).alias("items"))
    routed = rows.groupBy(*monitoring.KEYS).transformWithStateInPandas(
        SnapshotRouter(), SnapshotRouter.ROUTED_TYPES, "Append", "EventTime")
    return routed.withColumns({"id": F.nullif("id", none), "captured_at": F.timestamp_micros(F.nullif("at", none))}).drop("at")


def new_updates(found: DataFrame, event_time: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """First appearance of every ``source:title``; rows without a time count as others do.

    ``known`` holds the ``content_key`` of updates that are stored already.  They are the stream's initial
    state, so none of them comes out and no batch join is needed afterwards.
    """
    use_rocksdb(found.sparkSession)
    time = F.lit(None).cast("long") if event_time is None else F.unix_micros(event_time)
    part = F.pmod(F.xxhash64("content_key"), F.lit(KEY_PARTS)).cast("int").alias("part")
    none = F.lit(FirstSeen.LATEST)
    rows = found.select(replies.content_key(F.col("source"), F.col("title")).alias("content_key"), "source", "title",
                        F.coalesce(time, none).alias("found_at")).select("*", part)
    state = None if known is None else known.select("content_key").distinct().select("*", part).groupBy("part")
    first = rows.groupBy("part").transformWithStateInPandas(
        FirstSeen(), "content_key string, source string, title string, found_at long", "Append", "None", initialState=state)
    return first.withColumn("found_at", F.timestamp_micros(F.nullif("found_at", none)))


def weekly_changes(changes: DataFrame, limit: int, delay: str = "1 day") -> DataFrame:
    """The best ``limit`` changes of every part of a week, once the week is over.

    Weeks end on Monday at 10:00.  A change whose week is over already, or without a time, is left out.  The
    columns ``changes`` and ``legal_changes`` add up to the week's totals.
    """
    use_rocksdb(changes.sparkSession)
    at = F.unix_micros("detected_at")
    week_end = F.col("at") - F.pmod(F.col("at") - F.lit(_MONDAY), F.lit(_WEEK)) + F.lit(_WEEK)
    rows = changes.withWatermark("detected_at", delay).select(
        "id", "source_id", "url", "diff_summary", "change_type", "threat_score", "npa_critical", at.alias("at"),
        digest.is_legal(F.col("change_type"), F.col("npa_critical")).alias("legal")).filter("at is not null")
    rows = rows.withColumn("week_end", week_end).withColumn(
        "part", F.pmod(F.xxhash64("id"), F.lit(WEEK_PARTS)).cast("int"))
    # numbers in the frames that the parts are handed over in
    none = F.lit(BestOfWeek.NONE)
    best = rows.withColumn("id", F.coalesce("id", none)).groupBy("week_end", "part").transformWithStateInPandas(
        BestOfWeek(limit), f"week_end long, part int, {BestOfWeek.CHANGE}, changes long, legal_changes long",
        "Append", "EventTime")
    return best.withColumn("id", F.nullif("id", none))


def digest_writer(deliver: Callable[[DataFrame, int], None], limit: int):
    """foreachBatch function over :func:`weekly_changes` that hands on the digest of every week that is over.

    All parts of a week end with the same watermark, so one micro-batch holds them all.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        weeks = batch.withColumns({"week_end": F.timestamp_micros("week_end"), "detected_at": F.timestamp_micros("at")})
        order = Window.partitionBy("week_end").orderBy(
            F.col("threat_score").desc_nulls_last(), F.col("detected_at").desc(), F.col("id").asc_nulls_last())
        best = weeks.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
        texts = digest.digest_text(best, F.date_format("week_end", "dd.MM.yyyy"), "week_end")
        totals = weeks.groupBy("week_end").agg(F.sum("changes").alias("all_changes"), F.sum("legal_changes").alias("legal_changes"))
        deliver(texts.select("week_end", F.col("changes").alias("listed"), "max_score", "content_md").join(totals, "week_end"), epoch)
    return write


def alert_writer(deliver: Callable[[DataFrame, int], None]):
    """foreachBatch function that hands critical changes on at once."""
    def write(batch: DataFrame, epoch: int) -> None:
        alerts = monitoring.critical_alerts(batch).withColumn("message", digest.alert_text())
        deliver(alerts, epoch)
    return write


def arriving_pages(crawl: DataFrame) -> DataFrame:
    """Page facts of newly stored pages; stateless, so files extract as they come.

    Pages are dealt out to all tasks: a few large files arrive at a time, and reading a page costs far more than moving it.
    """
    return pages.page_facts(crawl.repartition("url", "page_ord"))
