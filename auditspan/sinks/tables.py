"""Writing results.

Event-like results are appended.  Keyed tables are split into buckets by a hash of the key.  An upsert
rewrites only the buckets that it touches, beside the old ones, and then appends one file to the manifest
that names the live folder of every bucket.  That file appears at once or not at all, so a job that
loses executors, or fails half-way, leaves the old version as it was and readers never see a part of a new one.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspan.localtable import local_table
from auditspan.session import scratch_path  # noqa: F401 - part of this module's interface

MANIFEST = "version long, bucket int, buckets int, key string, folder string"


def append(df: DataFrame, path: str, *partition_by: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("append").format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def scan_rows(sites: DataFrame) -> DataFrame:
    """Scan rows: promoted columns and the whole result as JSON text."""
    return sites.select(
        "site", F.col("site_url"), "pages_scanned", F.current_date().alias("scan_date"),
        F.to_json(F.struct(*[F.col(c) for c in sites.columns])).alias("result_json"))


def report_rows(reports: DataFrame) -> DataFrame:
    return reports.select(
        "site", "site_url", "overall_score", "risk_level", "total_checks", "passed_checks", "failed_checks",
        "summary", F.current_date().alias("report_date"),
        F.to_json(F.struct(*[F.col(c) for c in reports.columns])).alias("report_json"))


def append_scans(sites: DataFrame, path: str) -> None:
    append(scan_rows(sites), path, "scan_date")


def append_reports(reports: DataFrame, path: str) -> None:
    append(report_rows(reports), path, "report_date")


def append_snapshots(snapshots: DataFrame, path: str) -> None:
    append(snapshots.withColumn("day", F.to_date("captured_at")), path, "day")


def append_changes(changes: DataFrame, path: str) -> None:
    append(changes, path)


def append_digest_membership(membership: DataFrame, path: str) -> None:
    append(membership, path)


def append_digest(digest: DataFrame, path: str, period_start: str, period_end: str) -> None:
    append(digest.select(F.lit(period_start).alias("period_start"), F.lit(period_end).alias("period_end"),
                         "content_md", F.current_timestamp().alias("created_at")), path)


def append_legal_updates(updates: DataFrame, path: str) -> None:
    append(updates, path, fmt="json")


def write_alerts(alerts: DataFrame, path: str, epoch: int) -> None:
    """Alerts of one micro-batch; a retried batch replaces its own."""
    alerts.write.mode("overwrite").json(f"{path.rstrip('/')}/epoch={epoch}")


def write_epoch(rows: DataFrame, path: str, epoch: int) -> None:
    """Rows of one micro-batch; a retried batch replaces its own."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch}")


def upserted(existing: DataFrame, incoming: DataFrame, key: str = "id", updated_at: str = "updated_at") -> DataFrame:
    """Newest row per key of both tables, as an aggregate that combines early."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    row = F.struct(*[F.col(c) for c in existing.columns])
    return both.groupBy(key).agg(F.max_by(row, F.struct(updated_at, "_new")).alias("r")).select("r.*")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_bucket")


def _manifest(spark: SparkSession, root: str, version: int | None) -> list:
    """The live folders of a version, one row a bucket; files that are still being written are not listed."""
    entries = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    if version is None:
        version = entries.agg(F.max("version")).first()[0]
    return entries.filter(F.col("version") == version).collect()


def _commit(rows: DataFrame, root: str, key: str, buckets: int, version: int, live: dict[int, str], files: int) -> None:
    """Write the buckets in ``rows``, then the manifest of the version in one file."""
    folder = f"commit={uuid.uuid4().hex}"
    dealt = rows.withColumn("_bucket", _bucket(key, buckets)).repartition(
        "_bucket", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(files)))
    dealt.write.partitionBy("_bucket").parquet(f"{root}/data/{folder}")
    spark = rows.sparkSession
    written = spark.read.schema("_bucket int").parquet(f"{root}/data/{folder}").distinct().collect()
    live = {**live, **{r[0]: f"{folder}/_bucket={r[0]}" for r in written}}
    entries = [(version, bucket, buckets, key, path) for bucket, path in sorted(live.items())]
    # one file: it is moved into place in one step
    local_table(spark, entries, MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def create_keyed(rows: DataFrame, root: str, key: str = "id", *, buckets: int = 64, files: int = 1) -> None:
    """First version of a keyed table; ``files`` are written for each bucket.

    Choose ``buckets`` so that a bucket is what an upsert may rewrite; their number bounds the manifest.
    """
    root = root.rstrip("/")
    # one row for the schema, so that an empty table can be read too
    rows.limit(0).write.mode("errorifexists").parquet(f"{root}/schema")
    _commit(rows, root, key, buckets, 1, {-1: "../schema"}, files)


def merge_keyed(incoming: DataFrame, root: str, updated_at: str = "updated_at", *, files: int = 1) -> int:
    """Upsert ``incoming`` and return the new version.

    Only buckets that hold an incoming key are read and rewritten.  One writer at a time.
    """
    spark, root = incoming.sparkSession, root.rstrip("/")
    entries = _manifest(spark, root, None)
    version, buckets, key = entries[0].version + 1, entries[0].buckets, entries[0].key
    live = {e.bucket: e.folder for e in entries}
    touched = {r[0] for r in incoming.select(_bucket(key, buckets)).distinct().collect()}
    old = _read(spark, root, [live[b] for b in sorted(touched | {-1}) if b in live])
    _commit(upserted(old, incoming.select(old.columns), key, updated_at), root, key, buckets, version, live, files)
    return version


def _read(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    schema = spark.read.parquet(f"{root}/schema").schema
    return spark.read.schema(schema).parquet(*[
        f"{root}/schema" if f == "../schema" else f"{root}/data/{f}" for f in folders])


def read_keyed(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The given version of a keyed table, by default the last that was finished."""
    root = root.rstrip("/")
    return _read(spark, root, [e.folder for e in _manifest(spark, root, version)])


def export_documents(audit, chunk: int = 1000) -> DataFrame:
    """Nested export: one JSON document per site and block of ``chunk`` pages.

    A document holds the scanned pages with their forms and scripts; the 42
    checks and the totals stand in every document of the site.  Blocks keep a
    document bounded however large the site is.
    """
    pages = audit.facts.filter("is_html").withColumn("part", F.floor(F.col("page_ord") / chunk)).select(
        "site", "part", F.struct("page_ord", "url", "title", "status_code", "has_footer_link", "forms",
                                 "resources").alias("page"))
    blocks = pages.groupBy("site", "part").agg(F.sort_array(F.collect_list("page")).alias("pages"))
    checklist = audit.checks.groupBy("site").agg(F.sort_array(F.collect_list(F.struct(
        "check_ord", "check_id", "category", "title", "status", "severity", "details"))).alias("checklist"))
    report = audit.reports.select("site", F.struct(
        "overall_score", "risk_level", "total_checks", "passed_checks", "failed_checks", "warnings",
        "fine_min", "fine_max", "summary").alias("report"))
    joined = blocks.join(checklist, "site").join(report, "site")
    return joined.select("site", "part", F.to_json(F.struct(
        "site", "part", "report", "checklist", "pages")).alias("document"))


def write_export(documents: DataFrame, path: str, run_date: str) -> str:
    """Write under the run date; an earlier run of the day is never overwritten."""
    target = f"{path.rstrip('/')}/run_date={run_date}"
    documents.write.mode("errorifexists").json(target)
    return target
