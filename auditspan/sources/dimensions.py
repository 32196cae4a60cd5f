"""Reference dimensions: built in, or read from JSON/YAML files.

All of them are small, and none is broadcast by a hint: Spark broadcasts a side
whose size it knows to be below ``spark.sql.autoBroadcastJoinThreshold`` and
falls back to a shuffle join when a user's own table is larger.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspan import schemas
from auditspan.functions import text as tx
from auditspan.knowledge import fixed_values as fixed
from auditspan.localtable import local_table


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def _json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def checklist(spark: SparkSession, path: str | None = None) -> DataFrame:
    if path:
        return _json(spark, path, schemas.CHECKLIST)
    return local_table(spark, (
        (cid, category, title, "", severity, law, recommendation, fine, method)
        for cid, category, severity, fine, method, title, law, recommendation in fixed.CHECKLIST),
        schemas.CHECKLIST)


def checks_by_category(dimension: DataFrame, category: str) -> DataFrame:
    return dimension.filter(F.col("category") == category)


def prohibited_services(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One row per (service, domain); ``ord`` keeps the match order of the file."""
    if path:
        # one JSON document is read by one task, so the id follows its order
        services = _json(spark, path, schemas.PROHIBITED_SERVICES).withColumn(
            "service_ord", F.monotonically_increasing_id())
    else:
        services = local_table(
            spark, ((i, name, list(domains), fine) for i, (name, _, fine, domains)
                    in enumerate(fixed.PROHIBITED_SERVICES)),
            "service_ord bigint, name string, domains array<string>, fine_reference string")
    return services.select(
        "name", "fine_reference", "service_ord", F.posexplode("domains").alias("domain_ord", "domain")
    ).withColumn("domain", F.lower("domain"))


def prohibited_domains(services: DataFrame) -> DataFrame:
    return services.select("domain").distinct()


def fines(spark: SparkSession, path: str | None = None) -> DataFrame:
    if path:
        return _json(spark, path, schemas.FINES)
    return local_table(spark, (
        (fid, violation, law, low, high, repeat, None)
        for fid, violation, law, low, high, repeat in fixed.FINES), schemas.FINES)


def trackers(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One row per tracker; ``tracker_ord`` keeps the order of the file."""
    if path:
        # one JSON document is read by one task, so the id follows its order
        return _json(spark, path, schemas.TRACKERS).withColumn("tracker_ord", F.monotonically_increasing_id())
    rows = [(i, name, list(domains), list(keywords), foreign)
            for i, (name, domains, keywords, foreign) in enumerate(fixed.TRACKERS)]
    return local_table(
        spark, rows, "tracker_ord int, name string, domains array<string>, keywords array<string>, is_foreign boolean")


def legal_updates(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Known legal updates; a missing file is an empty table."""
    if path is None:
        raw = local_table(spark, (
            (uid, day, effective, source, None, title, None, list(articles), list(documents), [],
             severity, category)
            for uid, day, effective, source, title, severity, category, articles, documents
            in fixed.LEGAL_UPDATES), schemas.LEGAL_UPDATES)
    elif not _exists(spark, path):
        raw = local_table(spark, (), schemas.LEGAL_UPDATES)
    else:
        raw = _json(spark, path, schemas.LEGAL_UPDATES)
    return raw.withColumns({
        "date": F.try_to_date("date"), "effective_date": F.try_to_date("effective_date")})


def watched_sources(spark: SparkSession, path: str) -> DataFrame:
    """Watched pages, one row per URL, from a YAML file or its JSON equivalent.

    The file is configuration written by hand, so it is parsed on the driver.
    """
    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as exc:
            raise RuntimeError("reading YAML needs PyYAML; supply the file as JSON") from exc
        config = yaml.safe_load(text)
    else:
        import json
        config = json.loads(text)
    return sources_from_config(spark, config)


def sources_from_config(spark: SparkSession, config: dict) -> DataFrame:
    rows = []
    for item in config.get("competitors", []):
        for url in item.get("urls", []):
            rows.append((item["id"], item["name"], "competitor", url, None,
                         item.get("js_render", False), item.get("llm_analyze", True), None,
                         [], item.get("watch", [])))
    for item in config.get("npa_sources", []):
        rows.append((item["id"], item["name"], "npa", item["url"], item.get("type", "html_hash"),
                     False, True, item.get("npa_critical", False), item.get("keywords", []), []))
    return local_table(spark, rows, schemas.WATCHED_SOURCES)


def document_types(spark: SparkSession, public_only: bool = False) -> DataFrame:
    rows = [(i, key, title, template, description, key in fixed.PUBLIC_DOCUMENT_TYPES)
            for i, (key, title, template, description) in enumerate(fixed.DOCUMENT_TYPES)]
    table = local_table(
        spark, rows, "type_ord int, doc_type string, title string, template_file string, "
              "description string, is_public boolean")
    return table.filter("is_public") if public_only else table


def templates(spark: SparkSession, folder: str) -> DataFrame:
    """(template_file, template) for every Markdown file of a folder."""
    return spark.read.text(os.path.join(folder, "*.md"), wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("template_file"),
        F.col("value").alias("template"))


def templates_for_types(types: DataFrame, files: DataFrame) -> DataFrame:
    """Template text of every document type, with the stated texts for gaps."""
    missing = tx.fill(fixed.MISSING_TEMPLATE, "template_file")
    return types.join(files, "template_file", "left").withColumn(
        "template", F.coalesce(
            "template", F.when(F.col("template_file").isNotNull(), missing),
            F.lit(fixed.NO_TEMPLATE_TEXT)))
