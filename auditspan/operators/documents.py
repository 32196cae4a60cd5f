"""Organisation documents: packages, template filling, versions, rewrites."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspan import schemas
from auditspan.functions import diffs
from auditspan.knowledge import fixed_values as fixed


def decode_organizations(rows: DataFrame) -> DataFrame:
    """Stored rows: list columns as JSON text, the flag as 0/1."""
    return rows.withColumns({
        **{c: F.from_json(c, "array<string>") for c in schemas.ORGANIZATION_LISTS if c in rows.columns},
        "cross_border": F.coalesce(F.col("cross_border").cast("boolean"), F.lit(False))})


def encode_organizations(orgs: DataFrame) -> DataFrame:
    return orgs.withColumns({
        **{c: F.to_json(c) for c in schemas.ORGANIZATION_LISTS if c in orgs.columns},
        "cross_border": F.coalesce("cross_border", F.lit(False)).cast("int")})


def package(orgs: DataFrame, public_only: bool = False) -> DataFrame:
    """One row per organisation and document type of its package.

    Organisations are dealt out first: a package is many times its organisation, and a file of
    organisations that one task reads would become the work of that task.
    """
    types = [t for t in fixed.DOCUMENT_TYPES if not public_only or t[0] in fixed.PUBLIC_DOCUMENT_TYPES]
    rows = F.array(*[F.struct(
        F.lit(i).alias("type_ord"), F.lit(key).alias("doc_type"), F.lit(title).alias("title"),
        F.lit(template).cast("string").alias("template_file")) for i, (key, title, template, _) in enumerate(types)])
    return orgs.repartition("id").select("*", F.explode(rows).alias("_t")).select(*orgs.columns, "_t.*")


def generation_inputs(orgs: DataFrame, templates: DataFrame, contexts: DataFrame,
                      public_only: bool = False) -> DataFrame:
    """Package rows with their template and legal context."""
    return (
        package(orgs, public_only)
        .join(templates.select("doc_type", "template"), "doc_type", "left")
        .join(contexts, "doc_type", "left")
        .withColumns({"template": F.coalesce("template", F.lit(fixed.NO_TEMPLATE_TEXT)),
                      "legal_context": F.coalesce("legal_context", F.lit(""))}))


def _filled(name: str, *fallbacks: Column) -> Column:
    value = F.when(F.coalesce(F.col(name), F.lit("")) != "", F.col(name))
    return F.coalesce(value, *fallbacks)


def _listed(name: str, empty: str) -> Column:
    return F.when(F.coalesce(F.size(name), F.lit(0)) > 0, F.array_join(name, ", ")).otherwise(F.lit(empty))


def placeholder_values(day: Column) -> dict[str, Column]:
    """Value of every known placeholder, with its default."""
    need = F.lit(fixed.REQUIRED_MARK)
    abroad = F.coalesce("cross_border", F.lit(False))
    named = F.coalesce(F.size("cross_border_countries"), F.lit(0)) > 0
    transfer = (
        F.when(abroad & named, F.concat(F.lit(fixed.CROSS_BORDER_LISTED), F.array_join("cross_border_countries", ", ")))
        .when(abroad, F.lit(fixed.CROSS_BORDER_UNLISTED)).otherwise(F.lit(fixed.CROSS_BORDER_NONE)))
    legal_address = _filled("legal_address")
    return {
        "LEGAL_NAME": F.coalesce("legal_name", need), "SHORT_NAME": _filled("short_name", F.col("legal_name"), need),
        "INN": _filled("inn", need), "OGRN": _filled("ogrn", need),
        "LEGAL_ADDRESS": F.coalesce(legal_address, need),
        "ACTUAL_ADDRESS": _filled("actual_address", legal_address, need),
        "CEO_NAME": _filled("ceo_name", need), "CEO_POSITION": F.coalesce("ceo_position", F.lit("Генеральный директор")),
        "RESPONSIBLE_PERSON": _filled("responsible_person", need),
        "RESPONSIBLE_CONTACT": _filled("responsible_contact", _filled("email"), need),
        "WEBSITE_URL": F.coalesce("website_url", need), "EMAIL": _filled("email", need), "PHONE": _filled("phone", need),
        "DATA_CATEGORIES": _listed("data_categories", fixed.REQUIRED_MARK),
        "PROCESSING_PURPOSES": _listed("processing_purposes", fixed.REQUIRED_MARK),
        "DATA_SUBJECTS": _listed("data_subjects", fixed.REQUIRED_MARK),
        "THIRD_PARTIES": _listed("third_parties", fixed.NO_THIRD_PARTIES),
        "CROSS_BORDER_INFO": transfer,
        "HOSTING_LOCATION": F.coalesce("hosting_location", F.lit("Российская Федерация")),
        "INFO_SYSTEMS": _listed("info_systems", fixed.REQUIRED_MARK),
        "PUBLICATION_DATE": day, "UPDATE_DATE": day, "RETENTION_PERIODS": need,
    }


def fill_template(template: Column, day: Column) -> Column:
    """Template with the known placeholders filled; others stay as they are."""
    text = template
    for name, value in placeholder_values(day).items():
        text = F.replace(text, F.lit("{{" + name + "}}"), value)
    return F.concat(F.lit(fixed.TEMPLATE_DISCLAIMER), text)


def latest_versions(documents: DataFrame) -> DataFrame:
    """Current version of every document: an aggregate, not a window."""
    row = F.struct(*[F.col(c) for c in documents.columns])
    return documents.groupBy("organization_id", "doc_type").agg(
        F.max_by(row, F.struct("version", "created_at", "id")).alias("d")).select("d.*")


def number_versions(documents: DataFrame) -> DataFrame:
    """Versions by creation time, each with the text it replaced."""
    w = Window.partitionBy("organization_id", "doc_type").orderBy("created_at", "id")
    return documents.withColumns({
        "version": F.row_number().over(w), "previous_content": F.lag("content_md").over(w)})


def rewrite_results(affected: DataFrame, contents: DataFrame, mode: str = "confirm", diff: bool = True) -> DataFrame:
    """Outcome of a rewrite for every affected document.

    ``contents`` holds the supplied new texts (organization_id, doc_type,
    update_id, new_content, error).
    """
    keys = ["organization_id", "doc_type", "update_id"]
    joined = affected.join(contents.select(*keys, "new_content", "error"), keys, "left")
    empty = F.coalesce("content_md", F.lit("")) == ""
    failed = F.col("error").isNotNull() | F.col("new_content").isNull()
    status = (F.when(empty, F.lit("skipped")).when(failed, F.lit("error"))
              .otherwise(F.lit("updated" if mode == "auto" else "draft")))
    done = ~empty & ~failed
    made = joined.withColumn("status", status)
    if diff:
        made = made.withColumns({"_old": F.when(done, F.col("content_md")), "_new": F.when(done, F.col("new_content"))})
        made = diffs.with_document_diff(made, "_old", "_new")
    return made.select(
        *keys, "update_title", F.coalesce("title", "doc_type").alias("doc_title"), "status",
        F.when(empty, F.lit(fixed.EMPTY_DOCUMENT)).alias("reason"),
        F.when(~empty & failed, F.coalesce("error", F.lit("no new content"))).alias("error"),
        F.when(done, F.col("version")).alias("old_version"),
        F.when(done, F.col("version") + 1).alias("new_version"),
        F.when(done, F.col("new_content")).alias("content_md"),
        *(["diff"] if diff else []))


def organization_documents(orgs: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents of every organisation, ordered by type."""
    return orgs.select(F.col("id").alias("organization_id"), "legal_name").join(
        documents, "organization_id").orderBy("organization_id", "doc_type")


def organization_reports(orgs: DataFrame, reports: DataFrame) -> DataFrame:
    return orgs.select(F.col("id").alias("organization_id"), "legal_name").join(reports, "organization_id")
