"""Model replies as table rows: JSON found in text, and normalised analyses."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspan.functions import text as tx
from auditspan.knowledge import fixed_values as fixed

UPDATE = ("array<struct<id:string,date:string,effective_date:string,source:string,source_url:string,title:string,"
          "summary:string,articles:array<string>,affected_documents:array<string>,requirements:array<string>,"
          "severity:string,category:string>>")


def unfenced(reply: Column) -> Column:
    """Reply without a surrounding Markdown code fence."""
    text = tx.strip(reply)
    body = F.regexp_replace(F.regexp_replace(text, r"(?s)\A```[^\n]*(\n|\z)", ""), r"```\z", "")
    return F.when(text.startswith("```"), tx.strip(body)).otherwise(text)


def _candidates(body: Column) -> list[Column]:
    """The whole text, else the outermost ``[...]``, else the outermost ``{...}``."""
    return [body, F.regexp_extract(body, r"(?s)(\[.*\])", 1), F.regexp_extract(body, r"(?s)(\{.*\})", 1)]


def with_json(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds ``json`` (text) and ``doc`` (variant): the JSON document of a reply.

    Both are NULL when nothing in the reply parses.  The candidates are tried in
    one array expression: nested conditionals would be copied into every filter
    on a derived column and outgrow generated code.
    """
    bodies = replies.withColumn("_body", unfenced(F.col(reply)))
    texts = F.filter(F.array(*_candidates(F.col("_body"))), lambda t: t != "")
    tries = F.transform(texts, lambda t: F.struct(F.try_parse_json(t).alias("doc"), t.alias("json")))
    found = bodies.withColumn("_hit", F.get(F.filter(
        tries, lambda t: t.getField("doc").isNotNull()), F.lit(0)))
    return found.select(*replies.columns, F.col("_hit.json").alias("json"), F.col("_hit.doc").alias("doc"))


def _get(doc: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(doc, f"$.{name}", kind)


def _kind_of(doc: Column, name: str) -> Column:
    return F.schema_of_variant(_get(doc, name, "variant"))


def analysis(doc: Column, legal: bool = False) -> Column:
    """Normalised change analysis; NULL when the reply is not a JSON object."""
    allowed, default = ((fixed.LEGAL_CHANGE_TYPES, "npa") if legal else (fixed.CHANGE_TYPES, "ui"))
    kind = _get(doc, "change_type", "string")
    score_text = F.trim(_get(doc, "threat_score", "string"))
    # a number is truncated; a text counts only when it is a whole number
    whole = F.when(
        (_kind_of(doc, "threat_score") != "STRING") | score_text.rlike(r"^[+-]?[0-9]+$"),
        score_text.try_cast("double").try_cast("bigint"))
    score = F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(whole, F.lit(3)))).cast("int")
    required = F.when(
        _kind_of(doc, "action_required") == "STRING", _get(doc, "action_required", "string") != ""
    ).otherwise(_get(doc, "action_required", "boolean"))
    is_object = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, F.struct(
        F.coalesce(_get(doc, "summary", "string"), F.lit("")).alias("summary"),
        F.when(kind.isin(*allowed), kind).otherwise(F.lit(default)).alias("change_type"),
        score.alias("threat_score"),
        F.coalesce(required, F.lit(False)).alias("action_required"),
        F.coalesce(_get(doc, "action", "string"), F.lit("")).alias("action")))


def update_rows(replies: DataFrame, year: Column, reply: str = "reply") -> DataFrame:
    """Legal updates named in replies: one row per array item that has a title.

    A missing id is filled from the year and the content key, so a rerun gives
    the same id.  Items without the mandatory fields are dropped.
    """
    items = with_json(replies, reply).select(
        *replies.columns, F.posexplode(F.from_json("json", UPDATE)).alias("item_ord", "u"))
    rows = items.select(*replies.columns, "item_ord", "u.*").filter(F.coalesce("title", F.lit("")) != "")
    key = content_key(F.col("source"), F.col("title"))
    made = F.concat(F.lit("LU-"), year.cast("string"), F.lit("-"), F.upper(F.substring(key, 1, 3)))
    known = F.when(F.coalesce("id", F.lit("")) != "", F.col("id"))
    mandatory = ("date", "effective_date", "source", "summary")
    complete = F.lit(True)
    for name in mandatory:
        complete = complete & F.col(name).isNotNull()
    return rows.filter(complete).withColumns({
        "content_key": key, "id": F.coalesce(known, made),
        "severity": F.coalesce("severity", F.lit("medium")), "category": F.coalesce("category", F.lit(""))})


def content_key(source: Column, title: Column) -> Column:
    """Identity of an update: md5 of ``source:title``."""
    return F.md5(F.concat(F.coalesce(source, F.lit("")), F.lit(":"), F.coalesce(title, F.lit(""))))
