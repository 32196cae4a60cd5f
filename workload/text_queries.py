"""Text operators over ``documents``: script share, flags, replies, preambles."""
from __future__ import annotations

from pyspark.sql import functions as F

from auditspan.functions import replies
from auditspan.functions import text as tx
from workload.audit_queries import cyrillic
from workload.crawl_table import lit
from workload.registry import query, table

# English pack of the content flags: another language is another table.
POLICY_FLAGS_EN = (
    ("POLICY_003", "has_operator_name", "raw", (r"(LLC|Inc\.|Ltd|License)",)),
    ("POLICY_005", "has_contact", "lower", (r"(contact|mail|phone)", r"([a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}|\d{3})")),
    ("POLICY_007", "has_purposes", "lower", (r"(of.{0,20}the|purpose)",)),
    ("POLICY_016", "has_date", "lower", (r"(\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4})",)),
)

MIXED = ("CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN repeat('Политика данных. ', CAST(1 + n_chars % 60 AS INT)) "
         "WHEN 2 THEN repeat('данные и ', CAST(n_chars / 10 AS INT)) || text WHEN 3 THEN '' "
         "ELSE repeat('Обработка ', 60) || text END")


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("P10_cyrillic_share", f"SELECT doc_id, {cyrillic('t')} AS is_russian FROM (SELECT doc_id, {MIXED.replace('n_chars / 10', 'n_chars // 10')} AS t FROM documents)")
def p10(spark, sf):
    return docs(spark, sf).select("doc_id", F.expr(MIXED.replace("n_chars / 10", "n_chars div 10")).alias("t")).select(
        "doc_id", tx.is_cyrillic_text(F.col("t")).alias("is_russian"))


@query("P11_valid_policy_text", f"""SELECT doc_id, t IS NULL OR (length(t) >= 500 AND {cyrillic('t')}) AS valid
FROM (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN {MIXED.replace('n_chars / 10', 'n_chars // 10')} END AS t FROM documents)""")
def p11(spark, sf):
    t = F.when(F.col("doc_id") % 7 != 0, F.expr(MIXED.replace("n_chars / 10", "n_chars div 10")))
    return docs(spark, sf).select("doc_id", t.alias("t")).select(
        "doc_id", tx.is_valid_policy_text(F.col("t"), tx.is_cyrillic_text(F.col("t"))).alias("valid"))


@query("P12_flags_other_language", "SELECT doc_id, " + ", ".join(
    "(" + " AND ".join(f"regexp_matches({'text' if form == 'raw' else 'lower(text)'}, {lit(p)})" for p in patterns) + f") AS {name}"
    for _, name, form, patterns in POLICY_FLAGS_EN) + " FROM documents")
def p12_en(spark, sf):
    flags = tx.content_flags(F.col("text"), POLICY_FLAGS_EN)
    return docs(spark, sf).select("doc_id", *[c.alias(n) for n, c in flags.items()])


@query("P13_text_provenance", """SELECT doc_id, sha256(text) AS text_hash, length(text) AS content_length,
  length(text) AS stored, FALSE AS text_truncated FROM documents""")
def p13(spark, sf):
    p = tx.provenance(F.col("text"))
    return docs(spark, sf).select(
        "doc_id", p["text_hash"].alias("text_hash"), p["content_length"].alias("content_length"),
        F.length(p["stored_text"]).alias("stored"), p["text_truncated"].alias("text_truncated"))


@query("P16_item_count", r"""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '\S'))) AS items FROM documents""")
def p16(spark, sf):
    return docs(spark, sf).select("doc_id", tx.count_items(F.col("text")).cast("bigint").alias("items"))


PREAMBLE = ("CASE doc_id % 3 WHEN 0 THEN 'Here is the answer:' || chr(10) || 'Вывод: ' || text "
            "WHEN 1 THEN 'Итог' || chr(10) || text ELSE 'No ' || replace(text, chr(10), ' ') END")


@query("X17_strip_preamble", f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Вывод: ' || text
  WHEN 1 THEN 'Итог' || chr(10) || text ELSE '' END AS kept FROM documents""")
def x17(spark, sf):
    return docs(spark, sf).select("doc_id", F.expr(PREAMBLE).alias("t")).select(
        "doc_id", tx.strip_preamble(F.col("t")).alias("kept"))


# -- model replies ------------------------------------------------------------

_BODY = ("'{\"summary\": \"Изменение ' || CAST(doc_id AS STRING) || '\", \"change_type\": \"' || "
         "CASE doc_id % 4 WHEN 0 THEN 'pricing' WHEN 1 THEN 'npa' WHEN 2 THEN 'other' ELSE 'minor' END || '\", \"threat_score\": ' || "
         "CASE doc_id % 5 WHEN 0 THEN '9' WHEN 1 THEN '2' WHEN 2 THEN '\"4\"' WHEN 3 THEN '\"high\"' ELSE '-1' END || "
         "', \"action_required\": ' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || ', \"action\": \"do\"}'")
REPLY = (f"CASE doc_id % 6 WHEN 0 THEN {_BODY} WHEN 1 THEN '```json' || chr(10) || {_BODY} || chr(10) || '```' "
         f"WHEN 2 THEN 'Вот ответ: ' || {_BODY} || ' конец' WHEN 3 THEN 'нет данных' WHEN 4 THEN '[]' ELSE {_BODY} || chr(10) END")


def reply_table(spark, sf):
    return docs(spark, sf).select("doc_id", F.expr(REPLY).alias("reply"))


@query("X13_json_from_reply", f"""SELECT doc_id, CASE doc_id % 6 WHEN 3 THEN NULL WHEN 4 THEN '[]' ELSE {_BODY} END AS json FROM documents""")
def x13(spark, sf):
    return replies.with_json(reply_table(spark, sf)).select("doc_id", F.trim(F.rtrim("json")).alias("json")).withColumn(
        "json", F.regexp_replace("json", r"\s+\z", ""))


def _analysis_sql(types, default):
    allowed = ", ".join(lit(t) for t in types)
    return f"""SELECT doc_id, 'Изменение ' || doc_id AS summary, CASE WHEN k IN ({allowed}) THEN k ELSE '{default}' END AS change_type,
  CAST(CASE doc_id % 5 WHEN 0 THEN 5 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 3 ELSE 1 END AS INT) AS threat_score,
  doc_id % 2 = 0 AS action_required, 'do' AS action
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pricing' WHEN 1 THEN 'npa' WHEN 2 THEN 'other' ELSE 'minor' END AS k FROM documents)
WHERE doc_id % 6 NOT IN (3, 4)"""


def _analysis(spark, sf, legal):
    parsed = replies.with_json(reply_table(spark, sf)).select("doc_id", replies.analysis(F.col("doc"), legal).alias("a"))
    return parsed.filter("a IS NOT NULL").select("doc_id", "a.*")


@query("X14_change_analysis", _analysis_sql(("feature", "pricing", "ui", "npa", "minor"), "ui"))
def x14(spark, sf):
    return _analysis(spark, sf, False)


@query("X15_legal_analysis", _analysis_sql(("npa", "minor"), "npa"))
def x15(spark, sf):
    return _analysis(spark, sf, True)


_ITEM = ("'{\"id\": \"' || {id} || '\", \"date\": \"2025-07-01\", \"effective_date\": \"2025-09-01\", \"source\": \"S' || "
         "CAST(doc_id % 3 AS STRING) || '\", \"title\": \"' || {title} || '\", \"summary\": \"x\", \"articles\": [], "
         "\"affected_documents\": [\"privacy_policy\"], \"requirements\": [], \"severity\": \"high\", \"category\": \"law\"}'")
_ONE = _ITEM.replace("{id}", "CASE WHEN doc_id % 2 = 0 THEN 'LU-' || CAST(doc_id AS STRING) ELSE '' END").replace(
    "{title}", "CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'T' || CAST(doc_id % 50 AS STRING) END")
_TWO = _ITEM.replace("{id}", "'LV-' || CAST(doc_id AS STRING)").replace("{title}", "'U' || CAST(doc_id AS STRING)")
UPDATES_REPLY = (f"CASE doc_id % 4 WHEN 0 THEN '[' || {_ONE} || ', ' || {_TWO} || ']' WHEN 1 THEN 'Найдено: [' || {_ONE} || '] всё' "
                 f"WHEN 2 THEN '[]' ELSE '```' || chr(10) || '[' || {_TWO} || ']' || chr(10) || '```' END")

UPDATES_CTE = """ones AS (SELECT doc_id, 0 AS item_ord, CASE WHEN doc_id % 2 = 0 THEN 'LU-' || doc_id END AS given,
    'S' || doc_id % 3 AS source, 'T' || doc_id % 50 AS title FROM documents WHERE doc_id % 4 IN (0, 1) AND doc_id % 7 <> 0),
  twos AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS item_ord, 'LV-' || doc_id AS given,
    'S' || doc_id % 3 AS source, 'U' || doc_id AS title FROM documents WHERE doc_id % 4 IN (0, 3)),
  updates AS (SELECT *, md5(source || ':' || title) AS content_key FROM (SELECT * FROM ones UNION ALL SELECT * FROM twos))"""


def found_updates(spark, sf):
    table_ = docs(spark, sf).select("doc_id", F.expr(UPDATES_REPLY).alias("reply"))
    return replies.update_rows(table_, F.lit(2025))


@query("X16_updates_from_replies", f"""WITH {UPDATES_CTE}
SELECT doc_id, item_ord, coalesce(given, 'LU-2025-' || upper(left(content_key, 3))) AS id, source, title, content_key FROM updates""")
def x16(spark, sf):
    return found_updates(spark, sf).select("doc_id", "item_ord", "id", "source", "title", "content_key")
