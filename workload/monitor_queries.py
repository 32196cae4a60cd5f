"""Change monitoring over a snapshot history derived from ``events``."""
from __future__ import annotations

from pyspark.sql import functions as F

from auditspan.functions import diffs
from auditspan.knowledge import fixed_values as fixed
from auditspan.operators import digest, monitoring
from auditspan.session import cut_lineage
from auditspan.sinks import tables
from auditspan.localtable import local_table
from workload.audit_queries import contains_any
from workload.crawl_table import lit, values
from workload.diff_sql import diff_cte
from workload.registry import plan_once, query, table

SNAP_SELECT = """
SELECT event_id AS id, 'src' || CAST(user_id % 12 AS STRING) AS source_id, 'https://watched.example.org/' || CAST(user_id % 3 AS STRING) AS url,
  CASE WHEN event_type = 'error' THEN 'blocked' ELSE 'ok' END AS fetch_status,
  CASE WHEN k % 7 = 4 THEN '' ELSE 'Главная' || chr(10) || CASE WHEN k % 4 < 2 THEN 'Блок А' || chr(10) || 'Блок Б' ELSE 'Блок Б' || chr(10) || 'Блок А' END ||
    chr(10) || repeat('---' || chr(10), 1 + k % 3) || CASE k % 6 WHEN 0 THEN 'цена 100 руб' WHEN 1 THEN 'новая функция проверки'
    WHEN 2 THEN 'новый дизайн' WHEN 3 THEN 'контакты' WHEN 4 THEN 'почта' ELSE 'штраф: закон' END || chr(10) || 'первая строка' || chr(10) || 'вторая строка' ||
    chr(10) || 'третья строка' || chr(10) || CASE WHEN user_id % 2 = 0 THEN 'тарифы' ELSE 'адреса' END || chr(10) || 'прочее' || chr(10) || 'v' || CAST(k % 2 AS STRING) ||
    chr(10) || 'конец' || chr(10) || 'внизу' || chr(10) || 'добавили закон' END AS text,
  ts AS captured_at
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM {events}) AS e
"""
SNAP_CTE = f"""fetches AS ({SNAP_SELECT.replace('{events}', 'events')}),
snapshots AS (SELECT id, source_id, url, fetch_status, captured_at, CASE WHEN fetch_status = 'ok' THEN text ELSE '' END AS raw_text,
  CASE WHEN fetch_status = 'ok' THEN sha256(text) ELSE '' END AS content_hash FROM fetches),
history AS (SELECT *, lag(content_hash) OVER w AS previous_hash, lag(raw_text) OVER w AS previous_text,
  row_number() OVER w > 1 AS has_previous FROM snapshots WINDOW w AS (PARTITION BY source_id, url ORDER BY captured_at, id)),
changed AS (SELECT * EXCLUDE (previous_text), coalesce(previous_text, '') AS previous_text, string_split(previous_text, chr(10)) AS a, string_split(raw_text, chr(10)) AS b FROM history
  WHERE fetch_status = 'ok' AND has_previous AND content_hash <> previous_hash),
lined AS (SELECT *, list_filter(a, lambda x: NOT list_contains(b, x)) AS removed,
  list_filter(b, lambda x: NOT list_contains(a, x)) AS added FROM changed),
{diff_cte('changed', 'id', 'previous_text', 'raw_text', 2)},
diffed AS (SELECT l.*, x.diff, lower(x.diff) AS d FROM lined l JOIN diffs x ON x.key = l.id)"""
CLASS_SQL = f"""CASE WHEN NOT {contains_any('d', fixed.MEANINGFUL_STEMS)} THEN 'minor' WHEN {contains_any('d', fixed.PRICING_STEMS)} THEN 'pricing'
  WHEN {contains_any('d', fixed.FEATURE_STEMS)} THEN 'feature' ELSE 'ui' END"""

SOURCES = [(f"src{i}", None if i == 11 else f"Источник {i}", i % 4 != 3, i % 2 == 0, ["контакт"] if i % 5 == 0 else [])
           for i in range(12)]
SOURCES_CTE = values("sources", "source_id, name, llm_analyze, npa_critical, own_word", [
    (sid, name, llm, critical, words[0] if words else None) for sid, name, llm, critical, words in SOURCES])


def sources(spark):
    return local_table(spark, SOURCES, "source_id string, name string, llm_analyze boolean, npa_critical boolean, keywords array<string>")


def snapshots(spark, sf):
    fetches = spark.sql(SNAP_SELECT, events=table(spark, sf, "events"))
    return monitoring.snapshot_rows(fetches)


@plan_once
def history(spark, sf):
    return monitoring.snapshot_history(snapshots(spark, sf))


def changed(spark, sf):
    return monitoring.changed_snapshots(history(spark, sf), snapshots(spark, sf))


@query("K5_snapshot_rows", f"WITH RECURSIVE {SNAP_CTE} SELECT id, source_id, url, content_hash, raw_text, fetch_status FROM snapshots")
def k5(spark, sf):
    path = tables.scratch_path(spark, "stored-snapshots")
    for part in (0, 1):  # two runs append to one table
        tables.append_snapshots(snapshots(spark, sf).filter(F.col("id") % 2 == part), path)
    return spark.read.parquet(path).drop("captured_at", "day")


@query("W1_previous_snapshot", f"""WITH RECURSIVE {SNAP_CTE} SELECT id, source_id, url, has_previous, lag(id) OVER (PARTITION BY source_id, url ORDER BY captured_at, id) AS previous_id, previous_hash, previous_text FROM history""")
def w1(spark, sf):
    rows = monitoring.with_texts(history(spark, sf), snapshots(spark, sf))
    return rows.select("id", "source_id", "url", "has_previous", "previous_id", "previous_hash", "previous_text")


@query("W1_previous_good_snapshot", f"""WITH RECURSIVE {SNAP_CTE}
SELECT id, lag(content_hash) OVER (PARTITION BY source_id, url ORDER BY captured_at, id) AS previous_hash
FROM snapshots WHERE fetch_status = 'ok'""")
def w1_good(spark, sf):
    return monitoring.last_good_baseline(snapshots(spark, sf)).select("id", "previous_hash")


@query("W2_parse_warnings", f"""WITH RECURSIVE {SNAP_CTE},
n AS (SELECT *, CASE WHEN fetch_status = 'ok' THEN len(list_filter(string_split(raw_text, chr(10)), lambda x: trim(x) <> '')) ELSE 0 END AS items,
  CASE WHEN fetch_status = 'ok' THEN len(list_filter(string_split(raw_text, chr(10)), lambda x: trim(x) <> '')) END AS good FROM snapshots),
l AS (SELECT *, lag(good, 1 IGNORE NULLS) OVER w AS g1, lag(good, 2 IGNORE NULLS) OVER w AS g2, lag(good, 3 IGNORE NULLS) OVER w AS g3
  FROM n WINDOW w AS (PARTITION BY source_id, url ORDER BY captured_at, id))
SELECT id, source_id, url, fetch_status FROM l WHERE items = 0 AND g1 > 0 AND g2 > 0 AND g3 > 0""")
def w2(spark, sf):
    return monitoring.parse_warnings(history(spark, sf)).drop("captured_at")


@query("D1_line_diff", f"""WITH RECURSIVE {SNAP_CTE}
SELECT id, array_to_string(list_sort(list_distinct(removed)), '|') AS removed, array_to_string(list_sort(list_distinct(added)), '|') AS added FROM lined""")
def d1(spark, sf):
    lines = diffs.changed_lines(F.col("previous_text"), F.col("raw_text"))
    return changed(spark, sf).select("id", lines.alias("l")).select(
        "id", F.array_join(F.array_sort("l.removed"), "|").alias("removed"),
        F.array_join(F.array_sort("l.added"), "|").alias("added"))


@query("D1_unified_diff", f"WITH RECURSIVE {SNAP_CTE} SELECT id, diff FROM diffed")
def d1_full(spark, sf):
    return monitoring.with_diff(changed(spark, sf)).select("id", "diff")


@query("D3_change_class", f"""WITH RECURSIVE {SNAP_CTE} SELECT id, {contains_any('d', fixed.MEANINGFUL_STEMS)} AS meaningful, {CLASS_SQL} AS change_type FROM diffed""")
def d3(spark, sf):
    return monitoring.with_diff(changed(spark, sf)).select(
        "id", diffs.is_meaningful(F.col("diff")).alias("meaningful"), diffs.change_class(F.col("diff")).alias("change_type"))


@query("D4_snapshot_route", f"""WITH RECURSIVE {SNAP_CTE}
SELECT id, CASE WHEN fetch_status <> 'ok' THEN 'failed' WHEN NOT has_previous THEN 'baseline'
  WHEN content_hash = previous_hash THEN 'unchanged' ELSE 'changed' END AS route FROM history""")
def d4(spark, sf):
    h = history(spark, sf)
    return h.select("id", monitoring.route(h).alias("route"))


@query("D4_change_queue", f"""WITH RECURSIVE {SNAP_CTE}, {SOURCES_CTE}, c AS (SELECT *, {CLASS_SQL} AS change_type FROM diffed)
SELECT id, change_type, CASE WHEN change_type <> 'minor' AND coalesce(llm_analyze, TRUE) THEN 'analyse' ELSE 'save' END AS route
FROM c LEFT JOIN sources USING (source_id)""")
def d4_queue(spark, sf):
    return queue(spark, sf).select("id", "change_type", "route")


def queue(spark, sf):
    return monitoring.competitor_changes(monitoring.with_diff(changed(spark, sf)), sources(spark))


ANALYSIS_SELECT = """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'ошибка'
  ELSE '{"summary": "Итог ' || CAST(event_id AS STRING) || '", "change_type": "' || CASE event_id % 3 WHEN 0 THEN 'feature' WHEN 1 THEN 'npa' ELSE 'minor' END ||
    '", "threat_score": ' || CAST(event_id % 7 AS STRING) || ', "action_required": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ', "action": "проверить"}' END AS reply
FROM """


def analyses(spark, sf):
    # the braces of the JSON text rule out spark.sql's DataFrame arguments here
    expr = ANALYSIS_SELECT[ANALYSIS_SELECT.index("CASE"):ANALYSIS_SELECT.index(" AS reply")]
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.expr(expr).alias("reply"))


PARSED_CTE = """parsed AS (SELECT event_id AS id, 'Итог ' || event_id AS summary,
  CASE event_id % 3 WHEN 0 THEN 'feature' WHEN 1 THEN 'npa' ELSE 'minor' END AS kind,
  CAST(greatest(1, least(5, event_id % 7)) AS INT) AS score, event_id % 2 = 0 AS act FROM events WHERE event_id % 5 <> 0)"""
COMPETITOR_CTE = f"""{SNAP_CTE}, {SOURCES_CTE}, {PARSED_CTE},
queue AS (SELECT c.*, change_type <> 'minor' AND coalesce(llm_analyze, TRUE) AS queued
  FROM (SELECT *, {CLASS_SQL} AS change_type FROM diffed) c LEFT JOIN sources USING (source_id)),
competitor AS (SELECT q.id, q.source_id, q.url, CASE WHEN queued THEN summary END AS diff_summary,
  CASE WHEN queued AND kind IS NOT NULL THEN kind ELSE change_type END AS change_type, CASE WHEN queued THEN score END AS threat_score,
  CAST(NULL AS BOOLEAN) AS npa_critical, captured_at AS detected_at, queued AND kind IS NOT NULL AS analysed FROM queue q LEFT JOIN parsed USING (id))"""


def competitor(spark, sf):
    return monitoring.merge_analyses(queue(spark, sf), analyses(spark, sf))


@query("D6_merge_analyses", f"""WITH RECURSIVE {COMPETITOR_CTE} SELECT id, source_id, url, diff_summary, change_type, threat_score, analysed FROM competitor""")
def d6(spark, sf):
    return competitor(spark, sf).drop("npa_critical", "detected_at")


@query("K6_change_rows_per_source", f"""WITH RECURSIVE {COMPETITOR_CTE}
SELECT source_id, change_type, count(*) AS changes, count_if(analysed) AS analysed, max(threat_score) AS max_score FROM competitor GROUP BY ALL""")
def k6(spark, sf):
    path = tables.scratch_path(spark, "stored-changes")
    tables.append_changes(competitor(spark, sf), path)
    return spark.read.parquet(path).groupBy("source_id", "change_type").agg(
        F.count("*").alias("changes"), F.count_if("analysed").alias("analysed"), F.max("threat_score").alias("max_score"))


MEANING_SQL = f"({contains_any('d', fixed.LEGAL_STEMS)} OR coalesce(contains(d, lower(own_word)), FALSE))"
LEGAL_CTE = f"""{SNAP_CTE}, {SOURCES_CTE}, {PARSED_CTE},
legal AS (SELECT d.id, d.source_id, d.url, coalesce(name, d.source_id) AS source_name, CASE WHEN m THEN summary END AS diff_summary,
  CASE WHEN NOT m THEN 'minor' WHEN kind IS NULL THEN 'npa' WHEN kind IN ('npa', 'minor') THEN kind ELSE 'npa' END AS change_type,
  CASE WHEN m THEN score END AS threat_score, CASE WHEN m AND kind IS NOT NULL THEN npa_critical END AS npa_critical,
  CASE WHEN m THEN act END AS action_required, CASE WHEN m AND kind IS NOT NULL THEN 'проверить' END AS action, captured_at AS detected_at
  FROM (SELECT x.*, name, npa_critical, {MEANING_SQL} AS m FROM diffed x LEFT JOIN sources USING (source_id)) d LEFT JOIN parsed USING (id))"""


def legal(spark, sf):
    return monitoring.legal_changes(
        monitoring.with_diff(changed(spark, sf)), sources(spark), analyses(spark, sf))


@query("J7_keyword_filter", f"""WITH RECURSIVE {SNAP_CTE}, {SOURCES_CTE} SELECT id, {MEANING_SQL} AS meaningful FROM diffed LEFT JOIN sources USING (source_id)""")
def j7(spark, sf):
    joined = monitoring.with_diff(changed(spark, sf)).join(sources(spark), "source_id", "left")
    return joined.select("id", diffs.is_legally_meaningful(F.col("diff"), F.col("keywords")).alias("meaningful"))


@query("J8_source_names", f"""WITH RECURSIVE {SNAP_CTE}, {SOURCES_CTE} SELECT id, coalesce(name, source_id) AS source_name FROM changed LEFT JOIN sources USING (source_id)""")
def j8(spark, sf):
    return monitoring.with_source_names(changed(spark, sf), sources(spark)).select("id", "source_name")


@query("D5_legal_changes", f"""WITH RECURSIVE {LEGAL_CTE} SELECT id, source_id, source_name, diff_summary, change_type, threat_score, npa_critical, action_required FROM legal""")
def d5(spark, sf):
    return legal(spark, sf).select(
        "id", "source_id", "source_name", "diff_summary", "change_type", "threat_score", "npa_critical", "action_required")


ALERT_SQL = f"""'⚠️ *НПА — критическое изменение*' || chr(10) || chr(10) || '*Источник:* ' || source_name || chr(10) || '*Уровень угрозы:* ' ||
  CASE threat_score {' '.join(f"WHEN {k} THEN {lit(v)}" for k, v in fixed.THREAT_LABELS)} END || chr(10) || '*URL:* ' || url || chr(10) || chr(10) ||
  '*Изменение:*' || chr(10) || diff_summary || CASE WHEN action_required THEN chr(10) || chr(10) || '*Требуемые действия:*' || chr(10) || action ELSE '' END"""


@query("D8_K11_critical_alerts", f"""WITH RECURSIVE {LEGAL_CTE} SELECT id, {ALERT_SQL} AS message FROM legal WHERE npa_critical AND threat_score IS NOT NULL""")
def d8(spark, sf):
    return monitoring.critical_alerts(legal(spark, sf)).select("id", digest.alert_text().alias("message"))


@query("D8_truncate_message", f"""SELECT doc_id, CASE WHEN length(text) <= 4000 THEN text
  ELSE left(text, 4000 - {len(fixed.MESSAGE_CUT_SUFFIX)}) || chr(10) || chr(10) || {lit(fixed.MESSAGE_CUT_SUFFIX.strip())} END AS message FROM documents""")
def d8_cut(spark, sf):
    return table(spark, sf, "documents").select("doc_id", digest.truncate_message(F.col("text")).alias("message"))


# -- pending changes and the digest -------------------------------------------

ALL_CHANGES_CTE = f"""{COMPETITOR_CTE},
legal AS (SELECT d.id, d.source_id, d.url, CASE WHEN m THEN summary END AS diff_summary,
  CASE WHEN NOT m THEN 'minor' WHEN kind IS NULL THEN 'npa' WHEN kind IN ('npa', 'minor') THEN kind ELSE 'npa' END AS change_type,
  CASE WHEN m THEN score END AS threat_score, CASE WHEN m AND kind IS NOT NULL THEN npa_critical END AS npa_critical, captured_at AS detected_at
  FROM (SELECT x.*, npa_critical, {MEANING_SQL} AS m FROM diffed x LEFT JOIN sources USING (source_id)) d LEFT JOIN parsed USING (id)),
changes AS (SELECT id, source_id, url, diff_summary, change_type, threat_score, npa_critical, detected_at FROM competitor WHERE source_id NOT IN ('src0', 'src1', 'src2')
  UNION ALL SELECT * FROM legal WHERE source_id IN ('src0', 'src1', 'src2')),
digested AS (SELECT id FROM changes WHERE id % 4 = 1),
pending AS (SELECT * FROM changes WHERE id NOT IN (SELECT id FROM digested) ORDER BY threat_score DESC NULLS LAST, detected_at DESC, id LIMIT 100)"""
LEGAL_SOURCES = ("src0", "src1", "src2")
IS_LEGAL_SQL = "coalesce(change_type = 'npa' OR coalesce(npa_critical, FALSE), FALSE)"


def all_changes(spark, sf):
    """Competitor and legal changes from one pass over the history."""
    diffed = monitoring.changed_diffs(history(spark, sf), snapshots(spark, sf))
    is_legal_source = F.col("source_id").isin(*LEGAL_SOURCES)
    cols = ["id", "source_id", "url", "diff_summary", "change_type", "threat_score", "npa_critical", "detected_at"]
    replies_ = analyses(spark, sf)
    comp = monitoring.merge_analyses(
        monitoring.competitor_changes(diffed.filter(~is_legal_source), sources(spark)), replies_)
    law = monitoring.legal_changes(diffed.filter(is_legal_source), sources(spark), replies_)
    return comp.select(*cols).unionByName(law.select(*cols))


def pending(spark, sf):
    changes = all_changes(spark, sf)
    digested = table(spark, sf, "events").filter("event_id % 4 = 1").select(F.col("event_id").alias("change_id"))
    return digest.pending_changes(changes, digested, 100)


@query("T4_pending_changes", f"WITH RECURSIVE {ALL_CHANGES_CTE} SELECT id, source_id, change_type, threat_score, npa_critical FROM pending")
def t4(spark, sf):
    return pending(spark, sf).select("id", "source_id", "change_type", "threat_score", "npa_critical")


@query("J13_split_pending", f"WITH RECURSIVE {ALL_CHANGES_CTE} SELECT id, CASE WHEN {IS_LEGAL_SQL} THEN 'npa' ELSE 'competitor' END AS section FROM pending")
def j13(spark, sf):
    # the list is short and read twice
    law, comp = digest.split_pending(cut_lineage(pending(spark, sf), "pending"))
    return law.select("id", F.lit("npa").alias("section")).unionByName(comp.select("id", F.lit("competitor").alias("section")))


ORDER_SQL = (f"CASE WHEN {IS_LEGAL_SQL} AND coalesce(npa_critical, FALSE) THEN 0 ELSE 1 END, coalesce(threat_score, 0) DESC, "
             "threat_score IS NULL, detected_at DESC, id")


@query("T5_digest_order", f"""WITH RECURSIVE {ALL_CHANGES_CTE}, s AS (SELECT *, CASE WHEN {IS_LEGAL_SQL} THEN 'npa' ELSE 'competitor' END AS section FROM pending)
SELECT id, section, row_number() OVER (PARTITION BY section ORDER BY {ORDER_SQL}) AS position FROM s""")
def t5(spark, sf):
    from pyspark.sql import Window
    rows = digest.digest_order(pending(spark, sf))
    return rows.select("id", "section", F.row_number().over(
        Window.partitionBy("section").orderBy("sort_key")).alias("position"))


LABEL_SQL = ("CASE WHEN threat_score IS NULL THEN '❓ не определён' " + " ".join(
    f"WHEN threat_score = {k} THEN {lit(f'{v} ({k}/5)')}" for k, v in fixed.THREAT_LABELS) + " END")
BLOCK_SQL = f"""(CASE WHEN section = 'npa' AND coalesce(npa_critical, FALSE) THEN '⚠️ *КРИТИЧНО*  •  `' ELSE '`' END || source_id || '`' || chr(10) ||
  '_Тип: ' || CASE change_type {' '.join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in fixed.CHANGE_TYPE_LABELS)} END || '  •  Угроза: ' || {LABEL_SQL} || '_' || chr(10) ||
  coalesce(diff_summary, '_описание не сформировано_') || chr(10) || '🔗 ' || url || chr(10) || chr(10))"""


DIGEST_PARTS_SQL = f"""t AS (SELECT {{by}} max(threat_score) AS threat_score, count(*) AS changes,
  coalesce(string_agg({BLOCK_SQL}, '' ORDER BY {ORDER_SQL}) FILTER (section = 'npa'), '_нет изменений за период_' || chr(10)) AS npa,
  coalesce(string_agg({BLOCK_SQL}, '' ORDER BY {ORDER_SQL}) FILTER (section = 'competitor'), '_нет изменений за период_' || chr(10)) AS comp FROM s {{group}})"""
DIGEST_TEXT_SQL = f"""rtrim('📋 *Дайджест изменений — ' || {{day}} || '*' || chr(10) || chr(10) || 'Итоговый уровень угрозы: ' || {LABEL_SQL} || chr(10) || chr(10) ||
  repeat('─', 24) || chr(10) || chr(10) || '🏛 *НПА — нормативные изменения*' || chr(10) || chr(10) || npa || chr(10) ||
  repeat('─', 24) || chr(10) || chr(10) || '🏢 *Конкуренты*' || chr(10) || chr(10) || comp, chr(10))"""


@query("D7_A13_digest_text", f"""WITH RECURSIVE {ALL_CHANGES_CTE}, s AS (SELECT *, CASE WHEN {IS_LEGAL_SQL} THEN 'npa' ELSE 'competitor' END AS section FROM pending),
{DIGEST_PARTS_SQL.format(by="", group="")}
SELECT changes, threat_score AS max_score, {DIGEST_TEXT_SQL.format(day="'05.02.2024'")} AS content_md FROM t""")
def d7(spark, sf):
    return digest.digest_text(pending(spark, sf), F.lit("05.02.2024")).select("changes", "max_score", "content_md")


@query("K7_mark_digested", f"WITH RECURSIVE {ALL_CHANGES_CTE} SELECT id AS change_id, CAST(7 AS BIGINT) AS digest_id FROM pending")
def k7(spark, sf):
    path = tables.scratch_path(spark, "stored-membership")
    tables.append_digest_membership(digest.mark_digested(pending(spark, sf), 7), path)
    return spark.read.parquet(path)
