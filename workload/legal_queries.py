"""Legal updates, organisation documents, lists, sinks and streams."""
from __future__ import annotations

from pyspark.sql import functions as F

from auditspan.knowledge import fixed_values as fixed
from auditspan.functions import replies
from auditspan.operators import digest
from auditspan.operators import documents as doc_ops
from auditspan.operators import legal, monitoring, serving
from auditspan.operators import pages as page_ops
from auditspan.plans import audit as audit_plan
from auditspan.sinks import tables
from auditspan.sources import crawl as crawl_source
from auditspan.sources import dimensions
from auditspan.sources import snapshots as snapshot_source
from auditspan.streaming import jobs
from workload import crawl_table as ct
from workload.audit_queries import REPORTS_CTE
from workload.crawl_table import crawl_cte, lit, site, values
from workload.diff_sql import diff_cte
from workload.monitor_queries import ALL_CHANGES_CTE, DIGEST_PARTS_SQL, DIGEST_TEXT_SQL, IS_LEGAL_SQL, LEGAL_CTE, SNAP_CTE, SNAP_SELECT, snapshots
from workload.monitor_queries import legal as legal_rows
from workload.monitor_queries import pending
from workload.page_queries import FORM_VALUES, IS_HTML_SQL, SCRIPT_VALUES
from workload import dimension_files
from workload.registry import plan_once, query, table
from workload.text_queries import UPDATES_CTE, found_updates

TYPES = [t[0] for t in fixed.DOCUMENT_TYPES]
TYPE_CASE = "CASE {k} % 12 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES)) + " END"
UPDATES_VALUES = values("upd", "id, effective_date, source, title, articles, doc_type, upd_ord", [
    (u[0], u[2], u[3], u[4], ", ".join(u[7]), d, i) for i, u in enumerate(fixed.LEGAL_UPDATES) for d in u[8]])

# -- organisations, documents and reports from customer / orders ---------------

ORG_FIELDS = {
    "id": "'org' || CAST(c_custkey AS STRING)", "legal_name": "c_name",
    "short_name": "CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'Short ' || CAST(c_custkey AS STRING) END",
    "inn": "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(7700000000 + c_custkey AS STRING) END",
    "ogrn": "''", "legal_address": "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Street ' || CAST(c_nationkey AS STRING) END",
    "actual_address": "CASE WHEN c_custkey % 4 = 0 THEN 'Other street' ELSE '' END", "ceo_name": "''",
    "ceo_position": "'Генеральный директор'", "responsible_person": "''", "responsible_contact": "''",
    "website_url": "'https://org' || CAST(c_custkey AS STRING) || '.example.com'",
    "email": "CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'info@org' || CAST(c_custkey AS STRING) || '.example.com' END",
    "phone": "''", "hosting_location": "'Российская Федерация'",
}
ORG_LISTS = {
    "data_categories": "CASE WHEN c_custkey % 2 = 0 THEN 'имя,email' ELSE '' END", "processing_purposes": "''",
    "data_subjects": "'клиенты'", "third_parties": "CASE WHEN c_custkey % 3 = 1 THEN 'Банк,Почта' ELSE '' END",
    "cross_border_countries": "CASE WHEN c_custkey % 4 = 0 THEN 'FR,DE' ELSE '' END", "info_systems": "''",
}


def organizations(spark, sf):
    flat = table(spark, sf, "customer").select(
        *[F.expr(e).alias(n) for n, e in ORG_FIELDS.items()],
        *[F.when(F.expr(e) != "", F.split(F.expr(e), ",")).otherwise(F.array().cast("array<string>")).alias(n)
          for n, e in ORG_LISTS.items()],
        (F.col("c_nationkey") < 8).alias("cross_border"))
    return flat


ORGS_CTE = "orgs AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in {**ORG_FIELDS, **ORG_LISTS}.items()) + \
    ", c_nationkey < 8 AS cross_border, c_custkey FROM customer)"
DOC_SELECT = f"""SELECT 'org' || CAST(c_custkey AS STRING) || '-' || CAST(v AS STRING) AS id, 'org' || CAST(c_custkey AS STRING) AS organization_id,
  {TYPE_CASE.format(k='c_custkey')} AS doc_type, 'Документ ' || c_mktsegment AS title, CAST(v AS INT) AS version,
  CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_name || chr(10) || 'редакция ' || CAST(v AS STRING) || chr(10) || c_mktsegment END AS content_md, v AS made"""
DOCS_CTE = f"docs AS ({DOC_SELECT} FROM (SELECT *, unnest(range(1, 2 + c_custkey % 3)) AS v FROM customer))"


def org_documents(spark, sf):
    rows = table(spark, sf, "customer").withColumn(
        "v", F.explode(F.sequence(F.lit(1).cast("bigint"), 1 + F.col("c_custkey") % 3)))
    select = DOC_SELECT[len("SELECT "):]
    return rows.selectExpr(*_split_select(select)).withColumn(
        "created_at", F.timestamp_seconds(F.col("made") * 86400)).drop("made")


def _split_select(select: str) -> list[str]:
    """Top-level comma split of a select list."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(select):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(select[start:i])
            start = i + 1
    return [*out, select[start:]]


def org_reports(spark, sf):
    return table(spark, sf, "orders").select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("id"),
        F.concat(F.lit("org"), F.col("o_custkey").cast("string")).alias("organization_id"),
        F.col("o_orderdate").alias("report_date"), (F.col("o_orderkey") % 101).cast("int").alias("overall_score"))


RECENT_CTE = """recent AS (SELECT DISTINCT organization_id FROM (SELECT 'org' || o_custkey AS organization_id FROM orders
  WHERE o_orderdate >= DATE '1998-01-01'))"""


@query("T1_newest_reports", "SELECT 'r' || o_orderkey AS id, 'org' || o_custkey AS organization_id, o_orderdate AS report_date FROM orders ORDER BY o_orderdate DESC, 'r' || o_orderkey DESC LIMIT 20")
def t1(spark, sf):
    return serving.newest(org_reports(spark, sf), "report_date", 20, "id").drop("overall_score")


@query("T1_latest_report_per_org", """SELECT 'org' || o_custkey AS organization_id, 'r' || o_orderkey AS id FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, 'r' || o_orderkey DESC) = 1""")
def t1_org(spark, sf):
    return org_reports(spark, sf).groupBy("organization_id").agg(
        F.max_by("id", F.struct("report_date", "id")).alias("id"))


@query("T2_T3_report_by_id", "SELECT 'r' || o_orderkey AS id, 'org' || o_custkey AS organization_id FROM orders WHERE o_orderkey = 77")
def t3(spark, sf):
    return serving.by_id(org_reports(spark, sf), "r77").select("id", "organization_id")


@query("J15_organization_documents", f"WITH {ORGS_CTE}, {DOCS_CTE} SELECT o.id AS organization_id, legal_name, d.id, doc_type, version FROM orgs o JOIN docs d ON d.organization_id = o.id")
def j15(spark, sf):
    return doc_ops.organization_documents(organizations(spark, sf), org_documents(spark, sf)).select(
        "organization_id", "legal_name", "id", "doc_type", "version")


@query("J15_organization_reports", f"WITH {ORGS_CTE} SELECT o.id AS organization_id, legal_name, count(*) AS reports FROM orgs o JOIN orders ON 'org' || o_custkey = o.id GROUP BY ALL")
def j15_reports(spark, sf):
    return doc_ops.organization_reports(organizations(spark, sf), org_reports(spark, sf)).groupBy(
        "organization_id", "legal_name").agg(F.count("*").alias("reports"))


@query("P20_decode_organizations", f"WITH {ORGS_CTE} SELECT id, third_parties, cross_border FROM orgs")
def p20(spark, sf):
    decoded = doc_ops.decode_organizations(doc_ops.encode_organizations(organizations(spark, sf)))
    return decoded.select("id", F.array_join("third_parties", ",").alias("third_parties"), "cross_border")


# -- legal updates ------------------------------------------------------------

@query("T9_active_updates_for_requests", f"""WITH {UPDATES_VALUES},
q AS (SELECT o_orderkey, {TYPE_CASE.format(k='o_orderkey')} AS doc_type, DATE '2025-01-01' + CAST(o_orderkey % 365 AS INT) AS as_of FROM orders)
SELECT o_orderkey, q.doc_type, upd.id FROM q JOIN upd ON upd.doc_type = q.doc_type AND CAST(effective_date AS DATE) <= as_of""")
def t9(spark, sf):
    requests = table(spark, sf, "orders").select(
        "o_orderkey", F.expr(TYPE_CASE.format(k="o_orderkey")).alias("doc_type"),
        F.date_add(F.lit("2025-01-01").cast("date"), (F.col("o_orderkey") % 365).cast("int")).alias("as_of"))
    return legal.active_for_requests(requests, dimension_files.legal_updates(spark)).select("o_orderkey", "doc_type", "id")


@query("J9_affected_documents", f"WITH {UPDATES_VALUES}, {DOCS_CTE} SELECT d.id, organization_id, d.doc_type, upd.id AS update_id FROM docs d JOIN upd USING (doc_type)")
def j9(spark, sf):
    return legal.affected_documents(dimension_files.legal_updates(spark), org_documents(spark, sf)).select(
        "id", "organization_id", "doc_type", "update_id")


@query("J10_affected_recent_orgs", f"""WITH {UPDATES_VALUES}, {DOCS_CTE}, {RECENT_CTE}
SELECT d.id, organization_id, upd.id AS update_id FROM docs d JOIN upd USING (doc_type) SEMI JOIN recent USING (organization_id)""")
def j10(spark, sf):
    recent = legal.recent_organizations(org_reports(spark, sf), F.lit("1998-01-01").cast("date"))
    return legal.affected_documents(dimension_files.legal_updates(spark), org_documents(spark, sf), recent).select(
        "id", "organization_id", "update_id")


@query("J11_selected_updates", f"WITH {UPDATES_CTE} SELECT doc_id, content_key FROM updates WHERE given IN (SELECT 'LU-' || item_id * 4 FROM benchmark)")
def j11(spark, sf):
    ids = table(spark, sf, "benchmark").select(F.concat(F.lit("LU-"), (F.col("item_id") * 4).cast("string")).alias("id"))
    return legal.selected(found_updates(spark, sf), ids).select("doc_id", "content_key")


@query("J12_new_updates", f"""WITH {UPDATES_CTE},
stored AS (SELECT content_key FROM updates WHERE doc_id % 3 = 0)
SELECT doc_id, item_ord, title, content_key FROM updates WHERE content_key NOT IN (SELECT content_key FROM stored)
QUALIFY row_number() OVER (PARTITION BY content_key ORDER BY doc_id, item_ord) = 1""")
def j12(spark, sf):
    found = found_updates(spark, sf).drop("content_key").withColumn("found_ord", F.struct("doc_id", "item_ord"))
    return legal.new_updates(found, found.filter("doc_id % 3 = 0")).select("doc_id", "item_ord", "title", "content_key")


@query("U3_existing_and_new_updates", f"WITH {UPDATES_CTE} SELECT doc_id, item_ord, content_key FROM updates")
def u3(spark, sf):
    found = found_updates(spark, sf)
    return found.filter("doc_id % 3 = 0").unionByName(found.filter("doc_id % 3 <> 0")).select("doc_id", "item_ord", "content_key")


@query("A17_update_text", f"""WITH {UPDATES_CTE}
SELECT doc_id, item_ord, 'Изменение: ' || title || chr(10) || 'Источник: ' || source || chr(10) || 'Дата вступления в силу: 2025-09-01' || chr(10) ||
  'Затронутые статьи: ' || chr(10) || 'Описание: x' AS block FROM updates""")
def a17(spark, sf):
    return found_updates(spark, sf).select("doc_id", "item_ord", legal.update_text().alias("block"))


CONTEXT_CTE = f"""{UPDATES_VALUES}, ctx AS (SELECT doc_type, {lit(fixed.LEGAL_CONTEXT_HEADER)} || chr(10) || chr(10) || string_agg(
  '### ' || title || chr(10) || 'Вступило в силу: ' || effective_date || chr(10) || 'Источник: ' || source || chr(10) || 'Статьи: ' || articles ||
  chr(10) || 'Суть: ' || chr(10), chr(10) ORDER BY effective_date DESC, id) AS legal_context FROM upd GROUP BY doc_type)"""


@query("A16_legal_context_of_documents", f"WITH {CONTEXT_CTE}, {DOCS_CTE} SELECT docs.id, md5(legal_context) AS context_md5 FROM docs JOIN ctx USING (doc_type)")
def a16(spark, sf):
    contexts = legal.legal_context(dimension_files.legal_updates(spark))
    return org_documents(spark, sf).join(contexts, "doc_type").select("id", F.md5("legal_context").alias("context_md5"))


@query("D10_combined_context", f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 3 > 0 THEN 'stored ' || doc_id END,
  CASE WHEN doc_id % 2 = 0 THEN {lit(fixed.WEB_CONTEXT_HEADER)} || chr(10) || chr(10) || text END], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS context FROM documents""")
def d10(spark, sf):
    stored = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("stored "), F.col("doc_id").cast("string"))).otherwise("")
    web = F.when(F.col("doc_id") % 2 == 0, F.col("text"))
    return table(spark, sf, "documents").select("doc_id", legal.combined_context(stored, web).alias("context"))


# -- search hits --------------------------------------------------------------

HITS_CTE = """hits AS (SELECT user_id, 'https://hit.example.org/' || event_id % 40 AS url, CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END AS list_ord,
  event_id AS hit_ord, event_type AS title, props AS content FROM events),
merged AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY user_id, url ORDER BY list_ord, hit_ord) = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY user_id, list_ord ORDER BY hit_ord, url) AS rank FROM merged
  QUALIFY rank <= CASE list_ord WHEN 0 THEN 8 ELSE 5 END)"""


def _merged(spark, sf):
    hits = table(spark, sf, "events").select(
        "user_id", F.concat(F.lit("https://hit.example.org/"), (F.col("event_id") % 40).cast("string")).alias("url"),
        F.col("event_id").alias("hit_ord"), F.col("event_type").alias("title"), F.col("props").alias("content"))
    ours = F.col("title").isin("click", "view")
    return legal.merge_hits(hits.filter(ours), hits.filter(~ours), "user_id")


@query("U1_W3_merged_hits", f"WITH {HITS_CTE} SELECT user_id, url, list_ord, hit_ord, title FROM merged")
def u1(spark, sf):
    return _merged(spark, sf).select("user_id", "url", "list_ord", "hit_ord", "title")


@query("T11_top_hits", f"WITH {HITS_CTE} SELECT user_id, url, list_ord, rank FROM top")
def t11(spark, sf):
    return legal.top_hits(_merged(spark, sf), {0: 8, 1: 5}, "user_id").select("user_id", "url", "list_ord", "rank")


@query("A17_numbered_hits", f"""WITH {HITS_CTE}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY list_ord, rank) AS i FROM top)
SELECT user_id, string_agg('--- Результат ' || i || ' ---' || chr(10) || 'Источник: ' || url || chr(10) || 'Заголовок: ' || title || chr(10) ||
  'Содержание: ' || content || chr(10), chr(10) ORDER BY i) AS results_text FROM n GROUP BY user_id""")
def a17_hits(spark, sf):
    return legal.numbered_hits(legal.top_hits(_merged(spark, sf), {0: 8, 1: 5}, "user_id"), "user_id")


@query("U2_keyword_union", f"""WITH RECURSIVE {SNAP_CTE} SELECT source_id, count(*) AS snapshots, {len(fixed.LEGAL_STEMS)} + 1 AS words FROM snapshots GROUP BY source_id""")
def u2(spark, sf):
    base = F.array(*[F.lit(w) for w in fixed.LEGAL_STEMS])
    own = F.array(F.concat(F.lit("слово "), F.col("source_id")), F.lit(fixed.LEGAL_STEMS[0]))
    return snapshots(spark, sf).groupBy("source_id").agg(F.count("*").alias("snapshots")).withColumn(
        "words", F.size(F.array_union(base, own)))


# -- document generation and rewriting ----------------------------------------

TEMPLATES = {
    0: "# Документ {{LEGAL_NAME}} ({{SHORT_NAME}})\nИНН {{INN}} ОГРН {{OGRN}}\nАдрес {{LEGAL_ADDRESS}} / {{ACTUAL_ADDRESS}}\n{{CROSS_BORDER_INFO}}",
    1: "{{WEBSITE_URL}} {{EMAIL}} {{PHONE}} {{RESPONSIBLE_CONTACT}}\nДанные: {{DATA_CATEGORIES}}; третьи лица: {{THIRD_PARTIES}}\n{{PUBLICATION_DATE}}",
    2: "Приказ от {{ORDER_DATE}}: {{CEO_POSITION}} {{CEO_NAME}}, субъекты {{DATA_SUBJECTS}}, срок {{RETENTION_PERIODS}}, {{UPDATE_DATE}}",
}
TEMPLATE_ROWS = [(t, TEMPLATES[i % 3]) for i, t in enumerate(TYPES) if fixed.DOCUMENT_TYPES[i][2]]
TEMPLATES_CTE = "templates(doc_type, template) AS (VALUES " + ", ".join(
    f"({lit(t)}, {lit(x).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))})" for t, x in TEMPLATE_ROWS) + ")"
TYPES_CTE = values("types", "type_ord, doc_type, type_title, is_public", [
    (i, t[0], t[1], t[0] in fixed.PUBLIC_DOCUMENT_TYPES) for i, t in enumerate(fixed.DOCUMENT_TYPES)])
PACKAGE_CTE = f"""{ORGS_CTE}, {TYPES_CTE}, {TEMPLATES_CTE}, {CONTEXT_CTE},
package AS (SELECT o.*, type_ord, doc_type, type_title, is_public, coalesce(template, {lit(fixed.NO_TEMPLATE_TEXT)}) AS template,
  coalesce(legal_context, '') AS legal_context FROM orgs o, types LEFT JOIN templates USING (doc_type) LEFT JOIN ctx USING (doc_type))"""


def _inputs(spark, sf, public_only=False):
    from auditspan.localtable import local_table
    templates = local_table(spark, TEMPLATE_ROWS, "doc_type string, template string")
    return doc_ops.generation_inputs(
        organizations(spark, sf), templates, legal.legal_context(dimension_files.legal_updates(spark)), public_only)


@query("J14_document_package", f"""WITH {PACKAGE_CTE}
SELECT id, doc_type, type_title AS title, md5(template) AS template_md5, md5(legal_context) AS context_md5 FROM package""")
def j14(spark, sf):
    return _inputs(spark, sf).select(
        "id", "doc_type", "title", F.md5("template").alias("template_md5"), F.md5("legal_context").alias("context_md5"))


@query("J14_public_package", f"WITH {PACKAGE_CTE} SELECT id, doc_type FROM package WHERE is_public")
def j14_public(spark, sf):
    return _inputs(spark, sf, public_only=True).select("id", "doc_type")


R = lit(fixed.REQUIRED_MARK)
FILL_SQL = {
    "LEGAL_NAME": "legal_name", "SHORT_NAME": "coalesce(nullif(short_name, ''), legal_name)", "INN": f"coalesce(nullif(inn, ''), {R})",
    "OGRN": R, "LEGAL_ADDRESS": f"coalesce(nullif(legal_address, ''), {R})",
    "ACTUAL_ADDRESS": f"coalesce(nullif(actual_address, ''), nullif(legal_address, ''), {R})", "CEO_NAME": R, "CEO_POSITION": "ceo_position",
    "RESPONSIBLE_CONTACT": f"coalesce(nullif(email, ''), {R})", "WEBSITE_URL": "website_url", "EMAIL": f"coalesce(nullif(email, ''), {R})",
    "PHONE": R, "DATA_CATEGORIES": f"coalesce(nullif(replace(data_categories, ',', ', '), ''), {R})", "DATA_SUBJECTS": "data_subjects",
    "THIRD_PARTIES": f"coalesce(nullif(replace(third_parties, ',', ', '), ''), {lit(fixed.NO_THIRD_PARTIES)})",
    "CROSS_BORDER_INFO": f"""CASE WHEN cross_border AND cross_border_countries <> '' THEN {lit(fixed.CROSS_BORDER_LISTED)} || replace(cross_border_countries, ',', ', ')
      WHEN cross_border THEN {lit(fixed.CROSS_BORDER_UNLISTED)} ELSE {lit(fixed.CROSS_BORDER_NONE)} END""",
    "PUBLICATION_DATE": "'01.12.2025'", "UPDATE_DATE": "'01.12.2025'", "RETENTION_PERIODS": R,
}
_fill = "template"
for _name, _sql in FILL_SQL.items():
    _fill = f"replace({_fill}, '{{{{{_name}}}}}', {_sql})"


@query("D9_S8_filled_templates", f"""WITH {PACKAGE_CTE}
SELECT id, doc_type, md5({lit(fixed.TEMPLATE_DISCLAIMER.strip())} || chr(10) || chr(10) || {_fill}) AS content_md5 FROM package""")
def d9(spark, sf):
    return _inputs(spark, sf).select(
        "id", "doc_type", F.md5(doc_ops.fill_template(F.col("template"), F.lit("01.12.2025"))).alias("content_md5"))


@query("W8_next_versions", f"""WITH {DOCS_CTE}
SELECT id, row_number() OVER w AS version, lag(content_md) OVER w AS previous_content FROM docs
WINDOW w AS (PARTITION BY organization_id, doc_type ORDER BY made, id)""")
def w8(spark, sf):
    return doc_ops.number_versions(org_documents(spark, sf)).select("id", "version", "previous_content")


@query("W8_latest_versions", f"WITH {DOCS_CTE} SELECT organization_id, doc_type, max(version) AS version, arg_max(id, version) AS id FROM docs GROUP BY ALL")
def w8_latest(spark, sf):
    return doc_ops.latest_versions(org_documents(spark, sf)).select("organization_id", "doc_type", "version", "id")


def _rewrites(spark, sf, diff):
    current = doc_ops.latest_versions(org_documents(spark, sf))
    affected = legal.affected_documents(dimension_files.legal_updates(spark), current)
    number = F.regexp_extract("organization_id", r"(\d+)", 1).cast("bigint")
    contents = affected.select("organization_id", "doc_type", "update_id", F.when(
        number % 5 != 0, F.concat("content_md", F.lit("\nдополнено"))).alias("new_content"),
        F.when(number % 5 == 0, F.lit("timeout")).alias("error"))
    return doc_ops.rewrite_results(affected, contents, diff=diff)


@query("D11_rewrite_results", f"""WITH {UPDATES_VALUES}, {DOCS_CTE},
cur AS (SELECT *, CAST(regexp_extract(organization_id, '([0-9]+)', 1) AS BIGINT) AS n FROM docs QUALIFY row_number() OVER (PARTITION BY organization_id, doc_type ORDER BY version DESC) = 1)
SELECT organization_id, doc_type, upd.id AS update_id, CASE WHEN content_md = '' THEN 'skipped' WHEN n % 5 = 0 THEN 'error' ELSE 'draft' END AS status,
  CASE WHEN content_md <> '' AND n % 5 = 0 THEN 'timeout' END AS error,
  CASE WHEN content_md <> '' AND n % 5 <> 0 THEN version END AS old_version, CASE WHEN content_md <> '' AND n % 5 <> 0 THEN version + 1 END AS new_version
FROM cur JOIN upd USING (doc_type)""")
def d11(spark, sf):
    return _rewrites(spark, sf, diff=False).select(
        "organization_id", "doc_type", "update_id", "status", "error", "old_version", "new_version")


REWRITTEN_CTE = f"""{UPDATES_VALUES}, {DOCS_CTE},
cur AS (SELECT *, CAST(regexp_extract(organization_id, '([0-9]+)', 1) AS BIGINT) AS n FROM docs QUALIFY row_number() OVER (PARTITION BY organization_id, doc_type ORDER BY version DESC) = 1),
rewritten AS (SELECT organization_id, doc_type, upd.id AS update_id, organization_id || '/' || doc_type || '/' || upd.id AS k,
  CASE WHEN content_md = '' THEN 'skipped' WHEN n % 5 = 0 THEN 'error' ELSE 'draft' END AS status,
  CASE WHEN content_md <> '' AND n % 5 <> 0 THEN content_md END AS before, CASE WHEN content_md <> '' AND n % 5 <> 0 THEN content_md || chr(10) || 'дополнено' END AS after
  FROM cur JOIN upd USING (doc_type))"""


@query("D2_document_diff", f"""WITH RECURSIVE {REWRITTEN_CTE}, {diff_cte('rewritten', 'k', 'before', 'after', 3, fixed.DIFF_LABELS)}
SELECT organization_id, doc_type, update_id, status, diff FROM rewritten LEFT JOIN diffs ON key = k""")
def d2(spark, sf):
    return _rewrites(spark, sf, diff=True).select("organization_id", "doc_type", "update_id", "status", "diff")


@query("A15_generation_totals", f"WITH {ORGS_CTE} SELECT id AS organization_id, 12 AS total, 12 - CAST(c_custkey % 3 AS BIGINT) AS successful FROM orgs")
def a15(spark, sf):
    n = F.regexp_extract("id", r"(\d+)", 1).cast("bigint")
    docs = doc_ops.package(organizations(spark, sf)).select(
        F.col("id").alias("organization_id"), F.when(F.col("type_ord") < n % 3, F.lit("failed")).alias("error"))
    return serving.generation_totals(docs)


# -- sinks --------------------------------------------------------------------

@query("K1_scan_rows", f"WITH {REPORTS_CTE} SELECT site, site_url, pages_scanned FROM wide")
def k1(spark, sf):
    path = tables.scratch_path(spark, "scans")
    tables.append_scans(audit_plan.audit(ct.crawl_table(spark, sf)).sites, path)
    return spark.read.parquet(path).select("site", "site_url", "pages_scanned")


@query("K2_report_rows", f"WITH {REPORTS_CTE} SELECT site, overall_score, risk_level, summary FROM reports")
def k2(spark, sf):
    path = tables.scratch_path(spark, "reports")
    tables.append_reports(audit_plan.audit(ct.crawl_table(spark, sf)).reports, path)
    stored = spark.read.parquet(path)
    return stored.select("site", F.get_json_object("report_json", "$.overall_score").cast("int").alias("overall_score"),
                         "risk_level", "summary")


def _stored_organizations(spark, sf):
    """A table of organisations, and a third of them renamed by an upsert."""
    orgs = organizations(spark, sf).withColumn("updated_at", F.lit("2025-01-01").cast("timestamp"))
    n = F.regexp_extract("id", r"(\d+)", 1).cast("bigint")
    incoming = orgs.filter(n % 3 == 0).withColumns({
        "legal_name": F.lit("renamed"), "updated_at": F.lit("2025-02-01").cast("timestamp")})
    root = tables.scratch_path(spark, "orgs")
    tables.create_keyed(orgs, root, buckets=8)
    tables.merge_keyed(incoming, root)
    return root


@query("K3_upsert_organizations", f"WITH {ORGS_CTE} SELECT id, CASE WHEN c_custkey % 3 = 0 THEN 'renamed' ELSE legal_name END AS legal_name FROM orgs")
def k3(spark, sf):
    return tables.read_keyed(spark, _stored_organizations(spark, sf)).select("id", "legal_name")


@query("K3_earlier_version", f"WITH {ORGS_CTE} SELECT id, legal_name, inn FROM orgs")
def k3_earlier(spark, sf):
    return tables.read_keyed(spark, _stored_organizations(spark, sf), 1).select("id", "legal_name", "inn")


@query("K4_upsert_documents", f"""WITH {DOCS_CTE} SELECT id, CASE WHEN version = 2 THEN 'rewritten' ELSE content_md END AS content_md FROM docs
UNION ALL SELECT id || '-new', content_md FROM docs WHERE version = 1""")
def k4(spark, sf):
    docs = org_documents(spark, sf).withColumn("updated_at", F.col("created_at"))
    later = F.lit("2025-02-01").cast("timestamp")
    root = tables.scratch_path(spark, "documents")
    tables.create_keyed(docs, root, buckets=8)
    tables.merge_keyed(docs.filter("version = 2").withColumns({"content_md": F.lit("rewritten"), "updated_at": later}), root)
    tables.merge_keyed(docs.filter("version = 1").withColumns({"id": F.concat("id", F.lit("-new")), "updated_at": later}), root)
    return tables.read_keyed(spark, root).select("id", "content_md")


@query("K8_append_digest", f"""WITH RECURSIVE {ALL_CHANGES_CTE}, s AS (SELECT *, CASE WHEN {IS_LEGAL_SQL} THEN 'npa' ELSE 'competitor' END AS section FROM pending),
{DIGEST_PARTS_SQL.format(by="", group="")}
SELECT {DIGEST_TEXT_SQL.format(day="'05.02.2024'")} AS content_md, '2024-01-29' AS period_start, '2024-02-05' AS period_end FROM t""")
def k8(spark, sf):
    text = digest.digest_text(pending(spark, sf), F.lit("05.02.2024"))
    path = tables.scratch_path(spark, "digests")
    tables.append_digest(text, path, "2024-01-29", "2024-02-05")
    return spark.read.parquet(path).select("content_md", "period_start", "period_end")


@query("K9_append_updates", f"WITH {UPDATES_CTE} SELECT source, title, count(*) AS n FROM updates GROUP BY ALL")
def k9(spark, sf):
    path = tables.scratch_path(spark, "updates")
    tables.append_legal_updates(found_updates(spark, sf).select("id", "source", "title", "effective_date"), path)
    return spark.read.schema("id string, source string, title string").json(path).groupBy("source", "title").agg(F.count("*").alias("n"))


@query("K10_nested_export", f"""WITH {REPORTS_CTE}, p AS (SELECT {site('url')} AS site, page_ord // 100 AS part, count(*) AS pages FROM crawl WHERE {IS_HTML_SQL} GROUP BY ALL)
SELECT site, part, pages, overall_score FROM p JOIN reports USING (site)""")
def k10(spark, sf):
    docs = tables.export_documents(audit_plan.audit(ct.crawl_table(spark, sf), materialise=True), chunk=100)
    path = tables.write_export(docs, tables.scratch_path(spark, "export"), "2025-01-01")
    return spark.read.schema(docs.schema).json(path).select("site", "part", F.size(F.from_json("document", "pages array<struct<url:string>>").getField("pages")).cast("bigint").alias("pages"),
                       F.get_json_object("document", "$.report.overall_score").cast("int").alias("overall_score"))


# -- streams ------------------------------------------------------------------

def _run(spark, stream, name, mode="append"):
    """Drain a stream into a table in the shared folder and read it back."""
    out = tables.scratch_path(spark, name)
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", out)
         .option("checkpointLocation", tables.scratch_path(spark, name + "-progress")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


SLICES, FILES = 4, 4
#: which quarter of the time span a row's time lies in; rows without a time come first
QUARTER = "coalesce(least(3, ((us - lo) * 4) {div} greatest(1, hi - lo)), 0)"


def _in_slices(spark, rows, number, slices, name):
    """Folder with the rows of one slice after another, each in ``FILES`` files: one micro-batch each."""
    path = tables.scratch_path(spark, name)
    for i in range(slices):
        rows.filter(number == i).repartition(FILES).write.mode("append").parquet(path)
    return path


def _with_quarter(rows, time):
    us = F.unix_micros(F.col(time).cast("timestamp"))
    low, high = rows.agg(F.min(us), F.max(us)).first()
    return rows.withColumns({"us": us, "lo": F.lit(low), "hi": F.lit(high)}).withColumn(
        "quarter", F.expr(QUARTER.format(div="div")).cast("int")).drop("us", "lo", "hi")


@plan_once
def _event_slices(spark, sf):
    """Events in files of rising time."""
    rows = _with_quarter(table(spark, sf, "events"), "ts")
    return _in_slices(spark, rows, F.col("quarter"), SLICES, "events")


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(_event_slices(spark, sf))


def _snapshot_stream(spark, sf):
    events = _event_stream(spark, sf).withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))
    body = SNAP_SELECT[SNAP_SELECT.index("SELECT") + 6:SNAP_SELECT.index("FROM (SELECT")]
    fetches = events.selectExpr(*_split_select(body)).withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    return monitoring.snapshot_rows(fetches)


@query("ST1_snapshot_change_stream", f"""WITH RECURSIVE {SNAP_CTE}
SELECT id, CASE WHEN fetch_status <> 'ok' THEN 'failed' WHEN NOT has_previous THEN 'baseline'
  WHEN content_hash = previous_hash THEN 'unchanged' ELSE 'changed' END AS route, previous_hash FROM history""")
def st1(spark, sf):
    return _run(spark, jobs.snapshot_changes(_snapshot_stream(spark, sf)), "st1").select("id", "route", "previous_hash")


@query("ST2_parse_warning_stream", f"""WITH RECURSIVE {SNAP_CTE},
n AS (SELECT *, CASE WHEN fetch_status = 'ok' THEN len(list_filter(string_split(raw_text, chr(10)), lambda x: trim(x) <> '')) ELSE 0 END AS items,
  CASE WHEN fetch_status = 'ok' THEN len(list_filter(string_split(raw_text, chr(10)), lambda x: trim(x) <> '')) END AS good FROM snapshots),
l AS (SELECT *, lag(good, 1 IGNORE NULLS) OVER w AS g1, lag(good, 2 IGNORE NULLS) OVER w AS g2, lag(good, 3 IGNORE NULLS) OVER w AS g3
  FROM n WINDOW w AS (PARTITION BY source_id, url ORDER BY captured_at, id))
SELECT id, source_id, url FROM l WHERE items = 0 AND g1 > 0 AND g2 > 0 AND g3 > 0""")
def st2(spark, sf):
    return _run(spark, jobs.snapshot_changes(_snapshot_stream(spark, sf)), "st2").filter("parse_warning").select("id", "source_id", "url")


@query("ST3_new_update_stream", """SELECT DISTINCT md5('src' || user_id || ':' || event_type) AS content_key, 'src' || user_id AS source, event_type AS title
FROM events WHERE user_id % 3 <> 0""")
def st3(spark, sf):
    named = [F.concat(F.lit("src"), F.col("user_id").cast("string")).alias("source"), F.col("event_type").alias("title")]
    found = _event_stream(spark, sf).select(*named, F.col("ts").cast("timestamp").alias("found_at"))
    stored = table(spark, sf, "events").filter("user_id % 3 = 0").select(*named).select(
        replies.content_key(F.col("source"), F.col("title")).alias("content_key"))
    return _run(spark, jobs.new_updates(found, "found_at", stored), "st3").select("content_key", "source", "title")


def _stored_in_files(spark, rows, name):
    """Rows written in several files, one micro-batch each."""
    stored = tables.scratch_path(spark, name)
    rows.repartition(SLICES).write.parquet(stored)
    return stored


@query("ST4_critical_alert_stream", f"WITH RECURSIVE {LEGAL_CTE} SELECT id, threat_score FROM legal WHERE npa_critical AND threat_score IS NOT NULL")
def st4(spark, sf):
    stored = _stored_in_files(spark, legal_rows(spark, sf), "legal-changes")
    out = tables.scratch_path(spark, "alerts")
    stream = spark.readStream.schema(spark.read.parquet(stored).schema).option("maxFilesPerTrigger", 1).parquet(stored)
    q = (stream.writeStream.foreachBatch(jobs.alert_writer(lambda alerts, epoch: tables.write_alerts(alerts, out, epoch)))
         .option("checkpointLocation", tables.scratch_path(spark, "alerts-progress")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema("id bigint, threat_score int, message string").json(out).select("id", "threat_score")


WEEK_CHANGES = """SELECT event_id AS id, 'src' || CAST(user_id % 12 AS STRING) AS source_id,
  'https://watched.example.org/' || CAST(user_id % 3 AS STRING) AS url, CASE WHEN event_id % 4 <> 0 THEN props END AS diff_summary,
  CASE WHEN event_type = 'signup' THEN 'npa' ELSE 'ui' END AS change_type,
  CASE WHEN event_id % 6 <> 0 THEN CAST(event_id % 5 + 1 AS INT) END AS threat_score, event_id % 9 = 0 AS npa_critical, ts AS detected_at FROM {events}"""
WEEK_LIMIT = 30


@query("ST5_weekly_digest_stream", f"""WITH c AS ({WEEK_CHANGES.format(events="events")}),
w AS (SELECT *, time_bucket(INTERVAL '7 days', detected_at, TIMESTAMP '1970-01-05 10:00:00') + INTERVAL '7 days' AS week_end FROM c),
totals AS (SELECT week_end, count(*) AS all_changes, count_if({IS_LEGAL_SQL}) AS legal_changes FROM w GROUP BY week_end
  HAVING week_end <= (SELECT max(detected_at) - INTERVAL '1 day' FROM c)),
s AS (SELECT *, CASE WHEN {IS_LEGAL_SQL} THEN 'npa' ELSE 'competitor' END AS section FROM w
  QUALIFY row_number() OVER (PARTITION BY week_end ORDER BY threat_score DESC NULLS LAST, detected_at DESC, id) <= {WEEK_LIMIT}),
{DIGEST_PARTS_SQL.format(by="week_end,", group="GROUP BY week_end")}
SELECT week_end, changes AS listed, threat_score AS max_score, {DIGEST_TEXT_SQL.format(day="strftime(week_end, '%d.%m.%Y')")} AS content_md, all_changes, legal_changes
FROM t JOIN totals USING (week_end)""")
def st5(spark, sf):
    changes = spark.sql(WEEK_CHANGES, events=_event_stream(spark, sf)).withColumn("detected_at", F.col("detected_at").cast("timestamp"))
    out = tables.scratch_path(spark, "digests")
    write = jobs.digest_writer(lambda texts, epoch: tables.write_epoch(texts, out, epoch), WEEK_LIMIT)
    q = (jobs.weekly_changes(changes, WEEK_LIMIT).writeStream.foreachBatch(write)
         .option("checkpointLocation", tables.scratch_path(spark, "digests-progress")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).drop("epoch").withColumn("week_end", F.col("week_end").cast("timestamp_ntz"))


DELAY_DAYS = 2
MOVED = "CASE id % 10 WHEN 3 THEN 1 WHEN 7 THEN 2 ELSE 0 END"


@query("ST6_late_snapshots", f"""WITH RECURSIVE {SNAP_CTE}, span AS (SELECT min(epoch_us(captured_at)) AS lo, max(epoch_us(captured_at)) AS hi FROM snapshots),
timed AS (SELECT *, epoch_us(captured_at) AS us FROM snapshots, span),
a AS (SELECT *, us // 1000 AS ms, {QUARTER.format(div="//")} + {MOVED} AS arrival FROM timed),
marks AS (SELECT arrival, max(max(ms)) OVER (ORDER BY arrival) - {DELAY_DAYS * 86_400_000} AS mark FROM a GROUP BY arrival),
judged AS (SELECT a.*, EXISTS (SELECT 1 FROM a x JOIN marks m ON x.ms <= m.mark WHERE m.arrival = a.arrival - 2 AND x.arrival < a.arrival
  AND x.source_id = a.source_id AND x.url = a.url AND (x.us, x.id) > (a.us, a.id)) AS late FROM a),
ordered AS (SELECT *, lag(content_hash) OVER w AS before, row_number() OVER w > 1 AS has_before FROM judged
  WHERE NOT late AND ms <= (SELECT max(mark) FROM marks) WINDOW w AS (PARTITION BY source_id, url ORDER BY us, id))
SELECT id, 'late' AS route, NULL AS previous_hash FROM judged WHERE late
UNION ALL SELECT id, CASE WHEN fetch_status <> 'ok' THEN 'failed' WHEN NOT has_before THEN 'baseline'
  WHEN content_hash = before THEN 'unchanged' ELSE 'changed' END, before FROM ordered""")
def st6(spark, sf):
    rows = snapshots(spark, sf).withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    rows = _with_quarter(rows, "captured_at").withColumn("arrival", F.col("quarter") + F.expr(MOVED))
    stored = _in_slices(spark, rows, F.col("arrival"), SLICES + 2, "snapshots")
    stream = snapshot_source.stream_snapshots(spark, stored, max_files=FILES)
    return _run(spark, jobs.snapshot_changes(stream, f"{DELAY_DAYS} days"), "st6").select("id", "route", "previous_hash")


@query("U4_except_seen_updates", f"""WITH {UPDATES_CTE}
SELECT DISTINCT content_key FROM updates EXCEPT SELECT content_key FROM updates WHERE doc_id % 3 = 0""")
def u4(spark, sf):
    found = found_updates(spark, sf).drop("content_key").withColumn("found_ord", F.struct("doc_id", "item_ord"))
    return legal.new_updates(found, found.filter("doc_id % 3 = 0")).select("content_key")


@query("S7_watched_sources", f"""WITH RECURSIVE {SNAP_CTE}
SELECT source_id, 'Источник ' || source_id AS name, url, count(*) AS snapshots, count_if(fetch_status = 'ok') AS ok
FROM snapshots WHERE url <> 'https://watched.example.org/2' GROUP BY ALL""")
def s7(spark, sf):
    config = {"competitors": [{"id": f"src{i}", "name": f"Источник src{i}", "urls": [f"https://watched.example.org/{k}" for k in (0, 1)]}
                              for i in range(6)],
              "npa_sources": [{"id": f"src{i}", "name": f"Источник src{i}", "url": f"https://watched.example.org/{k}", "keywords": ["закон"]}
                              for i in range(6, 12) for k in (0, 1)]}
    watched = dimensions.sources_from_config(spark, config).select("source_id", "name", "url")
    return snapshots(spark, sf).join(watched, ["source_id", "url"]).groupBy("source_id", "name", "url").agg(
        F.count("*").alias("snapshots"), F.count_if(F.col("fetch_status") == "ok").alias("ok"))


@query("T1_newest_organizations", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 50")
def t1_organizations(spark, sf):
    return serving.newest(table(spark, sf, "customer"), "c_acctbal", 50, "c_custkey").select("c_custkey", "c_name")


@query("ST7_arriving_pages_stream", f"""WITH {crawl_cte()}, {FORM_VALUES}, {SCRIPT_VALUES}
SELECT page_ord, url, (SELECT count(*) FROM form_facts x WHERE x.f = c.f) AS forms_count,
  (SELECT count(*) FROM script_facts x WHERE x.s = c.s) AS external_scripts_count FROM crawl c WHERE {IS_HTML_SQL}""")
def st7(spark, sf):
    stored = _stored_in_files(spark, ct.crawl_table(spark, sf), "crawl")
    facts = jobs.arriving_pages(crawl_source.stream_crawl(spark, stored, maxFilesPerTrigger=1))
    return _run(spark, page_ops.page_summary(facts).select("page_ord", "url", "forms_count", "external_scripts_count"), "st7")
