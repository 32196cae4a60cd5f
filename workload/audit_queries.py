"""Site-level operators: policy choice, the 42 checks, scores, fines, serving."""
from __future__ import annotations

from pyspark.sql import functions as F

from auditspan.functions import urls
from auditspan.knowledge import fixed_values as fixed
from auditspan.operators import evaluation, rules, scoring, serving
from auditspan.operators import pages as page_ops
from auditspan.operators import policies as policy_ops
from auditspan.operators import scripts as script_ops
from auditspan.operators import sites as site_ops
from auditspan.plans import audit as audit_plan
from auditspan.sources import dimensions
from workload import crawl_table as ct
from workload import dimension_files
from workload.crawl_table import crawl_cte, host, lit, norm, path, site, values
from workload.page_queries import (
    BANNERS_CTE, FOOTER_SQL, FORM_VALUES, IS_HTML_SQL, POLICY_PAGE_SQL, PRIORITY_SQL, SCRIPTS_CTE, TITLE_SQL,
    VISIBLE_SQL, facts, rx)
from workload.registry import page_plan, plan_once, query, table


def contains_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(w)})" for w in words) + ")"


def cyrillic(column: str) -> str:
    cyr = f"length(regexp_replace({column}, '[^\\x{{0400}}-\\x{{04FF}}]', '', 'g'))"
    letters = f"length(regexp_replace({column}, '[^\\p{{L}}]', '', 'g'))"
    return f"({letters} > 0 AND {cyr} * 2 >= {letters} AND {cyr} >= 50)"


def flag_sql(text: str, pack=fixed.POLICY_FLAGS_RU) -> dict[str, str]:
    forms = {"raw": text, "lower": f"lower({text})"}
    return {flag: " AND ".join(f"regexp_matches({forms[form]}, {lit(p)})" for p in patterns)
            for _, flag, form, patterns in pack}


FLAG_COLUMNS = ",\n  ".join(f"coalesce({sql}, FALSE) AS {name}" for name, sql in flag_sql("text").items())
ELEMENTS = ",\n  ".join(
    f"coalesce({contains_any('lower(text)', words)}, FALSE) AS element_{i}" for i, (_, words) in enumerate(fixed.CONSENT_ELEMENTS))
DISCLOSED = ",\n  ".join(
    f"coalesce({contains_any('lower(text)', words)}, FALSE) AS names_{i}" for i, (_, _, words, _) in enumerate(fixed.TRACKERS))

CANDIDATES_CTE = f"""titled AS (SELECT *, {TITLE_SQL} AS title FROM crawl),
texts AS (
  SELECT {site('url')} AS site, page_ord, url, is_fallback, pdf_method, content_type,
    CASE WHEN content_type = 'application/pdf' THEN pdf_text ELSE {VISIBLE_SQL} END AS text
  FROM titled WHERE (({IS_HTML_SQL} AND {POLICY_PAGE_SQL})
    OR (content_type = 'application/pdf' AND status_code NOT BETWEEN 400 AND 499))
    AND (NOT is_fallback OR status_code = 200)),
candidates AS (SELECT *, {PRIORITY_SQL.format(p=path('url'))} AS priority,
  {cyrillic('text')} AS is_russian, {FLAG_COLUMNS}, {ELEMENTS}, {DISCLOSED},
  coalesce({contains_any('lower(text)', fixed.OFFER_MARKERS)}, FALSE) AS has_offer,
  coalesce({contains_any('lower(text)', fixed.CONSENT_MARKERS)}, FALSE) AS has_consent_wording,
  coalesce({contains_any('lower(text)', fixed.WITHDRAWAL_MARKERS + fixed.WITHDRAWAL_STEMS)}, FALSE) AS has_withdrawal,
  coalesce({contains_any('lower(text)', fixed.CROSS_BORDER_STEMS)}, FALSE) AS discloses_transfer
  FROM texts),
valid AS (SELECT * FROM candidates WHERE text IS NULL OR (length(text) >= 500 AND is_russian)),
best AS (
  SELECT * FROM valid v WHERE NOT is_fallback
    OR NOT EXISTS (SELECT 1 FROM candidates c WHERE c.site = v.site AND NOT c.is_fallback)
  QUALIFY row_number() OVER (PARTITION BY site ORDER BY coalesce(length(text), 0) DESC, priority DESC, page_ord) = 1)"""


@plan_once
def candidates(spark, sf):
    return page_ops.policy_candidates(ct.crawl_table(spark, sf))


FLAG_NAMES = [name for _, name, _, _ in fixed.POLICY_FLAGS_RU]


@query("P12_policy_flags", f"WITH {crawl_cte()}, {CANDIDATES_CTE} SELECT site, page_ord, {', '.join(FLAG_NAMES)} FROM candidates")
def p12(spark, sf):
    return candidates(spark, sf).select("site", "page_ord", *[f"policy.{n}" for n in FLAG_NAMES])


@query("P13_policy_provenance", f"""WITH {crawl_cte()}, {CANDIDATES_CTE}
SELECT site, page_ord, sha256(text) AS text_hash, length(text) AS content_length, CASE WHEN text IS NOT NULL THEN FALSE END AS text_truncated FROM candidates""")
def p13(spark, sf):
    return candidates(spark, sf).select(
        "site", "page_ord", "policy.text_hash", "policy.content_length", "policy.text_truncated")


@query("P14_unreadable_policies", f"""WITH {crawl_cte()}, {CANDIDATES_CTE}
SELECT site, page_ord, url, pdf_method AS method FROM candidates WHERE text IS NULL""")
def p14(spark, sf):
    return candidates(spark, sf).filter("text IS NULL").select(
        "site", "page_ord", "url", F.col("policy.extraction_method").alias("method"))


@query("W5_best_policy", f"""WITH {crawl_cte()}, {CANDIDATES_CTE}
SELECT site, page_ord, url, sha256(text) AS text_hash FROM best""")
def w5(spark, sf):
    return policy_ops.best_policies(candidates(spark, sf)).select("site", "page_ord", "url", "policy.text_hash")


@query("W6_first_valid_policy", f"""WITH {crawl_cte()}, {CANDIDATES_CTE}
SELECT site, page_ord, url FROM valid QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_ord) = 1""")
def w6(spark, sf):
    return policy_ops.first_valid_policies(candidates(spark, sf)).select("site", "page_ord", "url")


URL_ONLY_CTE = f"""url_only AS (
  SELECT site, norm_url AS policy_url FROM (
    SELECT {site('url')} AS site, page_ord, {norm('url')} AS norm_url FROM crawl WHERE NOT is_fallback) t
  WHERE {rx('norm_url', fixed.POLICY_URL_PATTERN)} AND site NOT IN (SELECT site FROM candidates)
  QUALIFY row_number() OVER (PARTITION BY site ORDER BY {PRIORITY_SQL.format(p=path('norm_url'))} DESC, page_ord) = 1)"""


@query("W7_url_only_policy", f"WITH {crawl_cte()}, {CANDIDATES_CTE}, {URL_ONLY_CTE} SELECT site, policy_url FROM url_only")
def w7(spark, sf):
    return policy_ops.url_only_policies(facts(spark, sf))


@query("U5_policy_candidates_union", f"""WITH {crawl_cte()}, {CANDIDATES_CTE}
SELECT site, page_ord, url FROM candidates c WHERE NOT is_fallback
UNION ALL SELECT site, page_ord, url FROM candidates c
WHERE is_fallback AND site NOT IN (SELECT site FROM candidates WHERE NOT is_fallback)""")
def u5(spark, sf):
    every = candidates(spark, sf).select("site", "page_ord", "url", "is_fallback")
    return policy_ops.with_fallback(every.filter("NOT is_fallback"), every.filter("is_fallback")).select(
        "site", "page_ord", "url")


PROBES_CTE = f"""{values('paths', 'probe_ord, path', list(enumerate(fixed.WELL_KNOWN_POLICY_PATHS)))},
homes AS (SELECT {site('url')} AS site, arg_min({host('url')}, page_ord) FILTER (NOT is_fallback) AS host, max(page_ord) AS last FROM crawl GROUP BY 1),
probes AS (SELECT site, last + 1 + probe_ord AS page_ord, 'https://' || host || path AS url, probe_ord FROM homes, paths
  WHERE site NOT IN (SELECT site FROM candidates WHERE NOT is_fallback)
  AND 'https://' || host || path NOT IN (SELECT {norm('url')} FROM crawl))"""


def probes(spark, sf):
    return site_ops.probe_frontier(ct.crawl_table(spark, sf), candidates(spark, sf))


@query("U5_probe_frontier", f"WITH {crawl_cte()}, {CANDIDATES_CTE}, {PROBES_CTE} SELECT site, page_ord, url FROM probes")
def u5_probes(spark, sf):
    return probes(spark, sf).select("site", "page_ord", "url")


ANSWER_PAGE = f"""CASE WHEN page_ord % 3 = 0 THEN {lit(ct._PLAIN_PAGE % ct.POLICIES[0])} ELSE {lit(ct._PLAIN_PAGE % ct.POLICIES[2])} END"""


@query("U5_policies_with_probes", f"""WITH {crawl_cte()}, {CANDIDATES_CTE}, {PROBES_CTE},
answered AS (SELECT *, 1 + CASE WHEN page_ord % 3 = 0 THEN 1 ELSE 0 END AS good FROM probes WHERE page_ord % 4 <> 0),
known AS (SELECT DISTINCT site FROM candidates WHERE NOT is_fallback),
earlier AS (SELECT site, page_ord, url, coalesce(length(text), 0) AS n, priority FROM valid WHERE is_fallback AND site NOT IN (SELECT site FROM known)),
later AS (SELECT site, page_ord, url, (SELECT max(length(text)) FROM candidates WHERE starts_with(text, 'Документ') AND contains(text, 'ООО Ромашка')) AS n,
  {PRIORITY_SQL.format(p=path('url'))} AS priority FROM answered WHERE good = 2),
chosen AS (SELECT * FROM (SELECT * FROM earlier UNION ALL SELECT * FROM later)
  QUALIFY row_number() OVER (PARTITION BY site ORDER BY n DESC, priority DESC, page_ord) = 1)
SELECT site, url FROM best WHERE NOT is_fallback UNION ALL SELECT site, url FROM chosen""")
def u5_policies(spark, sf):
    crawl = ct.crawl_table(spark, sf)
    answers = probes(spark, sf).select(
        "page_ord", "url", F.when(F.col("page_ord") % 4 == 0, 404).otherwise(200).alias("status_code"),
        F.lit("text/html").alias("content_type"), F.expr(ANSWER_PAGE).alias("html"))
    united = site_ops.with_probes(crawl, answers)
    return policy_ops.best_policies(page_ops.policy_candidates(united)).select("site", "url")


# -- trackers against the policy ----------------------------------------------

TRACKERS_CTE = "used AS (SELECT DISTINCT site, tracker FROM scripts WHERE tracker IS NOT NULL)"
KEYWORDS = values("keywords", "tracker_ord, tracker, is_foreign, word", [
    (i, name, foreign, word) for i, (name, _, words, foreign) in enumerate(fixed.TRACKERS) for word in words])


@query("J5_undisclosed_trackers", f"""WITH {crawl_cte()}, {CANDIDATES_CTE}, {SCRIPTS_CTE}, {TRACKERS_CTE}, {KEYWORDS}
SELECT site, tracker FROM used JOIN best USING (site) WHERE text IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM keywords k WHERE k.tracker = used.tracker AND contains(lower(text), k.word))""")
def j5(spark, sf):
    scripts = script_ops.page_scripts(ct.crawl_table(spark, sf))
    used = script_ops.match_trackers(scripts, dimensions.trackers(spark))
    policies = policy_ops.best_policies(candidates(spark, sf)).filter("text IS NOT NULL")
    return script_ops.undisclosed_trackers(used, policies).select("site", "tracker")


@query("J6_foreign_trackers_undisclosed", f"""WITH {crawl_cte()}, {CANDIDATES_CTE}, {SCRIPTS_CTE}, {TRACKERS_CTE}, {KEYWORDS}
SELECT site, tracker FROM used JOIN best USING (site)
WHERE NOT discloses_transfer AND tracker IN (SELECT tracker FROM keywords WHERE is_foreign)""")
def j6(spark, sf):
    scripts = script_ops.page_scripts(ct.crawl_table(spark, sf))
    used = script_ops.match_trackers(scripts, dimensions.trackers(spark))
    return script_ops.foreign_trackers_without_notice(
        used, policy_ops.best_policies(candidates(spark, sf))).select("site", "tracker")


# -- the check list -----------------------------------------------------------

CHECKLIST = values("checklist", "check_id, category, severity, fine_id, title, law, advice", [
    (c, cat, sev, fine, title, law, rec) for c, cat, sev, fine, _, title, law, rec in fixed.CHECKLIST])
FINES = values("fines", "fine_id, violation, law, low, high, repeat", fixed.FINES)

FORM_FACTS_ELEMENTS = ",\n  ".join(
    f"coalesce(bool_or(collects_pd AND {contains_any('lower(coalesce(consent_text, ' + chr(39) * 2 + '))', words)}), FALSE) AS fe_{i}"
    for i, (_, words) in enumerate(fixed.CONSENT_ELEMENTS))
LOW_TEXT = "lower(coalesce(consent_text, ''))"

SITES_CTE = f"""{FORM_VALUES}, {FOOTER_SQL},
form_rows AS (
  SELECT {site('url')} AS site, url AS page_url, page_ord, form_ord, pd_categories, has_consent_checkbox AS box, consent_prechecked AS pre,
    consent_text, own_href IS NOT NULL OR page_link AS link, pd_categories <> '' AS collects_pd
  FROM crawl JOIN form_facts USING (f) JOIN feet USING (page_ord) WHERE {IS_HTML_SQL} AND NOT is_fallback),
form_sites AS (
  SELECT site, count(*) AS forms_count, count_if(collects_pd) AS pd, count_if(collects_pd AND NOT box) AS no_box,
    count_if(collects_pd AND box AND pre) AS prechecked, count_if(collects_pd AND NOT link) AS no_link,
    count_if(len(string_split(pd_categories, ',')) > 5) AS excessive,
    count_if(collects_pd AND NOT box AND coalesce(consent_text, '') = '') AS no_mechanism,
    coalesce(bool_or(collects_pd AND box AND {contains_any(LOW_TEXT, fixed.MARKETING_STEMS)}), FALSE) AS mixed,
    coalesce(bool_or(collects_pd AND {contains_any(LOW_TEXT, fixed.WITHDRAWAL_STEMS)}), FALSE) AS fw,
    {FORM_FACTS_ELEMENTS}
  FROM form_rows GROUP BY site),
script_sites AS (
  SELECT site, list(DISTINCT service_name) AS services, list(DISTINCT tracker) AS trackers
  FROM scripts WHERE page_ord NOT IN (SELECT page_ord FROM crawl WHERE is_fallback) GROUP BY site),
banner_sites AS (
  SELECT * FROM banners WHERE NOT is_fallback QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_ord) = 1),
page_sites AS (
  SELECT {site('url')} AS site, coalesce(arg_min(url, page_ord) FILTER (NOT is_fallback),
      arg_min(url, page_ord)) AS site_url, bool_or(url LIKE 'https%' AND NOT is_fallback) AS ssl,
    count_if(status_code BETWEEN 400 AND 499 AND NOT is_fallback) AS client_errors,
    count_if({IS_HTML_SQL} AND NOT is_fallback) AS main_pages,
    count_if({IS_HTML_SQL} AND NOT is_fallback AND NOT has_footer_link) AS main_without
  FROM crawl LEFT JOIN feet USING (page_ord) GROUP BY 1),
extra_pages AS (
  SELECT site, count(*) AS extra, count_if(NOT coalesce(has_footer_link, FALSE)) AS extra_without
  FROM candidates LEFT JOIN feet USING (page_ord) GROUP BY site HAVING bool_and(is_fallback)),
wide AS (
  SELECT p.site, p.site_url, p.ssl, p.client_errors, main_pages + coalesce(extra, 0) AS pages_scanned,
    main_without + coalesce(extra_without, 0) AS pages_without,
    coalesce(fs.forms_count, 0) AS forms_count, coalesce(fs.pd, 0) AS pd, coalesce(fs.no_box, 0) AS no_box, coalesce(fs.prechecked, 0) AS prechecked,
    coalesce(fs.no_link, 0) AS no_link, coalesce(fs.excessive, 0) AS excessive, coalesce(fs.no_mechanism, 0) AS no_mechanism,
    coalesce(fs.mixed, FALSE) AS mixed, coalesce(fs.fw, FALSE) OR coalesce(bp.has_withdrawal, FALSE) AS withdrawal,
    {', '.join(f'coalesce(fs.fe_{i}, FALSE) OR coalesce(bp.element_{i}, FALSE) AS el_{i}' for i in range(len(fixed.CONSENT_ELEMENTS)))},
    coalesce(ss.services, []) AS services, coalesce(ss.trackers, []) AS trackers,
    bs.site IS NOT NULL AS banner, coalesce(bs.has_accept, FALSE) AS has_accept, coalesce(bs.has_decline, FALSE) AS has_decline, coalesce(bs.has_settings, FALSE) AS has_settings,
    coalesce(bs.analytics_before_consent, FALSE) AS early,
    bp.site IS NOT NULL OR uo.site IS NOT NULL AS found, coalesce(bp.url, uo.policy_url) AS policy_url,
    coalesce(bp.text, '') <> '' AS has_text, bp.site IS NOT NULL AS separate,
    {', '.join(f'coalesce(bp.{n}, FALSE) AS {n}' for n in FLAG_NAMES)},
    {', '.join(f'coalesce(bp.names_{i}, FALSE) AS names_{i}' for i in range(len(fixed.TRACKERS)))},
    coalesce(bp.has_offer AND bp.has_consent_wording, FALSE) AS in_offer, coalesce(bp.discloses_transfer, FALSE) AS transfer,
    bp.text AS policy_text
  FROM page_sites p LEFT JOIN form_sites fs USING (site) LEFT JOIN script_sites ss USING (site)
    LEFT JOIN banner_sites bs USING (site) LEFT JOIN best bp USING (site) LEFT JOIN url_only uo USING (site)
    LEFT JOIN extra_pages e USING (site))"""


def verdict(ok: str, negative: str = "fail") -> str:
    return f"CASE WHEN {ok} THEN 'pass' ELSE '{negative}' END"


def _status_sql() -> dict[str, str]:
    def on_forms(expr):
        return f"CASE WHEN pd = 0 THEN 'not_applicable' ELSE {expr} END"

    def on_policy(expr):
        return f"CASE WHEN NOT found THEN 'not_applicable' ELSE {expr} END"

    def on_banner(expr):
        return f"CASE WHEN NOT banner THEN 'not_applicable' ELSE {expr} END"

    hidden = " OR ".join(f"(list_contains(trackers, {lit(t[0])}) AND NOT names_{i})" for i, t in enumerate(fixed.TRACKERS))
    foreign = " OR ".join(f"list_contains(trackers, {lit(t[0])})" for t in fixed.TRACKERS if t[3])
    out = {
        "FORM_001": on_forms(verdict("no_box = 0")), "FORM_002": on_forms(verdict("prechecked = 0")),
        "FORM_003": on_forms(verdict("no_link = 0")), "FORM_006": on_forms("'warning'"),
        "FORM_007": on_forms(verdict("excessive = 0", "warning")),
        "CONSENT_001": on_forms(verdict("no_mechanism = 0")), "CONSENT_002": on_forms(verdict("NOT in_offer")),
        "CONSENT_003": on_forms(verdict(" AND ".join(f"el_{i}" for i in range(len(fixed.CONSENT_ELEMENTS))))),
        "CONSENT_004": on_forms(verdict("withdrawal")), "CONSENT_005": on_forms(verdict("NOT mixed")),
        "COOKIE_001": verdict("banner"), "COOKIE_002": on_banner(verdict("has_decline")),
        "COOKIE_003": on_banner(verdict("has_settings", "warning")), "COOKIE_005": on_banner(verdict("NOT early")),
        "POLICY_001": verdict("found"), "POLICY_002": on_policy(verdict("pages_without = 0")),
    }
    for cid, name, _, _ in fixed.POLICY_FLAGS_RU:
        negative = "warning" if cid == "POLICY_012" else "fail"
        out[cid] = on_policy(f"CASE WHEN NOT has_text THEN 'manual_review_needed' ELSE {verdict(name, negative)} END")
    out["POLICY_017"] = on_policy(verdict("separate", "warning"))
    out["TECH_001"] = verdict("ssl")
    for cid, service, _ in fixed.SERVICE_CHECKS:
        out[cid] = verdict(f"NOT list_contains(services, {lit(service)})")
    out["TRACKER_001"] = f"CASE WHEN NOT found OR NOT has_text THEN 'not_applicable' ELSE {verdict('NOT (' + hidden + ')')} END"
    out["TRACKER_002"] = on_policy(verdict(f"NOT ({foreign}) OR transfer"))
    out |= {c: "'manual_check'" for c in ("REG_001", "REG_002", "REG_003")}
    return out


STATUS = _status_sql()
BASE = f"{crawl_cte()}, {CANDIDATES_CTE}, {URL_ONLY_CTE}, {SCRIPTS_CTE}, {BANNERS_CTE}, {SITES_CTE}"
CHECKS_CTE = BASE + ",\nchecks AS (SELECT site, c.i AS check_ord, c.id AS check_id, c.st AS status, c.n AS occurrences FROM (SELECT site, unnest([" + ",\n  ".join(
    "{'i': %d, 'id': '%s', 'st': %s, 'n': %s}" % (i, cid, sql, {"FORM_001": "no_box", "FORM_002": "prechecked"}.get(cid, "1"))
    for i, (cid, sql) in enumerate(STATUS.items())) + "]) AS c FROM wide))"


@page_plan
def sites(spark, sf):
    return site_ops.site_facts(facts(spark, sf))


def checks(spark, sf):
    return rules.site_checks(sites(spark, sf))


def _check_group(name: str, *prefixes: str):
    wanted = [c for c in STATUS if c.startswith(prefixes)]
    sql = f"WITH {CHECKS_CTE} SELECT site, check_id, status FROM checks WHERE check_id IN ({', '.join(map(lit, wanted))})"

    @query(name, sql)
    def run(spark, sf):
        return checks(spark, sf).filter(F.col("check_id").isin(wanted)).select("site", "check_id", "status")
    return run


_check_group("C01_C05_form_checks", "FORM")
_check_group("C06_C10_consent_checks", "CONSENT")
_check_group("C11_C12_cookie_checks", "COOKIE")
_check_group("C13_C16_policy_checks", "POLICY")
_check_group("C17_C18_technical_checks", "TECH")
_check_group("C19_C20_tracker_checks", "TRACKER")
_check_group("C21_regulatory_checks", "REG")


# -- the same checks with tables in place of the built-in registries -----------

MANY_CTE = f"""{values('many_services', 'service_ord, name, domain_ord, domain', [
    (i, name, j, d) for i, (name, _, domains) in enumerate(dimension_files.MANY_SERVICES) for j, d in enumerate(domains)])},
{values('many_trackers', 'tracker_ord, name, domain', [(i, t[0], d) for i, t in enumerate(dimension_files.MANY_TRACKERS) for d in t[1]])},
{values('many_words', 'tracker_ord, is_foreign, word', [(i, t[3], w) for i, t in enumerate(dimension_files.MANY_TRACKERS) for w in (t[2] or (None,))])},
own_hosts AS (SELECT DISTINCT site, domain FROM scripts WHERE page_ord NOT IN (SELECT page_ord FROM crawl WHERE is_fallback)),
named AS (SELECT o.site, o.domain, name, service_ord FROM own_hosts o JOIN many_services m ON contains(o.domain, m.domain)
  QUALIFY row_number() OVER (PARTITION BY o.site, o.domain ORDER BY service_ord, domain_ord) = 1),
tracked AS (SELECT DISTINCT o.site, tracker_ord, name FROM own_hosts o JOIN many_trackers m ON o.domain = m.domain OR ends_with(o.domain, '.' || m.domain)),
untold AS (SELECT t.*, NOT EXISTS (SELECT 1 FROM many_words k WHERE k.tracker_ord = t.tracker_ord AND contains(lower(w.policy_text), lower(k.word))) AS hidden,
  (SELECT bool_or(is_foreign) FROM many_words k WHERE k.tracker_ord = t.tracker_ord) AS is_foreign FROM tracked t JOIN wide w USING (site))"""


def loaded_audit(spark, sf):
    return audit_plan.audit(ct.crawl_table(spark, sf), services=dimension_files.many_services(spark), trackers=dimension_files.many_trackers(spark))


@query("C18_C20_loaded_registries", f"""WITH {BASE}, {MANY_CTE},
s AS (SELECT w.*, (SELECT count(*) FROM untold u WHERE u.site = w.site AND hidden) AS n_hidden,
  (SELECT count(*) FROM untold u WHERE u.site = w.site AND is_foreign) AS n_foreign FROM wide w)
SELECT s.site, c.check_id, CASE WHEN EXISTS (SELECT 1 FROM named n WHERE n.site = s.site AND n.name = c.service) THEN 'fail' ELSE 'pass' END AS status
FROM s, (VALUES {', '.join(f"({lit(cid)}, {lit(service)})" for cid, service, _ in fixed.SERVICE_CHECKS)}) AS c(check_id, service)
UNION ALL SELECT site, 'TRACKER_001', CASE WHEN NOT found OR NOT has_text THEN 'not_applicable' WHEN n_hidden = 0 THEN 'pass' ELSE 'fail' END FROM s
UNION ALL SELECT site, 'TRACKER_002', CASE WHEN NOT found THEN 'not_applicable' WHEN n_foreign = 0 OR (transfer AND has_text) THEN 'pass' ELSE 'fail' END FROM s""")
def c18_loaded(spark, sf):
    wanted = [cid for cid, *_ in fixed.SERVICE_CHECKS] + ["TRACKER_001", "TRACKER_002"]
    return rules.site_checks(loaded_audit(spark, sf).sites).filter(F.col("check_id").isin(wanted)).select("site", "check_id", "status")


@query("J1_J2_loaded_registry_names", f"""WITH {BASE}, {MANY_CTE}
SELECT site, coalesce((SELECT string_agg(name, '|' ORDER BY service_ord) FROM (SELECT DISTINCT name, service_ord FROM named n WHERE n.site = w.site)), '') AS services_used,
  coalesce((SELECT string_agg(name, '|' ORDER BY tracker_ord) FROM untold u WHERE u.site = w.site), '') AS trackers_used,
  coalesce((SELECT string_agg(name, '|' ORDER BY tracker_ord) FROM untold u WHERE u.site = w.site AND hidden), '') AS trackers_hidden,
  coalesce((SELECT string_agg(name, '|' ORDER BY tracker_ord) FROM untold u WHERE u.site = w.site AND is_foreign), '') AS trackers_foreign
FROM wide w""")
def j1_loaded(spark, sf):
    return loaded_audit(spark, sf).sites.select("site", *[F.array_join(c, "|").alias(c) for c in (
        "services_used", "trackers_used", "trackers_hidden", "trackers_foreign")])


@query("C12_browser_mode", f"""WITH {BASE}, banner_pages AS (SELECT site, page_ord FROM banners WHERE NOT is_fallback QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_ord) = 1)
SELECT site, CASE WHEN page_ord IS NULL THEN 'not_applicable' WHEN page_ord % 2 = 0 AND page_ord % 7 IN (1, 2, 3) THEN 'fail' ELSE 'pass' END AS status,
  (CASE WHEN hash_notes THEN 'limit of pages reached|timeout' ELSE '' END) AS notes
FROM (SELECT site, length(site) % 2 = 0 AS hash_notes FROM wide) LEFT JOIN banner_pages USING (site)""")
def c12_browser(spark, sf):
    """Half of the pages sent requests, three of seven of them to a tracker."""
    crawl = ct.crawl_table(spark, sf)
    log = crawl.filter("page_ord % 2 = 0").select("page_ord", F.col("url").alias("page_url"), F.explode(F.array(
        F.lit("https://static.example.net/a.js"), F.when(F.col("page_ord") % 7 == 1, "https://www.google-analytics.com/collect")
        .when(F.col("page_ord") % 7 == 2, "https://x.tawk.to/").when(F.col("page_ord") % 7 == 3, "https://mc.yandex.ru/watch")
        .otherwise("https://cdn.example.net/"))).alias("request_url"))
    sites = site_ops.fetched_urls(crawl).select("site").distinct().filter(F.length("site") % 2 == 0)
    notes = sites.select("site", F.explode(F.array(
        F.struct(F.lit(2).alias("note_ord"), F.lit("timeout").alias("note")),
        F.struct(F.lit(1).alias("note_ord"), F.lit("limit of pages reached").alias("note")))).alias("n")).select("site", "n.*")
    found = audit_plan.audit(crawl, request_log=log, notes=notes)
    early = rules.site_checks(found.sites).filter("check_id = 'COOKIE_005'").select("site", "status")
    own = found.sites.select("site", F.array_join("crawler_notes", "|").alias("notes"))
    return early.join(own, "site")


@query("A5_site_fold", f"""WITH {BASE}
SELECT site, site_url, pages_scanned, pages_without, client_errors, forms_count, pd, no_box, banner, found, policy_url FROM wide""")
def a5(spark, sf):
    return sites(spark, sf).select(
        "site", "site_url", "pages_scanned", F.col("pages_without_link").alias("pages_without"), "client_errors",
        F.col("forms_forms").alias("forms_count"), F.col("forms_pd").alias("pd"), F.col("forms_no_box").alias("no_box"),
        F.col("banner_found").alias("banner"), F.col("policy_found").alias("found"), "policy_url")


@query("P18_poor_scans", f"""WITH {BASE}
SELECT site, pages_scanned, client_errors, found AS policy_found FROM wide
WHERE pages_scanned = 0 OR client_errors > 0 OR NOT found""")
def p18(spark, sf):
    return site_ops.poor_scans(sites(spark, sf))


@query("J3_checks_with_checklist", f"""WITH {CHECKS_CTE}, {CHECKLIST}
SELECT site, check_id, status, coalesce(title, check_id) AS title, coalesce(severity, 'medium') AS severity, law AS law_reference
FROM checks LEFT JOIN checklist USING (check_id)""")
def j3(spark, sf):
    return scoring.enrich_checks(checks(spark, sf), dimension_files.checklist(spark)).select(
        "site", "check_id", "status", "title", "severity", "law_reference")


VIOLATIONS_CTE = f"""{CHECKS_CTE}, {CHECKLIST}, {FINES},
raw_violations AS (
  SELECT site, check_ord, check_id, 0 AS page_ord, 0 AS form_ord,
    CASE WHEN check_id IN ('CONSENT_001', 'CONSENT_002', 'CONSENT_003', 'CONSENT_004', 'CONSENT_005', 'COOKIE_001', 'COOKIE_002', 'COOKIE_005', 'POLICY_001', 'TECH_001') THEN site_url
         WHEN check_id LIKE 'TRACKER%' OR (check_id LIKE 'POLICY%' AND check_id <> 'POLICY_002') THEN policy_url END AS page_url
  FROM checks JOIN wide USING (site) WHERE status = 'fail' AND check_id NOT IN ('FORM_001', 'FORM_002')
  UNION ALL SELECT site, 0, 'FORM_001', page_ord, form_ord, page_url FROM form_rows WHERE collects_pd AND NOT box
  UNION ALL SELECT site, 1, 'FORM_002', page_ord, form_ord, page_url FROM form_rows WHERE collects_pd AND box AND pre),
violations AS (
  SELECT v.*, coalesce(severity, 'medium') AS severity, c.law AS law_reference, fine_id, low, high, advice,
    CASE WHEN severity IN ('critical', 'high') THEN format('{{:,}}', low) || ' – ' || format('{{:,}}', high) || ' руб.' END AS fine_range
  FROM raw_violations v LEFT JOIN checklist c USING (check_id) LEFT JOIN fines f USING (fine_id))"""


def violations(spark, sf):
    # site rows and form rows both come from the page facts: parse once
    return audit_plan.audit(ct.crawl_table(spark, sf), materialise=True).violations


@query("J4_violations_with_fines", f"""WITH {VIOLATIONS_CTE}
SELECT site, check_id, page_ord, form_ord, page_url, severity, law_reference, fine_range FROM violations""")
def j4(spark, sf):
    return violations(spark, sf).select(
        "site", "check_id", "page_ord", "form_ord", "page_url", "severity", "law_reference", "fine_range")


REPORTS_CTE = f"""{CHECKS_CTE}, {CHECKLIST}, {FINES},
priced AS (SELECT c.*, coalesce(severity, 'medium') AS severity, fine_id, low, high FROM checks c
  LEFT JOIN checklist USING (check_id) LEFT JOIN fines USING (fine_id)),
totals AS (
  SELECT site, count_if(status <> 'manual_review_needed') AS total_checks, count_if(status = 'pass') AS passed_checks,
    count_if(status = 'fail') AS failed_checks, count_if(status = 'warning') AS warnings,
    CAST(coalesce(sum(occurrences) FILTER (status = 'fail'), 0) AS BIGINT) AS violations,
    CAST(coalesce(sum(occurrences) FILTER (status = 'fail' AND severity = 'critical'), 0) AS BIGINT) AS critical_violations,
    CAST(coalesce(sum(occurrences) FILTER (status = 'fail' AND severity = 'high'), 0) AS BIGINT) AS high_violations
  FROM priced GROUP BY site),
once AS (SELECT site, fine_id, low, high, min(check_ord) AS seen FROM priced WHERE status = 'fail' GROUP BY ALL),
estimated AS (SELECT site, CAST(sum(low) AS BIGINT) AS fine_min, CAST(sum(high) AS BIGINT) AS fine_max,
  string_agg(fine_id, ',' ORDER BY seen) AS fine_ids FROM once GROUP BY site),
scored AS (SELECT t.*, CAST(CASE WHEN total_checks = 0 THEN 0 ELSE trunc(CAST(passed_checks AS DOUBLE) / total_checks * 100) END AS INT) AS overall_score,
  coalesce(fine_min, 0) AS fine_min, coalesce(fine_max, 0) AS fine_max, coalesce(fine_ids, '') AS fine_ids
  FROM totals t LEFT JOIN estimated USING (site)),
reports AS (SELECT *, CASE WHEN critical_violations >= 3 OR overall_score < 30 THEN 'critical'
  WHEN critical_violations >= 1 OR overall_score < 50 THEN 'high' WHEN overall_score < 75 THEN 'medium' ELSE 'low' END AS risk_level,
  'Обнаружено нарушений: ' || violations || ' (критических: ' || critical_violations || ', высокой серьёзности: ' || high_violations || '). Требуется детальная проверка.' AS summary
  FROM scored)"""


@page_plan
def reports(spark, sf):
    return audit_plan.reports(sites(spark, sf), dimension_files.checklist(spark), dimension_files.fines(spark))


@query("A1_A2_score_and_counts", f"""WITH {REPORTS_CTE}
SELECT site, total_checks, passed_checks, failed_checks, warnings, overall_score FROM reports""")
def a1(spark, sf):
    return reports(spark, sf).select(
        "site", "total_checks", "passed_checks", "failed_checks", "warnings", "overall_score")


@query("A3_risk_level", f"WITH {REPORTS_CTE} SELECT site, critical_violations, overall_score, risk_level FROM reports")
def a3(spark, sf):
    return reports(spark, sf).select("site", "critical_violations", "overall_score", "risk_level")


@query("A4_fine_estimate", f"WITH {REPORTS_CTE} SELECT site, fine_min, fine_max, fine_ids FROM reports")
def a4(spark, sf):
    return reports(spark, sf).select("site", "fine_min", "fine_max", F.array_join(
        F.transform("fine_breakdown", lambda x: x.getField("fine_id")), ",").alias("fine_ids"))


@query("A10_A15_summary", f"""WITH {REPORTS_CTE}
SELECT site, violations, critical_violations, high_violations, summary FROM reports""")
def a10(spark, sf):
    return reports(spark, sf).select("site", "violations", "critical_violations", "high_violations", "summary")


@query("A11_scan_limitations", f"""WITH {BASE}
SELECT site, array_to_string(list_filter([
  CASE WHEN pd = 0 THEN {lit(fixed.NOTE_NO_FORMS)} END, CASE WHEN pd = 0 THEN {lit(fixed.NOTE_NO_CHECKBOX)} END,
  CASE WHEN pd > 0 THEN {lit(fixed.NOTE_SPA_CHECKBOX)} END,
  CASE WHEN NOT banner OR NOT has_accept THEN {lit(fixed.NOTE_BANNER)} END,
  CASE WHEN found AND NOT has_text THEN {lit(fixed.NOTE_POLICY_UNREADABLE)} END], lambda x: x IS NOT NULL), '|') AS notes FROM wide""")
def a11(spark, sf):
    return sites(spark, sf).select("site", F.array_join(scoring.scan_limitations(), "|").alias("notes"))


@query("A9_summary_facts", f"""WITH {BASE},
banned AS (SELECT site, count(DISTINCT url) AS n FROM scripts WHERE service_name IS NOT NULL GROUP BY site)
SELECT site, pages_scanned, forms_count, no_box AS forms_without_consent, coalesce(n, 0) AS prohibited_scripts,
  CASE WHEN banner THEN 'обнаружен' ELSE 'не обнаружен' END AS cookie_banner_status,
  CASE WHEN found THEN 'найдена' ELSE 'не найдена' END AS privacy_policy_status,
  CASE WHEN ssl THEN 'да' ELSE 'нет' END AS https_status
FROM wide LEFT JOIN banned USING (site)""")
def a9(spark, sf):
    a = audit_plan.audit(ct.crawl_table(spark, sf), materialise=True)
    scripts = script_ops.mark_prohibited(script_ops.site_scripts(script_ops.scripts_of_facts(a.facts)))
    return scoring.summary_inputs(a.sites, scripts, scoring.violation_lines(a.violations, 15)).drop("site_url", "violations_summary")


@query("A9_first_violations_text", f"""WITH {VIOLATIONS_CTE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY check_ord, page_ord, form_ord) AS rank FROM violations)
SELECT site, count(*) AS lines, string_agg('[' || severity || ']', ',' ORDER BY rank) AS severities
FROM ranked WHERE rank <= 15 GROUP BY site""")
def a9_lines(spark, sf):
    lines = F.split("violations_summary", "\n")
    return scoring.violation_lines(violations(spark, sf), 15).select(
        "site", F.size(lines).cast("bigint").alias("lines"),
        F.array_join(F.transform(lines, lambda s: F.regexp_extract(s, r"^- (\[[a-z]+\])", 1)), ",").alias("severities"))


# -- serving ------------------------------------------------------------------

@query("A14_violation_groups", f"""WITH {VIOLATIONS_CTE},
p AS (SELECT site, check_id, page_url, count(*) AS n, min((check_ord, page_ord, form_ord)) AS seen FROM violations GROUP BY ALL)
SELECT site, check_id, CAST(sum(n) AS BIGINT) AS occurrences, count(page_url) AS pages,
  array_to_string(list_slice(list(page_url ORDER BY seen, page_url) FILTER (page_url IS NOT NULL), 1, 3), ' ') AS first_pages,
  greatest(count(page_url) - 3, 0) AS more_pages FROM p GROUP BY site, check_id""")
def a14(spark, sf):
    return serving.violation_groups(violations(spark, sf)).select(
        "site", "check_id", "occurrences", "pages", F.when(
            F.size("first_pages") > 0, F.array_join("first_pages", " ")).alias("first_pages"), "more_pages")


@query("A14_violation_totals", f"""WITH {VIOLATIONS_CTE}
SELECT site, count(DISTINCT check_id) AS types, count(*) AS occurrences FROM violations GROUP BY site""")
def a14_totals(spark, sf):
    return serving.violation_totals(serving.violation_groups(violations(spark, sf)))


@query("W10_critical_highlights", f"""WITH {VIOLATIONS_CTE},
g AS (SELECT site, check_id, min(check_ord) AS seen, count(*) - 1 AS repeats, any_value(fine_range) AS fine_range
  FROM violations WHERE severity = 'critical' GROUP BY site, check_id)
SELECT site, check_id, row_number() OVER (PARTITION BY site ORDER BY seen) AS rank, fine_range, repeats FROM g QUALIFY rank <= 5""")
def w10(spark, sf):
    return serving.critical_highlights(violations(spark, sf)).select("site", "check_id", "rank", "fine_range", "repeats")


@query("T6_severity_order", f"""WITH {VIOLATIONS_CTE}
SELECT site, check_id, page_ord, form_ord,
  CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 9 END AS severity_rank
FROM violations""")
def t6(spark, sf):
    return serving.by_severity(violations(spark, sf)).select(
        "site", "check_id", "page_ord", "form_ord", "severity_rank")


@query("T7_preview_top3", f"""WITH {VIOLATIONS_CTE},
g AS (SELECT site, check_id, severity, min(check_ord) AS seen FROM violations GROUP BY ALL)
SELECT site, check_id, severity, row_number() OVER (PARTITION BY site ORDER BY
  CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, seen) AS rank FROM g QUALIFY rank <= 3""")
def t7(spark, sf):
    return serving.preview(violations(spark, sf)).select("site", "check_id", "severity", "rank")


@query("T8_status_order", f"""WITH {CHECKS_CTE}
SELECT site, check_id, row_number() OVER (PARTITION BY site ORDER BY CASE status WHEN 'fail' THEN 0 WHEN 'not_applicable' THEN 1
  WHEN 'warning' THEN 2 WHEN 'manual_check' THEN 3 WHEN 'pass' THEN 4 ELSE 9 END, check_ord) AS position FROM checks""")
def t8(spark, sf):
    from pyspark.sql import Window
    order = Window.partitionBy("site").orderBy(serving.status_rank(F.col("status")), "check_ord")
    return checks(spark, sf).select("site", "check_id", F.row_number().over(order).alias("position"))


@query("T10_checks_by_category", f"""WITH {CHECKS_CTE}, {CHECKLIST}
SELECT site, check_id, status FROM checks JOIN checklist USING (check_id) WHERE category = 'privacy_policy'""")
def t10(spark, sf):
    wanted = dimensions.checks_by_category(dimension_files.checklist(spark), "privacy_policy").select(F.col("id").alias("check_id"))
    return checks(spark, sf).join(wanted, "check_id", "left_semi").select("site", "check_id", "status")


@query("D12_score_sentence", f"""WITH {REPORTS_CTE}
SELECT site, CASE WHEN overall_score >= 80 THEN {lit(fixed.SCORE_SENTENCES[0][1])} WHEN overall_score >= 60 THEN {lit(fixed.SCORE_SENTENCES[1][1])}
  WHEN overall_score >= 40 THEN {lit(fixed.SCORE_SENTENCES[2][1])} ELSE {lit(fixed.SCORE_SENTENCES[3][1])} END AS sentence FROM reports""")
def d12(spark, sf):
    return reports(spark, sf).select("site", serving.score_sentence(F.col("overall_score")).alias("sentence"))


# -- evaluation ---------------------------------------------------------------

STATUS_BY_ID = ("CASE doc_id % 6 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'warning' "
                "WHEN 3 THEN 'not_applicable' WHEN 4 THEN 'manual_review_needed' ELSE 'manual_check' END")
COMPARED_CTE = f"""s AS (SELECT doc_id, source, {STATUS_BY_ID} AS status FROM documents),
l AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS expected FROM labels),
c AS (SELECT doc_id, status, expected, status = expected AS strict,
  status = expected OR (status = 'warning' AND expected = 'fail') AS soft FROM s FULL JOIN l USING (doc_id))"""


def _compared(spark, sf):
    statuses = table(spark, sf, "documents").select("doc_id", F.expr(STATUS_BY_ID).alias("status"))
    labels = table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("expected"))
    return evaluation.compare_with_labels(statuses, labels, ["doc_id"])


@query("J17_golden_labels", f"WITH {COMPARED_CTE} SELECT doc_id, status, expected, strict, soft FROM c")
def j17(spark, sf):
    return _compared(spark, sf)


@query("A18_agreement", f"""WITH {COMPARED_CTE}
SELECT status, count(strict) AS labelled, count_if(strict) AS strict_matches, count_if(soft) AS soft_matches,
  count_if(strict) / count(strict) AS strict_rate, count_if(soft) / count(strict) AS soft_rate, count_if(NOT strict) AS misses FROM c GROUP BY status""")
def a18(spark, sf):
    return evaluation.agreement(_compared(spark, sf), "status")


@query("J17_run_to_run", f"""WITH b AS (SELECT doc_id, {STATUS_BY_ID} AS was FROM documents WHERE lang <> 'de'),
n AS (SELECT doc_id, {STATUS_BY_ID.replace('doc_id % 6', '(doc_id + n_chars) % 6')} AS now FROM documents WHERE lang <> 'fr')
SELECT doc_id, was, now, was IS DISTINCT FROM now AS changed FROM b FULL JOIN n USING (doc_id)""")
def j17_runs(spark, sf):
    docs = table(spark, sf, "documents")
    before = docs.filter("lang <> 'de'").select("doc_id", F.expr(STATUS_BY_ID).alias("status"))
    now = docs.filter("lang <> 'fr'").select(
        "doc_id", F.expr(STATUS_BY_ID.replace("doc_id % 6", "(doc_id + n_chars) % 6")).alias("status"))
    return evaluation.compare_runs(before, now, ["doc_id"])
