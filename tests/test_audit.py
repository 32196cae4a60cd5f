import pytest
from pyspark.sql import functions as F

from auditspan import schemas
from auditspan.functions import text as tx
from auditspan.knowledge import fixed_values as fixed
from auditspan.operators import policies, scoring, serving, sites
from auditspan.plans.audit import audit
from auditspan.sinks import tables
from auditspan.sources import dimensions

FILL = "Документ о работе общества с данными посетителей. " * 20
POLICY = "https://e.com/privacy"


def run(spark, *pages):
    rows = [(i, p.get("url", "https://e.com/"), p.get("status", 200), p.get("type", "text/html"), p.get("html", ""), [],
             p.get("pdf"), "pdfplumber" if "type" in p else None, p.get("fallback", False)) for i, p in enumerate(pages)]
    return audit(spark.createDataFrame(rows, schemas.CRAWL))


def statuses(spark, *pages):
    return {r.check_id: r.status for r in run(spark, *pages).checks.collect()}


def script(host):
    return {"html": f'<script src="https://{host}/x.js"></script>'}


def policy(text):
    return {"url": POLICY, "html": f"<p>{FILL}</p><p>{text}</p>"}


@pytest.mark.parametrize("text, host, one, two", [
    ("", "mc.yandex.ru", "fail", "pass"), ("Мы используем Яндекс.Метрика", "mc.yandex.ru", "pass", "pass"),
    ("", "cdn.example.com", "pass", "pass"), ("", "embed.tawk.to", "fail", "fail"),
    ("google analytics", "www.google-analytics.com", "pass", "fail"),
    ("google analytics, трансграничная передача", "www.google-analytics.com", "pass", "pass"),
    (None, "mc.yandex.ru", "not_applicable", "not_applicable")])
def test_trackers(spark, text, host, one, two):
    got = statuses(spark, script(host), *([policy(text)] if text is not None else []))
    assert (got["TRACKER_001"], got["TRACKER_002"]) == (one, two)


def test_unreadable_policy(spark):
    got = statuses(spark, {"html": ""}, {"url": "https://e.com/policy.pdf", "type": "application/pdf", "pdf": None})
    assert len(got) == 42 and got["POLICY_001"] == "pass" and got["TRACKER_001"] == "not_applicable"
    assert {got[f"POLICY_{i:03d}"] for i in range(3, 17)} == {"manual_review_needed"}


def test_policy_known_by_url_of_an_error(spark):
    a = run(spark, {"html": ""}, {"url": "https://e.com/policy", "status": 404})
    row = a.sites.first()
    assert row.policy_found and row.policy_url == "https://e.com/policy" and not row.policy_has_text


def test_failed_probe_of_a_well_known_path_says_nothing(spark):
    probe = {"url": "https://e.com/privacy-policy", "status": 404, "fallback": True}
    row = run(spark, {"html": ""}, {"url": "https://e.com/gone", "status": 404}, probe).sites.first()
    assert not row.policy_found and row.client_errors == 1
    for status in (404, 500):
        found = run(spark, {"html": ""}, {**policy(""), "url": "https://e.com/privacy-policy", "status": status, "fallback": True})
        assert not found.sites.first().policy_found
        assert found.checks.filter("check_id = 'POLICY_001'").first().status == "fail"
    assert run(spark, {"html": ""}, {**policy(""), "url": "https://e.com/privacy-policy", "fallback": True}).sites.first().policy_found


def test_cookies_of_pages_that_were_read(spark):
    rows = [(0, "https://e.com/a", 404, "text/html", ["gone"], False), (1, "https://e.com/b.pdf", 200, "application/pdf", ["file"], False),
            (2, "https://e.com/c", 200, "text/plain", ["plain"], False), (3, "https://e.com/d", 200, "text/html", ["probe"], True),
            (4, "https://e.com/e", 200, "text/html", ["own"], None)]
    crawl = spark.createDataFrame(rows, "page_ord long, url string, status_code int, content_type string, cookies array<string>, is_fallback boolean")
    assert [r.name for r in sites.site_cookies(crawl).collect()] == ["own"]


def test_markers_after_a_very_long_text(spark):
    far = policy("слово " * 40_000 + "трансграничная передача, google analytics")
    got = statuses(spark, script("www.google-analytics.com"), far)
    assert (got["TRACKER_001"], got["TRACKER_002"]) == ("pass", "pass")


def test_invalid_candidate_blocks_fallback_documents(spark):
    short = {"url": POLICY, "html": "<p>Кратко</p>"}
    extra = {**policy(""), "url": "https://e.com/legal/privacy", "fallback": True}
    assert not run(spark, short, extra).sites.first().policy_found
    alone = run(spark, {"html": ""}, extra).sites.first()
    assert alone.policy_found and alone.pages_scanned == 2


def test_consent_rules(spark):
    bare = '<form><input name="email"></form>'
    boxed = '<form><input name="email"><label><input type="checkbox"> Согласие на обработку</label></form>'
    assert statuses(spark, {"html": bare})["CONSENT_001"] == "fail"
    assert statuses(spark, {"html": boxed})["CONSENT_001"] == "pass"
    none = statuses(spark, {"html": "<p>x</p>"})
    assert {none[f"CONSENT_00{i}"] for i in range(1, 6)} == {"not_applicable"}
    offer = policy("Публичная оферта. Даю согласие на обработку.")
    assert statuses(spark, {"html": boxed}, offer)["CONSENT_002"] == "fail"


def test_one_violation_per_offending_form(spark):
    a = run(spark, *[{"url": f"https://e.com/{i}", "html": '<form><input name="email"></form>' * 2} for i in range(3)])
    ids = [r.check_id for r in a.violations.collect()]
    assert ids.count("FORM_001") == 6 and ids.count("FORM_003") == 1
    report = a.reports.first()
    assert report.violations == len(ids)
    groups = {r.check_id: r for r in serving.violation_groups(a.violations).collect()}
    assert (groups["FORM_001"].occurrences, groups["FORM_001"].pages, groups["FORM_001"].more_pages) == (6, 3, 0)
    assert groups["FORM_001"].first_pages == ["https://e.com/0", "https://e.com/1", "https://e.com/2"]


def fold(spark, statuses_):
    rows = [("s", i, cid, st, int(st == "fail")) for i, (cid, st) in enumerate(statuses_)]
    outcomes = spark.createDataFrame(rows, "site string, check_ord int, check_id string, status string, occurrences bigint")
    priced = scoring.price_outcomes(outcomes, dimensions.checklist(spark), dimensions.fines(spark))
    return scoring.fold_outcomes(priced, "site").first()


def test_score_excludes_only_manual_review(spark):
    row = fold(spark, [(f"X{i}", "pass") for i in range(5)] + [("Y1", "fail"), ("Y2", "fail")]
               + [(f"Z{i}", "manual_review_needed") for i in range(3)])
    assert (row.total_checks, row.overall_score) == (7, 71)


@pytest.mark.parametrize("passed, total, score", [(9, 42, 21), (11, 28, 39), (20, 42, 47), (9, 35, 25), (29, 50, 57)])
def test_score_is_truncated(spark, passed, total, score):
    assert spark.range(1).select(scoring.score(F.lit(passed), F.lit(total)).alias("s")).first().s == score


def test_fines_once_per_kind_in_first_seen_order(spark):
    row = fold(spark, [("FORM_001", "fail"), ("COOKIE_001", "fail"), ("TECH_003", "fail"), ("FORM_002", "fail")])
    assert (row.fine_min, row.fine_max) == (1450000, 7000000)
    assert [x.fine_id for x in row.fine_breakdown] == ["FS-003", "FS-008", "FS-007"]
    assert row.risk_level == "critical"


def test_dimensions(spark):
    assert dimensions.checklist(spark).count() == 47
    assert dimensions.fines(spark).count() == 10
    assert dimensions.prohibited_services(spark).select("name").distinct().count() == 12
    assert dimensions.trackers(spark).count() == 13
    assert dimensions.document_types(spark).count() == 12
    assert dimensions.document_types(spark, public_only=True).count() == 3


def test_dimension_files(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"name": "B", "domains": ["B.com"]}, {"name": "A", "domains": ["a.com", "b.com"]}]')
    rows = dimensions.prohibited_services(spark, str(tmp_path / "s.json")).orderBy("service_ord", "domain_ord").collect()
    assert [(r.name, r.domain) for r in rows] == [("B", "b.com"), ("A", "a.com"), ("A", "b.com")]
    assert dimensions.legal_updates(spark, str(tmp_path / "missing.json")).count() == 0
    (tmp_path / "w.json").write_text('{"competitors": [{"id": "c", "name": "C", "urls": ["u1", "u2"]}],'
                                     '"npa_sources": [{"id": "n", "name": "N", "url": "u3", "keywords": ["x"]}]}')
    got = dimensions.watched_sources(spark, str(tmp_path / "w.json")).orderBy("url").collect()
    assert [(r.source_id, r.kind, r.llm_analyze, r.source_type) for r in got] == [
        ("c", "competitor", True, None), ("c", "competitor", True, None), ("n", "npa", True, "html_hash")]
    (tmp_path / "privacy_policy.md").write_text("{{LEGAL_NAME}}")
    types = dimensions.templates_for_types(dimensions.document_types(spark), dimensions.templates(spark, str(tmp_path)))
    texts = {r.doc_type: r.template for r in types.collect()}
    assert texts["privacy_policy"] == "{{LEGAL_NAME}}"
    assert texts["consent_form"].startswith("Шаблон consent_form.md не найден")
    assert texts["employee_consent"].startswith("Шаблон отсутствует")


def test_cyrillic(spark):
    cases = {"Политика обработки данных. " * 5: True, "": False, "Privacy policy text " * 5: False, "привет мир": False,
             "персональныеданныеобработка" * 10: True}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tx.is_cyrillic_text(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in rows} == cases


@pytest.mark.parametrize("flag, sentence, expected", [
    ("has_legal_basis", "на основании договора", True), ("has_legal_basis", "основания нет", False),
    ("has_rights_procedure", "в течение 10 рабочих дней", True), ("has_rights_procedure", "порядок описан", False),
    ("has_rights_procedure", "требования уточнения данных", True), ("has_security_measures", "применяется шифрование", True),
    ("has_security_measures", "режим\nзащиты", False), ("has_operator_name", "ооо ромашка", False),
    ("has_operator_name", "ООО Ромашка", True), ("has_inn_ogrn", "ИНН: 7701234567", True)])
def test_content_flags(spark, flag, sentence, expected):
    text = "слово " * 5000 + sentence  # far beyond 20 000 characters
    got = spark.createDataFrame([(text,)], "t string").select(tx.content_flags(F.col("t"))[flag].alias("f")).first().f
    assert got is expected


def test_best_policy_prefers_valid_then_long_then_url(spark):
    rows = [("s", 0, "https://e.com/policy", 8000, False), ("s", 1, "https://e.com/privacy", 600, True),
            ("s", 2, "https://e.com/politika", 600, True), ("t", 0, "https://t.com/a", 18, True), ("t", 1, "https://t.com/b", 5000, True)]
    table = spark.createDataFrame(rows, "site string, page_ord bigint, url string, n int, ru boolean").select(
        "site", "page_ord", "url", F.lit(False).alias("is_fallback"), F.struct(
            "url", "page_ord", F.col("n").alias("content_length"), F.col("ru").alias("is_russian")).alias("policy"))
    got = {r.site: r.url for r in policies.best_policies(table).collect()}
    assert got == {"s": "https://e.com/politika", "t": "https://t.com/b"}


def test_preview_orders(spark):
    rows = [("s", 0, 0, 0, "A", "high"), ("s", 1, 0, 0, "B", "critical"), ("s", 2, 0, 0, "C", "low")]
    v = spark.createDataFrame(rows, "site string, check_ord int, page_ord int, form_ord int, check_id string, severity string").withColumns(
        {"title": F.lit("t"), "fine_range": F.lit(None).cast("string")})
    assert [r.check_id for r in serving.preview(v).orderBy("rank").collect()] == ["B", "A", "C"]
    assert [r.check_id for r in serving.preview(v, critical_last=True).orderBy("rank").collect()] == ["A", "C", "B"]


def stored(spark, rows):
    return spark.createDataFrame(rows, "id string, v string, updated_at int")


def test_upserts_rewrite_only_touched_buckets(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = [(f"k{i}", "old", 1) for i in range(200)] + [(None, "null", 1)]
    tables.create_keyed(stored(spark, rows), root, buckets=16)
    changed = [("k7", "new", 2), ("k8", "stale", 0), ("fresh", "new", 2), (None, "newer", 3), ("k7", "twice", 1)]
    assert tables.merge_keyed(stored(spark, changed), root) == 2
    want = {r[0]: r[1] for r in rows} | {"k7": "new", "fresh": "new", None: "newer"}
    assert {r.id: r.v for r in tables.read_keyed(spark, root).collect()} == want
    assert {r.id: r.v for r in tables.read_keyed(spark, root, 1).collect()} == {r[0]: r[1] for r in rows}
    first, second = ({e.bucket: e.folder for e in tables._manifest(spark, root, v)} for v in (1, 2))
    moved = {b for b in second if second[b] != first.get(b)}
    assert 1 <= len(moved) <= 4 and len(second) >= 16
    assert tables.merge_keyed(stored(spark, []), root) == 3 and tables.read_keyed(spark, root).count() == 202


def test_a_failed_upsert_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.create_keyed(stored(spark, [(f"k{i}", "old", 1) for i in range(50)]), root, buckets=4)
    broken = stored(spark, [(f"k{i}", "new", 2) for i in range(50)]).withColumn(
        "v", F.when(F.col("id") == "k33", F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    reader = tables.read_keyed(spark, root)
    with pytest.raises(Exception, match="lost"):
        tables.merge_keyed(broken, root)
    assert {r.v for r in tables.read_keyed(spark, root).collect()} == {"old"} and reader.count() == 50
    # data that was written without its manifest, as by a driver that is lost in between
    stored(spark, [("x", "ghost", 9)]).write.parquet(f"{root}/data/commit=ghost/_bucket=0")
    assert tables.read_keyed(spark, root).count() == 50
    assert tables.merge_keyed(stored(spark, [("k1", "new", 2)]), root) == 2
    assert sorted({r.v for r in tables.read_keyed(spark, root).collect()}) == ["new", "old"]
    # a reader that began before the upsert still reads the files of its version
    assert {r.v for r in reader.collect()} == {"old"}


def test_empty_keyed_table(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.create_keyed(stored(spark, []), root)
    assert tables.read_keyed(spark, root).count() == 0
    tables.merge_keyed(stored(spark, [("a", "x", 1)]), root)
    assert [r.v for r in tables.read_keyed(spark, root).collect()] == ["x"]
    with pytest.raises(Exception):
        tables.create_keyed(stored(spark, []), root)


def test_report_needs_one_exchange_of_page_rows(spark):
    plan = run(spark, {"html": ""}).reports._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(site") == 1
    assert plan.count("ArrowEvalPython") == 1
    assert "CartesianProduct" not in plan


def test_probes_go_to_sites_without_a_candidate(spark):
    from auditspan.operators import pages as page_ops
    from auditspan.operators import sites as site_ops
    text = "<title>Политика</title><p>" + "Политика персональных данных. " * 40 + "</p>"

    def row(url, order, html="<p>x</p>", probe=False, status=200):
        return (order, url, status, "text/html", html, [], None, None, probe)
    crawl = spark.createDataFrame([
        row("https://has.com/privacy", 1, text), row("https://none.com/", 1), row("https://none.com/legal/privacy/", 2, status=404),
        row("https://www.tried.com/", 1), row("https://www.tried.com/privacy", 2, status=404, probe=True)], schemas.CRAWL)
    found = site_ops.probe_frontier(crawl, page_ops.policy_candidates(crawl)).collect()
    by_site = {}
    for r in sorted(found, key=lambda r: r.page_ord):
        by_site.setdefault(r.site, []).append(r.url)
    assert by_site["none.com"] == [f"https://none.com{p}" for p in fixed.WELL_KNOWN_POLICY_PATHS if p != "/legal/privacy"]
    assert by_site["tried.com"] == [f"https://www.tried.com{p}" for p in fixed.WELL_KNOWN_POLICY_PATHS if p != "/privacy"]
    assert set(by_site) == {"none.com", "tried.com"}
    answers = crawl.filter("url like '%has.com%'").withColumns({"url": F.lit("https://none.com/personal-data"), "page_ord": F.lit(14)})
    from auditspan.operators import policies as policy_ops
    best = policy_ops.best_policies(page_ops.policy_candidates(site_ops.with_probes(crawl, answers)))
    assert {r.site: r.url for r in best.collect()} == {"has.com": "https://has.com/privacy", "none.com": "https://none.com/personal-data"}


def test_registry_tables_log_and_notes_reach_the_checks(spark):
    html = ('<head><script src="https://a.counter.test/x.js"></script></head><div id=cookie-banner><button>ok</button></div>'
            "<footer><a href=/privacy>Политика</a></footer>")
    policy = "<title>Политика</title><p>" + "Политика персональных данных, Счётчик Б. " * 40 + "</p>"
    crawl = spark.createDataFrame([
        (1, "https://s.com/", 200, "text/html", html, [], None, None, False),
        (2, "https://s.com/privacy", 200, "text/html", policy, [], None, None, False)], schemas.CRAWL)
    services = spark.createDataFrame([("Segment", "FS", 0, 0, "counter.test")], "name string, fine_reference string, service_ord long, domain_ord int, domain string")
    trackers = spark.createDataFrame(
        [(0, "А", ["counter.test"], ["счётчик а"], True), (1, "Б", ["a.counter.test"], ["Счётчик Б"], False), (2, "В", ["test"], [], True)],
        "tracker_ord int, name string, domains array<string>, keywords array<string>, is_foreign boolean")
    log = spark.createDataFrame([(1, "https://s.com/", "https://b.counter.test/hit")], "page_ord long, page_url string, request_url string")
    notes = spark.createDataFrame([("s.com", 2, "second"), ("s.com", 1, "first")], "site string, note_ord int, note string")
    plain, loaded = audit(crawl), audit(crawl, services=services, trackers=trackers, request_log=log, notes=notes)
    row = loaded.sites.first()
    assert (row.services_used, row.trackers_used, row.trackers_hidden, row.trackers_foreign) == (["Segment"], ["А", "Б", "В"], ["А", "В"], ["А", "В"])

    def status(a):
        return {r.check_id: r.status for r in a.checks.collect()}
    before, after = status(plain), status(loaded)
    changed = {c for c in before if before[c] != after[c]}
    assert changed == {"COOKIE_005", "TRACKER_001", "TRACKER_002", *[c for c, s, _ in fixed.SERVICE_CHECKS if s == "Segment"]}
    assert all(after[c] == "fail" for c in changed)
    assert loaded.reports.first().scan_limitations[:2] == ["first", "second"]
    none = spark.createDataFrame([], trackers.schema)
    assert audit(crawl, trackers=none, request_log=log.limit(0)).sites.first().trackers_used == []


def test_equal_resources_of_a_page_are_found_in_linear_time(spark):
    import time
    from auditspan.operators import scripts as script_ops
    html = "<head>" + "".join(f"<script src=https://h{i % 5000}.com/a.js></script>" for i in range(15_000)) + "</head>"
    crawl = spark.createDataFrame([(1, "https://s.com/", 200, "text/html", html, [], None, None, False)], schemas.CRAWL)
    started = time.perf_counter()
    rows = script_ops.page_scripts(crawl).orderBy("script_ord").collect()
    assert [r.domain for r in rows] == [f"h{i}.com" for i in range(5000)] and time.perf_counter() - started < 30
