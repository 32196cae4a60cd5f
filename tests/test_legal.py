from datetime import date

from pyspark.sql import functions as F

from auditspan import schemas
from auditspan.functions import replies
from auditspan.localtable import local_table
from auditspan.operators import documents, legal
from auditspan.sinks import tables
from auditspan.sources import dimensions


def ids(table):
    return {r.id[-3:] for r in table.collect()}


def test_active_updates(spark):
    updates = dimensions.legal_updates(spark)
    assert updates.count() == 8
    assert len(ids(legal.active(updates, date(2026, 1, 1)))) == 8
    assert ids(legal.active(updates, date(2025, 6, 1))) == {"005", "008"}
    assert ids(legal.active(updates, date(2025, 8, 15))) == {"001", "005", "008"}
    assert ids(legal.active(legal.for_document(updates, "privacy_policy"), date(2025, 8, 1))) == {"001"}
    assert ids(legal.active(updates, date(2025, 7, 1))) >= {"001"}  # the day itself counts


def test_context_is_newest_first(spark):
    rows = [("a", "2025-01-01", "2025-01-01", "S", None, "Old", "o", ["ст. 1"], ["t"], [], "high", "c"),
            ("b", "2025-01-01", "2025-03-01", "S", None, "New", "n", ["ст. 2", "ст. 3"], ["t"], ["r1", "r2"], "high", "c")]
    text = legal.legal_context(local_table(spark, rows, schemas.LEGAL_UPDATES)).first().legal_context
    assert text.endswith("Суть: o\n")
    assert ("### New\nВступило в силу: 2025-03-01\nИсточник: S\nСтатьи: ст. 2, ст. 3\nСуть: n\nТребования:\n  - r1\n  - r2\n\n### Old") in text


def test_new_updates(spark):
    found = spark.createDataFrame([(0, "S", "A"), (1, "S", "B"), (2, "S", "B"), (3, "R", "B")], "found_ord int, source string, title string")
    stored = spark.createDataFrame([("S", "A")], "source string, title string")
    assert {r.found_ord for r in legal.new_updates(found, stored).collect()} == {1, 3}


def test_update_rows_skip_invalid_items(spark):
    item = '{"id": "%s", "date": "d", "effective_date": "e", "source": "S", "title": "%s", "summary": "x"}'
    reply = "[" + ", ".join([item % ("", "A"), item % ("LU-1", "B"), item % ("LU-2", ""), '{"title": "C"}']) + "]"
    rows = replies.update_rows(spark.createDataFrame([(reply,)], "reply string"), F.lit(2025)).orderBy("item_ord").collect()
    assert [r.title for r in rows] == ["A", "B"] and rows[1].id == "LU-1" and rows[0].id.startswith("LU-2025-")
    assert rows[0].severity == "medium"


def org(spark, **values):
    base = {"id": "o", "legal_name": "ООО Ромашка", "website_url": "https://r.ru", "cross_border": False}
    row = {f.name: values.get(f.name, base.get(f.name)) for f in schemas.ORGANIZATIONS.fields}
    return local_table(spark, [tuple(row.values())], schemas.ORGANIZATIONS)


def filled(spark, template, **values):
    return org(spark, **values).select(documents.fill_template(F.lit(template), F.lit("01.01.2025")).alias("t")).first().t


def test_fill_template(spark):
    text = filled(spark, "{{LEGAL_NAME}} {{SHORT_NAME}} {{INN}} {{ORDER_DATE}} {{THIRD_PARTIES}} {{UPDATE_DATE}}", inn="77")
    assert text.endswith("ООО Ромашка ООО Ромашка 77 {{ORDER_DATE}} не передаются 01.01.2025") and text.startswith("> ⚠️")
    assert filled(spark, "{{CROSS_BORDER_INFO}}", cross_border=True, cross_border_countries=["FR", "DE"]).endswith("страны: FR, DE")
    assert filled(spark, "{{CROSS_BORDER_INFO}}", cross_border=True).endswith("передача персональных данных.")
    assert filled(spark, "{{CEO_POSITION}}|{{EMAIL}}|{{RESPONSIBLE_CONTACT}}", email="a@b").endswith("Генеральный директор|a@b|a@b")


def test_package_sizes(spark):
    assert documents.package(org(spark)).count() == 12
    assert documents.package(org(spark), public_only=True).count() == 3


def test_organizations_survive_storage(spark):
    row = documents.decode_organizations(documents.encode_organizations(org(spark, third_parties=["a", "b"], cross_border=True))).first()
    assert row.third_parties == ["a", "b"] and row.cross_border is True


def test_rewrite_results(spark):
    affected = spark.createDataFrame(
        [("o1", "t", "u", "U", "T", "old", 2), ("o2", "t", "u", "U", "T", "", 1), ("o3", "t", "u", "U", None, "x", 1)],
        "organization_id string, doc_type string, update_id string, update_title string, title string, content_md string, version int")
    contents = spark.createDataFrame([("o1", "t", "u", "new", None), ("o3", "t", "u", None, "timeout")],
                                     "organization_id string, doc_type string, update_id string, new_content string, error string")
    got = {r.organization_id: r for r in documents.rewrite_results(affected, contents, mode="auto").collect()}
    assert {k: v.status for k, v in got.items()} == {"o1": "updated", "o2": "skipped", "o3": "error"}
    assert (got["o1"].old_version, got["o1"].new_version) == (2, 3) and "-old" in got["o1"].diff and "Обновлённая версия" in got["o1"].diff
    assert got["o3"].error == "timeout" and got["o3"].doc_title == "t"


def test_upsert_takes_the_newest(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "id string, updated_at int, v string")
    new = spark.createDataFrame([("a", 1, "tie"), ("c", 1, "new"), ("b", 0, "stale")], "id string, updated_at int, v string")
    assert {r.id: r.v for r in tables.upserted(old, new).collect()} == {"a": "tie", "b": "x", "c": "new"}


def test_hits(spark):
    doc = spark.createDataFrame([(1, "u1", 0, "d", "c"), (1, "u2", 1, "d", "c")], "q int, url string, hit_ord int, title string, content string")
    general = spark.createDataFrame([(1, "u2", 0, "g", "c"), (1, "u3", 1, "g", "c")], doc.schema)
    merged = legal.merge_hits(doc, general, "q")
    assert {(r.url, r.list_ord) for r in merged.collect()} == {("u1", 0), ("u2", 0), ("u3", 1)}
    text = legal.numbered_hits(legal.top_hits(merged, {0: 1, 1: 5}, "q"), "q").first().results_text
    assert text.startswith("--- Результат 1 ---\nИсточник: u1\n") and "--- Результат 2 ---\nИсточник: u3" in text
