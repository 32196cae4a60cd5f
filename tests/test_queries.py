"""Registered queries against their SQL on small tables made here."""
import duckdb

from workload import all_queries, verify

QUERIES, ORACLE = all_queries()


def stored(spark, tmp_path, name, rows, schema):
    """A table as the driver stores it, and a DuckDB view of it."""
    path = str(tmp_path / f"{name}.parquet")
    spark.createDataFrame(rows, schema).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
    return con


def test_page_title_resolves_the_references_its_sql_resolves(spark, tmp_path):
    titles = ["a &quot;b&quot;", "R&amp;D", "&amp;lt;", "&#65;", " ", ""]
    rows = [(i, f"https://e.com/{i}", f"<html><head><title>{t}</title></head></html>") for i, t in enumerate(titles)]
    con = stored(spark, tmp_path, "pages", rows, "page_id long, url string, html string")
    difference, n = verify.compare(QUERIES["P7_page_title"](spark, str(tmp_path)), con, ORACLE["P7_page_title"])
    assert difference is None and n == len(titles)


def test_packages_are_made_by_many_tasks(spark):
    from pyspark.sql import functions as F

    from auditspan.operators import documents
    orgs = spark.range(0, 4000, 1, 1).select(F.concat(F.lit("org"), F.col("id").cast("string")).alias("id"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would join parts as small as these
    try:
        made = documents.package(orgs).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    rows = [r[1] for r in made]
    assert len(rows) > 1 and max(rows) < 2 * min(rows)


def test_indexes_of_pages_are_python_objects_a_slice_at_a_time(monkeypatch):
    import weakref

    import pyarrow as pa

    from auditspan.functions import page_elements

    class Index(dict):
        __hash__, __eq__ = object.__hash__, object.__eq__

    alive, counts, whole = weakref.WeakSet(), [], page_elements.elements_of

    def made(html):
        index = Index(whole(html))
        alive.add(index)
        counts.append(len(alive))
        return index

    monkeypatch.setattr(page_elements, "elements_of", made)
    html = ["<form><input name=a></form>", "<form><input name=b></form>"]
    out = page_elements._elements.func(pa.array(html * 300))
    assert [r["controls"][0]["name"] for r in out.to_pylist()] == ["a", "b"] * 300
    assert max(counts) < 200
    assert len(page_elements._elements.func(pa.array([], pa.string()))) == 0


def test_diffs_by_pairs_of_texts_equal_diffs_by_rows(spark):
    from datetime import datetime, timedelta

    from auditspan.operators import monitoring
    texts = ["a\nb", "", "a\nc", "a\nb"]
    rows = [(i, "s", f"u{i % 2}", texts[i * i % 7 % 4], "error" if i % 5 == 4 else "ok", datetime(2025, 1, 1) + timedelta(hours=7 * i))
            for i in range(24)]
    snapshots = monitoring.snapshot_rows(spark.createDataFrame(
        rows, "id long, source_id string, url string, text string, fetch_status string, captured_at timestamp"))
    history = monitoring.snapshot_history(snapshots)
    by_rows = monitoring.with_diff(monitoring.changed_snapshots(history, snapshots)).select("id", "diff").collect()
    by_pairs = monitoring.changed_diffs(history, snapshots).select("id", "diff").collect()
    assert sorted(by_pairs) == sorted(by_rows) and len(by_rows) > 5


def test_pages_go_to_python_in_batches_of_few_bytes(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from auditspan import schemas
    from auditspan.operators import pages
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    pages.page_facts(spark.createDataFrame([], schemas.CRAWL))

    @F.arrow_udf("long")
    def held(html: pa.Array) -> pa.Array:
        return pa.array([html.nbytes] * len(html), pa.int64())

    rows = spark.range(0, 200, 1, 1).select(held(F.repeat(F.col("id").cast("string"), 40_000)).alias("n"))
    assert rows.agg(F.max("n")).first()[0] < 3_000_000  # not the 20 MB of all


def test_plans_used_again_bound_the_batches_again(spark):
    from auditspan.session import PAGE_BATCH
    bound, tables = "spark.sql.execution.arrow.maxBytesPerBatch", "/root/testdata/sf0.001"
    for name in ("X3_forms", "C01_C05_form_checks", "A3_risk_level"):
        QUERIES[name](spark, tables)
        spark.conf.unset(bound)
        QUERIES[name](spark, tables)
        assert spark.conf.get(bound) == PAGE_BATCH, name


def test_registry_tables_meet_hosts_that_are_written_once(spark, tmp_path):
    from auditspan import schemas
    from auditspan.plans.audit import audit
    from workload import dimension_files
    spark.createDataFrame([], schemas.CRAWL).write.parquet(str(tmp_path / "crawl"))
    crawl = spark.read.schema(schemas.CRAWL).parquet(str(tmp_path / "crawl"))
    sites = audit(crawl, services=dimension_files.many_services(spark), trackers=dimension_files.many_trackers(spark)).sites
    plan = sites.select("site", "services_used", "trackers_used")._jdf.queryExecution().optimizedPlan().toString()
    reads = [line for line in plan.split("\n") if "Relation [" in line and "html#" in line]
    assert len(reads) == 3  # the sites, the policy of each, and its text
