from urllib.parse import urljoin

from pyspark.sql import functions as F

from auditspan.functions import urls

BASES = ["https://www.Example.com/a/b/c?x=1#f", "http://e.com", "https://пример.рф:8080/путь/", "http://e.com/a//b/./c"]
LINKS = ["", "d", "/d/e", "../d", "../../../d", "./", "..", "?q=2", "#top", "#", "//cdn.net/x?y#z", "mailto:a@b.c",
         "javascript:void(0)", "https://o.org/p?q#r", "d/../e", "d e", "x;y?z", "/a//b", "tel:+7", "/./x/../y/"]


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "url string").select(expr(F.col("url")).alias("v")).first().v


def test_resolve_matches_the_standard_library(spark):
    rows = [(b, x) for b in BASES for x in LINKS]
    got = spark.createDataFrame(rows, "b string, x string").select(
        "b", "x", urls.resolve_url(F.col("b"), F.col("x")).alias("r")).collect()
    wrong = [(r.b, r.x, r.r, urljoin(r.b, r.x)) for r in got if r.r != urljoin(r.b, r.x)]
    assert wrong == []


def test_normalize(spark):
    cases = {"https://e.com/a/?q=1#x": "https://e.com/a", "https://e.com": "https://e.com/",
             "https://e.com//": "https://e.com/", "http://E.com:80/a;p=1": "http://E.com:80/a",
             "https://e.com/a b": "https://e.com/a b"}
    for url, expected in cases.items():
        assert one(spark, url, urls.normalize_url) == expected


def test_site_ignores_www_only(spark):
    assert one(spark, "https://WWW.e.com/x", urls.site_of) == "e.com"
    assert one(spark, "https://m.e.com/x", urls.site_of) == "m.e.com"


def test_skip_and_policy_bypass(spark):
    assert one(spark, "https://e.com/a.JPG?x", urls.is_skipped)
    assert not one(spark, "https://e.com/a.html", urls.is_skipped)
    assert not one(spark, "https://e.com/policy.pdf", lambda u: ~urls.is_crawlable(u))


def test_policy_page(spark):
    rows = [("https://e.com/privacy-policy", None, True), ("https://e.com/politika-konfidencialnosti", None, True),
            ("https://e.com/about", None, False), ("https://e.com/page", "ПОЛИТИКА обработки персональных данных", True),
            ("https://e.com/docs/1", "Данные компании", True), ("https://e.com/x/1", "Данные компании", False)]
    got = spark.createDataFrame(rows, "u string, t string, want boolean").select(
        "u", "want", urls.is_policy_page(F.col("u"), F.col("t")).alias("got")).collect()
    assert [r.u for r in got if r.got != r.want] == []


def test_default_scheme_priority_and_domains(spark):
    assert one(spark, "e.com", urls.with_default_scheme) == "https://e.com"
    for url, rank in (("https://e.com/politika", 4), ("https://e.com/policy", 3), ("https://e.com/privacy", 2),
                      ("https://e.com/personal", 1), ("https://policy.com/x", 0)):
        assert one(spark, url, urls.policy_url_priority) == rank
    assert one(spark, "https://login.consultant.ru/x", urls.is_allowed_domain)
    assert not one(spark, "https://e.com/consultant.ru", urls.is_allowed_domain)
