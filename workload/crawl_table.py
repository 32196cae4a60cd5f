"""A crawl table derived from the given ``pages``.

The raw pages hold no forms, scripts or banners, so every page gets fragments
chosen by its id.  The derivation is one SELECT that Spark and DuckDB both run;
what the fragments mean is stated next to them (``*_FACTS``) and is what the
oracle SQL uses instead of parsing HTML.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.registry import plan_once

SCRIPTS = {
    0: "",
    1: '<script src="https://www.google-analytics.com/ga.js?p=#"></script><script src="/local.js"></script>',
    2: '<script async src="https://www.googletagmanager.com/gtm.js?id=G1"></script>'
       '<link rel="stylesheet" href="https://fonts.googleapis.com/css2?family=Roboto">',
    3: '<script src="//mc.yandex.ru/metrika/tag.js"></script><link rel="preconnect" href="https://fonts.gstatic.com">',
    4: '<iframe src="https://www.google.com/maps?q=#"></iframe><script src="https://not-google-analytics.com/x.js"></script>',
    5: '<img src="https://pixel.facebook.com/p.gif" width="1px" height="1">'
       '<img src="https://img.example.com/banner.png" width="300" height="250">'
       '<script src="../assets/app.js"></script>',
    6: '<script src="https://embed.tawk.to/abc/default"></script>'
       '<link rel="stylesheet" href="https://connect.facebook.net/en/events.js">'
       '<script src="https://connect.facebook.net/en/events.js"></script>'
       '<script src="https://consent.cookiebot.com/uc.js"></script>',
}
# key, script_ord, kind, url ("=" stands for the page's scheme), domain, service, tracker
SCRIPT_FACTS = [
    (1, 0, "js", "https://www.google-analytics.com/ga.js?p=#", "www.google-analytics.com", "Google Analytics", "Google Analytics"),
    (2, 0, "js", "https://www.googletagmanager.com/gtm.js?id=G1", "www.googletagmanager.com", "Google Tag Manager", "Google Tag Manager"),
    (2, 1, "css", "https://fonts.googleapis.com/css2?family=Roboto", "fonts.googleapis.com", "Google Fonts", None),
    (3, 0, "js", "=://mc.yandex.ru/metrika/tag.js", "mc.yandex.ru", None, "Яндекс.Метрика"),
    (3, 1, "font", "https://fonts.gstatic.com", "fonts.gstatic.com", "Google Fonts", None),
    (4, 0, "js", "https://not-google-analytics.com/x.js", "not-google-analytics.com", "Google Analytics", None),
    (4, 1, "iframe", "https://www.google.com/maps?q=#", "www.google.com", None, None),
    (5, 0, "pixel", "https://pixel.facebook.com/p.gif", "pixel.facebook.com", "Facebook Pixel", "Meta Pixel"),
    (6, 0, "js", "https://embed.tawk.to/abc/default", "embed.tawk.to", None, "Tawk.to"),
    (6, 1, "js", "https://connect.facebook.net/en/events.js", "connect.facebook.net", "Facebook Pixel", "Meta Pixel"),
    (6, 2, "js", "https://consent.cookiebot.com/uc.js", "consent.cookiebot.com", None, None),
]

BANNERS = {
    0: "", 1: "",
    2: '<div id="cookie-banner"><button>Принять</button><button>Отклонить</button>'
       '<a href="/privacy/cookies">Подробнее</a></div>',
    3: '<div class="popup cky-consent-container"><button>OK</button><input type="button" value="Настройки"></div>',
    4: '<section class="cc-window"><a href="#">Accept all</a><a href="/legal/terms">Terms</a></section>',
}
# key, accept, decline, settings, policy link, privacy href
BANNER_FACTS = [
    (2, True, True, True, True, "/privacy/cookies"),
    (3, True, False, True, False, None),
    (4, True, False, False, True, "/legal/terms"),
]

_AGREE = "Согласие на обработку персональных данных, цели и срок"
FORMS = {
    0: "",
    1: '<form action="/send" method="post"><input type="text" name="firstname"><input type="email" name="email" required>'
       f'<input type="hidden" name="t" value="1"><label><input type="checkbox" name="agree"> {_AGREE}</label>'
       '<input type="submit"></form>',
    2: '<form><input name="phone" placeholder="Телефон"><input type="checkbox" id="cb2" checked>'
       '<label for="cb2">Даю согласие на рассылку</label><a href="/privacy">Политика</a></form>',
    3: '<form><input name="fio"><input name="email1"><input name="email2"><textarea name="address"></textarea>'
       '<select name="city"><option>1</option></select><input name="passport"><input name="birth"><input name="phone"></form>',
    4: '<form><input type="search" name="q"></form>',
    5: '<form><input name="email"><p><input type="checkbox" name="c"> I consent</p></form><form><input name="email"></form>',
}
# key, form_ord, method, fields, categories, checkbox, prechecked, consent text, own privacy href
FORM_FACTS = [
    (1, 0, "POST", "firstname,email,agree", "name,email", True, False, f"{_AGREE} {_AGREE}", None),
    (2, 0, "GET", "phone,", "phone", True, True, "Даю согласие на рассылку Даю согласие на рассылку", "/privacy"),
    (3, 0, "GET", "fio,email1,email2,address,city,passport,birth,phone",
     "name,email,address,passport,birthday,phone", False, False, None, None),
    (4, 0, "GET", "q", "", False, False, None, None),
    (5, 0, "GET", "email,c", "email", True, False, "I consent I consent", None),
    (5, 1, "GET", "email", "email", False, False, None, None),
]

_FILL = "Настоящий документ описывает работу общества с данными посетителей и клиентов. " * 8
POLICIES = {
    0: "<h1>Политика</h1><p>ООО Ромашка, ИНН: 7701234567.</p><p>Ответственный за обработку: тел. 8 800 555 35 35.</p>"
       "<p>Категории данных: имя, телефон. Цели обработки заявок.</p><p>Правовые основания. Срок хранения 3 года.</p>"
       "<p>Права субъектов. Порядок обращения: 10 рабочих дней, направить запрос.</p>"
       "<p>Трансграничная передача есть. Меры защиты, шифрование. Файлы cookie, Яндекс.Метрика и google analytics.</p>"
       f"<p>Серверы на территории Российской Федерации. Дата: 01.09.2025. Отзыв согласия возможен.</p><p>{_FILL}</p>",
    1: "<h1>Публичная оферта</h1><p>ООО Лютик. Даю согласие на обработку.</p><p>Срок хранения не указан.</p>"
       f"<p>{_FILL}</p><p>Сервисы: facebook и gtm.</p>",
    2: "<p>Краткий документ о персональных данных посетителей сайта.</p>",
    3: "<p>" + "Privacy terms apply to visitors of the site. " * 20 + "</p>",
}
_PLAIN_PAGE = ('<!DOCTYPE html><html><head><title>Документ</title><style>p b</style></head><body><nav><ul>'
               '<li><a href="/x">x</a></li></ul></nav><article>%s</article><footer>2025</footer></body></html>')


def _case(key: str, values: dict, wrap=lambda v: v) -> str:
    def literal(v: str) -> str:
        pieces = v.split("#") if "p=#" in v or "q=#" in v else [v]
        return " || CAST(page_id % 10 AS STRING) || ".join("'" + p + "'" for p in pieces)
    arms = " ".join(f"WHEN {k} THEN {literal(wrap(v))}" for k, v in values.items())
    return f"CASE {key} {arms} END"


def _pdf_text(html: str) -> str:
    import re
    return re.sub(r"\s*(<[^>]+>\s*)+", " ", html).strip()


IS_POLICY_PAGE_ROW = "page_id % 11 IN (4, 7)"
CRAWL_SELECT = f"""
SELECT page_id AS page_ord, url, status_code, content_type,
  CASE WHEN page_id % 3 = 0 THEN
    replace(html, '</footer>', '<a href="/privacy-policy">Политика конфиденциальности</a></footer>')
  ELSE html END AS html,
  cookies_csv, pdf_text, pdf_method, is_fallback,
  page_id % 7 AS s, page_id % 5 AS b, page_id % 6 AS f
FROM (
  SELECT page_id,
    CASE WHEN page_id % 11 = 4 THEN regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/privacy-policy'
         WHEN page_id % 11 = 7 THEN regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/politika/'
         WHEN page_id % 11 = 9 THEN regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/docs/policy-' || CAST(page_id AS STRING) || '.pdf'
         ELSE url END AS url,
    CAST(CASE WHEN page_id % 13 = 5 OR (page_id % 19 = 6 AND page_id % 2 = 0 AND {IS_POLICY_PAGE_ROW}) THEN 404 ELSE 200 END AS INT) AS status_code,
    CASE WHEN page_id % 11 = 9 THEN 'application/pdf'
         WHEN page_id % 17 = 8 THEN 'text/plain' ELSE 'text/html; charset=utf-8' END AS content_type,
    replace(replace(replace(
      CASE WHEN {IS_POLICY_PAGE_ROW} THEN {_case('page_id % 4', POLICIES, lambda p: _PLAIN_PAGE % p)} ELSE html END,
      '</head>', {_case('page_id % 7', SCRIPTS)} || '</head>'),
      '<nav>', {_case('page_id % 5', BANNERS)} || '<nav>'),
      '<footer>', {_case('page_id % 6', FORMS)} || '<footer>') AS html,
    CASE page_id % 3 WHEN 0 THEN 'sid' WHEN 1 THEN 'sid,uid' || CAST(page_id % 4 AS STRING) ELSE '' END AS cookies_csv,
    CASE WHEN page_id % 11 = 9 THEN {_case('page_id % 4', {0: _pdf_text(POLICIES[0]), 1: _pdf_text(POLICIES[1])})} END AS pdf_text,
    CASE WHEN page_id % 11 = 9 THEN CASE WHEN page_id % 4 IN (0, 1) THEN 'pdfplumber' ELSE 'failed' END END AS pdf_method,
    page_id % 19 = 6 AND {IS_POLICY_PAGE_ROW} AS is_fallback
  FROM {{pages}}
) AS t
"""


def pages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@plan_once
def crawl_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pages_table(spark, sf_dir)
    raw = spark.sql(CRAWL_SELECT, pages=pages)
    return raw.withColumn("cookies", F.when(
        F.col("cookies_csv") != "", F.split("cookies_csv", ",")).otherwise(F.array().cast("array<string>"))
    ).drop("cookies_csv", "s", "b", "f")


# -- the same table, and what is known about it, for the oracle ---------------

def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    body = ",\n  ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES\n  {body})"


HOST = "lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"
PATH = "regexp_replace(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"


def host(u: str) -> str:
    return HOST.format(u=u)


def site(u: str) -> str:
    return f"regexp_replace({host(u)}, '^www[.]', '')"


def path(u: str) -> str:
    return PATH.format(u=u)


def norm(u: str) -> str:
    return (f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || "
            f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) || "
            f"coalesce(nullif(regexp_replace({path(u)}, '/+$', ''), ''), '/')")


def crawl_cte() -> str:
    return "crawl AS (" + CRAWL_SELECT.replace("{pages}", "pages") + ")"
