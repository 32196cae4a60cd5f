import time
import pytest
from pyspark.sql import functions as F

from auditspan.functions import markup, page_elements
from auditspan.functions import text as tx
from auditspan.operators import pages, scripts


@pytest.fixture(autouse=True)
def session(spark):
    global SPARK
    SPARK = spark


def tree(html):
    e = F.col("e")
    row = SPARK.createDataFrame([(html,)], "html string").select(page_elements._elements("html").alias("e")).select(
        page_elements.page_forms(e).alias("forms"), page_elements.page_banner(e).alias("banner"),
        page_elements.banner_hrefs(e).alias("hrefs"), e["error"].alias("error")).first()
    return row.asDict(recursive=True)


def crawl(spark, *rows):
    data = [(i, url, 200, "text/html", html, [], None, None, False) for i, (url, html) in enumerate(rows)]
    from auditspan import schemas
    return spark.createDataFrame(data, schemas.CRAWL)


def categories(spark, names):
    html = "<form>" + "".join(f'<input name="{n}">' for n in names) + "</form>"
    return pages.forms(pages.page_facts(crawl(spark, ("https://e.com/", html)))).first().pd_categories


def test_form_fields_and_submit():
    forms = tree('<form method=post><input type=email name=email required><input type=submit></form>')["forms"]
    assert len(forms) == 1 and forms[0]["method"] == "POST"
    assert forms[0]["fields"] == [{"name": "email", "field_type": "email", "label": None, "required": True, "placeholder": None}]
    assert tree("<p>x</p>")["forms"] == []
    assert tree("<form><input type=hidden name=a></form>")["forms"] == []


@pytest.mark.parametrize("box, prechecked", [("<input type=checkbox name=c>", False), ("<input type=checkbox name=c checked>", True)])
def test_consent_in_wrapping_label(box, prechecked):
    form = tree(f"<form><input name=email><label>{box} Согласие на обработку</label></form>")["forms"][0]
    assert (form["has_consent_checkbox"], form["consent_prechecked"]) == (True, prechecked)
    assert "согласие" in form["consent_text"].lower()


def test_consent_by_label_for_and_absent():
    form = tree('<form><input id=cb type=checkbox><label for=cb>Даю согласие</label></form>')["forms"][0]
    assert form["has_consent_checkbox"] and form["fields"][0]["label"] == "Даю согласие"
    assert not tree('<form><input type=checkbox name=n> Новости</form>')["forms"][0]["has_consent_checkbox"]


def test_unclosed_tags_do_not_swallow_the_next_form():
    forms = tree("<b><p>x<form><p><input name=a></form><form><p>y<input name=b></form>")["forms"]
    assert [f["fields"][0]["name"] for f in forms] == ["a", "b"]


@pytest.mark.parametrize("html, accept, decline", [
    ('<div id="cookie-banner"><button>Принять</button><button>Отклонить</button></div>', True, True),
    ('<div id="onetrust-banner-sdk"><button>Accept All</button></div>', True, False),
    ('<div id="CybotCookiebotDialog"><button>Allow all</button><button>Deny</button></div>', True, True),
    ('<div class="x cky-consent-container"><button>Accept</button><button>Reject All</button></div>', True, True)])
def test_banner_variants(html, accept, decline):
    banner = tree(html)["banner"]
    assert (banner["found"], banner["has_accept"], banner["has_decline"]) == (True, accept, decline)


def test_banner_patterns_beat_page_order():
    banner = tree('<div class="cky-banner"><button>Accept</button></div><div class="cookie-bar"></div>')["banner"]
    assert not banner["has_accept"]  # the first pattern wins, not the first element
    assert tree("<div id=x>cookie</div>")["banner"] is None


def test_pd_categories(spark):
    assert categories(spark, ["firstname", "email", "phone", "message"]) == ["name", "email", "phone"]
    assert categories(spark, ["имя", "телефон", "АДРЕС"]) == ["name", "phone", "address"]
    # the second e-mail field falls through to a later category
    assert categories(spark, ["email", "email_city"]) == ["email", "address"]


def test_external_scripts(spark):
    html = ('<head><script src="https://www.googletagmanager.com/gtm.js"></script>'
            '<link rel="stylesheet" href="https://fonts.googleapis.com/css2?a=1&amp;b=2"><script src="/l.js"></script></head>'
            '<!-- <script src="https://no.com/x.js"></script> --><script>var s="<script src=https://no.com/y.js>"</script>')
    got = scripts.page_scripts(crawl(spark, ("https://example.com/", html))).orderBy("script_ord").collect()
    assert [(r.script_type, r.url) for r in got] == [
        ("js", "https://www.googletagmanager.com/gtm.js"), ("css", "https://fonts.googleapis.com/css2?a=1&b=2")]


def test_library_banner_and_prohibited(spark):
    html = '<script src="https://consent.cookiebot.com/uc.js"></script><script src="https://www.google-analytics.com/a.js"></script>'
    row = pages.page_facts(crawl(spark, ("https://e.com/", html))).first()
    assert row.banner.found and not row.banner.has_accept and row.banner.analytics_before_consent
    assert row.prohibited_mask == 1 and row.tracker_mask == 1


def test_footer_link(spark):
    rows = [("https://a.com/", '<a href="/1">1</a><footer><a href="/privacy">ПДн</a></footer>'),
            ("https://b.com/", '<a href="/privacy">p</a>' + '<a href="/x">x</a>' * 7),
            ("https://c.com/", '<a href="/x">x</a>' * 3 + '<a href="/p">Политика</a>')]
    got = pages.page_facts(crawl(spark, *rows)).orderBy("page_ord").select("footer_href").collect()
    assert [r.footer_href for r in got] == ["/privacy", None, "/p"]


def test_form_falls_back_to_page_privacy_link(spark):
    html = '<form><input name=email></form><a href="/terms">Terms</a>'
    assert pages.forms(pages.page_facts(crawl(spark, ("https://e.com/", html)))).first().has_privacy_link


def test_entities_attributes_and_quotes(spark):
    html = """<a title="a > b" data-href="/no" href='/x?a=1&amp;b=2'>q &laquo;&#1071;&#x42F;&raquo;</a><a href=/y class=it's>z</a>"""
    row = spark.createDataFrame([(html,)], "html string").select(markup.anchors(markup.flat_source(F.col("html"))).alias("a")).first()
    assert [(a.href, a.text) for a in row.a] == [("/x?a=1&b=2", "q «ЯЯ»"), ("/y", "z")]


def main(spark, html, purpose="monitor"):
    return spark.createDataFrame([(html,)], "html string").select(
        page_elements.main_content(F.col("html"), purpose).alias("t")).first().t


def test_main_content(spark):
    page = "<nav>n</nav><script>s</script><main><h1>T</h1><p> a <b>b</b></p></main><footer>f</footer>"
    assert main(spark, page) == "T\na\nb"
    assert main(spark, '<div>x</div><div class="post-content"><div>in</div>ner</div><div>y</div>') == "in\nner"
    assert main(spark, "<article>one<article>two</article>three</article>four") == "one\ntwo\nthree"
    assert main(spark, "<article>a</article><main>m</main>") == "m"
    assert main(spark, "<article>a</article><main>m</main>", "research") == "a"
    assert main(spark, "<main>x<form>f</form></main>", "research") == "x"
    assert len(main(spark, "<main>" + "<p>x</p>" * 100000 + "</main>", "research")) == 199999


def test_title_and_text(spark):
    row = spark.createDataFrame([("<title> A &amp; B </title><p>x<!-- c -->y</p><style>z</style>",)], "html string").select(
        tx.page_title(F.col("html")).alias("t"), tx.visible_text(F.col("html")).alias("v")).first()
    assert (row.t, row.v) == ("A & B", "A & B\nx\ny")


def test_broken_input_is_reported_not_raised():
    assert page_elements.elements_of(None) is None
    assert page_elements.elements_of("<form><input name=a" + "<" * 50)["error"] is None
    assert "error" in page_elements.elements_of(5) and tree(None)["forms"] is None


@pytest.mark.parametrize("piece", ["<!--", "<a ", "<script", "<script ", "<title ", "<style x", "<a href='", '<img a="'])
def test_hostile_markup_is_passed_over_once(spark, piece):
    """1 MB of tags that never end; a quadratic pattern takes minutes."""
    html = piece * (1_000_000 // len(piece))
    source = markup.flat_source(F.col("html"))
    started = time.perf_counter()
    spark.createDataFrame([(html,)], "html string").select(
        F.length(tx.visible_text(F.col("html"))), tx.page_title(F.col("html")), F.size(markup.anchors(source)),
        F.size(markup.resource_tags(source))).collect()
    assert time.perf_counter() - started < 20


def test_rules_over_intervals():
    form, = tree('<div id=cookie-bar><form action=/x><label for=m>Почта <b>тут</b></label><div><input id=m name=m>'
                 '<input type=checkbox id=k checked> принимаю <b>обработку</b></div><a href=/privacy>Условия</a></form></div>'
                 '<label for=k>чужая</label>')["forms"]
    assert form["fields"][0]["label"] == "Почтатут" and form["action"] == "/x" and form["form_privacy_href"] == "/privacy"
    assert form["consent_prechecked"] and form["consent_text"] == "принимаю обработку принимаю"
    found = tree('<div class="a cookie_notice"><p id=x>t</p><a href="/legal">L</a><div id="cookie-popup"><a href="/legal">L</a>'
                 '<input type=button value="Decline"></div></div><a href="/privacy">out</a>')
    assert found["hrefs"] == ["/legal"] and found["banner"]["has_decline"] and not found["banner"]["has_accept"]


@pytest.mark.parametrize("piece", ["<b></i>", "<div>", "<p><b>", "</div>"])
def test_cutting_is_linear(piece):
    started = time.perf_counter()
    page_elements.elements_of(piece * (500_000 // len(piece)))
    assert time.perf_counter() - started < 10


CONTROLS = "".join(f"<label for=i{i}>L {i}</label><input id=i{i} name=n{i}>" for i in range(20_000))
BOXES = "".join(f"<label for=i{i}>L {i}</label><input type=checkbox id=i{i} name=n{i}> t" for i in range(20_000))


@pytest.mark.parametrize("html", [
    "<form>" + "<a href=x>t" * 90_000, "<form>" + "<a href=x><b>t" * 70_000, "<form>" + "<label>t" * 125_000,
    "<form>" + "<label for=q>t" * 70_000, "<div id=cookie-banner><button>t" * 32_000, "<form><b><a href=x>t" * 50_000,
    "<form><div><input type=checkbox>t" * 30_000, "<form>" + CONTROLS, "<form>" + BOXES],
    ids=["a", "nested a", "label", "label for", "banners", "nested forms", "nested boxes", "controls", "boxes"])
def test_page_index_is_linear(spark, html):
    """1 MB of elements that never end, and 20 000 controls: index and rules together."""
    e = F.col("e")
    tree("<form><input name=a></form>")  # compiled before the clock runs
    started = time.perf_counter()
    if html.count("<form>") > 1:  # a form in a form lists its fields again, so only the index is linear
        index = page_elements.elements_of(html)
        assert index["error"] is None and sum(len(p) for p in index["pieces"]) <= len(html)
    else:
        row = spark.createDataFrame([(html,)], "html string").withColumn("e", page_elements._elements("html")).select(
            F.size(page_elements.page_forms(e)), page_elements.page_banner(e), F.size(page_elements.banner_hrefs(e)), e["error"]).first()
        assert row[3] is None
    assert time.perf_counter() - started < 5


def plain_index(html):
    """Forms and banner links of a page by nested loops over element texts, the definition of the index."""
    from auditspan.knowledge import fixed_values as fixed
    import re
    page = page_elements.Intervals(html)
    size = range(len(page.names))

    def text(at, separator):
        a, b = page.text(at)
        return separator.join(page.pieces[a:b])

    def inside(at, outer):
        return page.first[outer] < page.first[at] < page.last[outer]

    def privacy(at, separator):
        return any(re.search(fixed.PRIVACY_LINK_PATTERN, t, re.I) for t in (text(at, separator), page.attrs[at]["href"]))

    named = [at for at in size if any(re.search(p, v, re.I) for p in fixed.BANNER_PATTERNS
                                      for v in (page.attrs[at].get("id", ""), page.attrs[at].get("class", "")))]
    links = [at for at in size if page.names[at] == "a" and "href" in page.attrs[at]]
    labels = [at for at in size if page.names[at] == "label"]
    forms = []
    for form in (at for at in size if page.names[at] == "form"):
        asked = None
        for box in (at for at in size if page.names[at] == "input" and page.attrs[at].get("type") == "checkbox" and inside(at, form)):
            parent, parts = page.parents[box], []
            if page.names[parent] in ("label", "div", "span", "p", "li"):
                parts.append(text(parent, " "))
            own = [at for at in labels if inside(at, form) and page.attrs[box].get("id") and page.attrs[at].get("for") == page.attrs[box]["id"]]
            parts += [text(own[0], " ")] if own else []
            after = page.events[page.first[box] + 1]
            parts += [] if after is None else [text(after, " ") if isinstance(after, int) else after]
            if asked is None and re.search(fixed.CONSENT_TEXT_PATTERN, " ".join(parts), re.I):
                asked = " ".join(parts).strip()
        fields = [(page.attrs[at].get("name", ""), next((text(x, "") for x in labels if page.attrs[at].get("id")
                   and page.attrs[x].get("for") == page.attrs[at]["id"]), None))
                  for at in size if page.names[at] in ("input", "select", "textarea") and inside(at, form)
                  and page.attrs[at].get("type") not in fixed.NON_DATA_INPUT_TYPES]
        if fields:
            forms.append((fields, asked, next((page.attrs[a]["href"] for a in links if inside(a, form) and privacy(a, " ")), None)))
    hrefs = [page.attrs[a]["href"] for a in links if any(inside(a, n) for n in named) and privacy(a, "")]
    return forms, list(dict.fromkeys(hrefs))


def random_page(seed):
    import random
    r = random.Random(seed)
    pieces = ["<form>", "</form>", "<div>", "</div>", "<p>", "<b>", "</b>", "<a href=/x>", "<a href=/privacy>", "<a>", "</a>", "<label for=a>",
              "<label for=b>", "<label>", "</label>", "<input id=a name=n>", "<input type=checkbox id=a>", "<input type=checkbox id=b checked>",
              "<input type=checkbox>", "<select name=s>", "</select>", "<input type=submit>", "<div class='x cookie-bar'>", "<span id=onetrust>",
              "</span>", "<button value=no>", "personal", "data", "согласие", "поли", "тика", "обработка", "данных", "word " * 30, " ", "terms",
              "<script>personal data</script>", "text"]
    return "".join(r.choice(pieces) for _ in range(r.randrange(5, 90)))


def test_page_index_equals_nested_loops(spark):
    pages_ = [random_page(i) for i in range(400)]
    e = F.col("e")
    rows = spark.createDataFrame(list(enumerate(pages_)), "i int, html string").withColumn(
        "e", page_elements._elements("html")).select("i", page_elements.page_forms(e).alias("f"), page_elements.banner_hrefs(e).alias("h"))
    for r in rows.collect():
        forms, hrefs = plain_index(pages_[r.i])
        assert r.h == hrefs, pages_[r.i]
        assert [([(x.name, x.label) for x in f.fields], f.consent_text, f.form_privacy_href) for f in r.f] == forms, pages_[r.i]


def test_matches_across_parts_are_found_in_long_texts():
    from auditspan.knowledge import fixed_values as fixed
    text = page_elements.JoinedText(["x" * 300, "personal", "data", "y" * 300], " ")
    pattern = fixed.CONSENT_TEXT_PATTERN
    assert text.holds(pattern, (0, 4)) and not text.holds(pattern, (0, 2)) and not text.holds(pattern, (2, 4))
    assert text.any_holds(pattern, [(0, 2), (2, 4)]) and not text.any_holds(pattern, [(2, 4), (0, 2)])
    assert text.any_holds("only +necessary", [(0, 2)], "only necessary") and text.any_holds("personal +now", [(0, 2)], "now")


@pytest.mark.parametrize("purpose", ["monitor", "research"])
@pytest.mark.parametrize("opened, closed", [("<main>", "</main>"), ("<div class=content>", "</div>")])
def test_main_text_of_a_hundred_thousand_tags(spark, purpose, opened, closed):
    assert main(spark, opened + "<p>x</p>" * 10 + closed, purpose)
    started = time.perf_counter()
    assert len(main(spark, opened + "<p>x</p>" * 100_000 + closed, purpose)) == 199_999
    assert time.perf_counter() - started < 5
