"""Forms, banners and main regions of pages.

Nesting is kept as intervals: every element of a page covers a range of places,
and "inside" is a comparison of numbers.  Python cuts a page into flat lists, one Arrow
batch at a time and only for pages that can hold a form or a banner.  The lists are an
index of the page: its text pieces stand in it once, and labels, links, controls
and banner elements refer to each other by ranges of numbers, found by binary search and by one
sweep over the sorted intervals.  So the index grows with the page, however its
elements nest.  What makes a form, a banner or a policy link is decided by column expressions below.

Only what a page itself repeats is repeated: a form inside a form lists its fields again, and the text
of a label is given to each control it names.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from functools import cached_property, lru_cache
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditspan.functions import text as tx
from auditspan.knowledge import fixed_values as fixed
from auditspan.localtable import arrow_type

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = "div form ul ol table section article footer main".split()
#: opening the first ends an open element of the second kind
_ENDS = {**{b: {"p"} for b in _BLOCKS}, "form": {"p", "form"}, "a": {"a"}, "p": {"p"}, "li": {"li"}, "option": {"option"},
         "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_SILENT = frozenset(("script", "style", "template"))
#: elements whose text may explain a checkbox that stands in them
_EXPLAINING = frozenset(("label", "div", "span", "p", "li"))
#: pages of an Arrow batch that are Python objects at a time; an index takes many times the room of its page
_SLICE = 64
#: texts up to this length are searched directly, longer ones through the places of all matches
_SHORT = 256


@lru_cache(maxsize=None)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.IGNORECASE)


class JoinedText:
    """The text pieces of a page joined once; a range of pieces is a range of characters."""

    def __init__(self, pieces: list[str], separator: str):
        self.text = separator.join(pieces)
        self.starts = list(accumulate((len(p) + len(separator) for p in pieces), initial=0))
        self._gap = len(separator)
        self._found: dict[str, list[int]] = {}

    def characters(self, pieces: tuple[int, int]) -> tuple[int, int]:
        first, last = pieces
        return (self.starts[first], self.starts[last] - self._gap) if last > first else (0, 0)

    def holds(self, pattern: str, pieces: tuple[int, int]) -> bool:
        """Does a match lie inside the range?"""
        start, end = self.characters(pieces)
        rule = _compiled(pattern)
        if end - start <= _SHORT:
            return rule.search(self.text, start, end) is not None
        if pattern not in self._found:
            self._found[pattern] = [m.start() for m in _compiled(f"(?={pattern})").finditer(self.text)]
        found = self._found[pattern]
        # a match that begins in the range and ends in it; only those near its end can fail
        for at in range(bisect_left(found, start), bisect_left(found, end)):
            if rule.match(self.text, found[at], end):
                return True
        return False

    def any_holds(self, pattern: str, parts: list[tuple[int, int]], after: str = "") -> bool:
        """Does the text of the parts, put together with spaces and ``after`` behind them, match?"""
        spans = [self.characters(p) for p in parts]
        if sum(b - a for a, b in spans) <= _SHORT:
            return _compiled(pattern).search(" ".join([*(self.text[a:b] for a, b in spans), after])) is not None
        if any(self.holds(pattern, p) for p in parts) or _compiled(pattern).search(after):
            return True
        # matches across the ends of parts are short
        ends = [self.text[max(a, b - _SHORT):b] for a, b in spans]
        heads = [self.text[a:min(b, a + _SHORT)] for a, b in spans] + ([after[:_SHORT]] if after else [])
        return any(_compiled(pattern).search(f"{x} {y}") for x, y in zip(ends, heads[1:]))


class Intervals(HTMLParser):
    """Elements as ranges of places; ``hidden`` kinds and what is in them are left out."""

    def __init__(self, html: str, hidden=()):
        super().__init__(convert_charrefs=True)
        self.names, self.attrs, self.first, self.last, self.parents = [], [], [], [], []
        self.places, self.pieces = [], []  # of visible, non-empty text
        self.events: list[int | str | None] = []  # element opened, text, or None for an end
        self._open: list[int] = []
        self._open_names: Counter[str] = Counter()
        self._hidden = frozenset(hidden)
        self._in_hidden = self._in_silent = 0
        self.feed(html)
        self.close()
        while self._open:
            self._leave()

    def _leave(self) -> None:
        at = self._open.pop()
        self._open_names[self.names[at]] -= 1
        self.last[at] = len(self.events)
        self.events.append(None)
        self._in_hidden -= self.names[at] in self._hidden
        self._in_silent -= self.names[at] in _SILENT

    def handle_starttag(self, tag, attrs):
        while self._open and self.names[self._open[-1]] in _ENDS.get(tag, ()):
            self._leave()
        own: dict[str, str] = {}
        for key, value in attrs:
            own.setdefault(key, value or "")
        at = len(self.names)
        self.names.append(tag)
        self.attrs.append(own)
        self.parents.append(self._open[-1] if self._open else -1)
        self.first.append(len(self.events))
        self.last.append(len(self.events) + 1)
        self.events.append(at)
        if tag not in _VOID:
            self._open.append(at)
            self._open_names[tag] += 1
            self._in_hidden += tag in self._hidden
            self._in_silent += tag in _SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("script", "iframe", "svg"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self._open_names[tag]:
            while self.names[self._open[-1]] != tag:
                self._leave()
            self._leave()

    def handle_data(self, data):
        piece = data.strip()
        if piece and not self._in_hidden and not self._in_silent:
            self.places.append(len(self.events))
            self.pieces.append(piece)
        self.events.append(piece)

    def text(self, at: int) -> tuple[int, int]:
        """The range of pieces inside an element."""
        return bisect_left(self.places, self.first[at]), bisect_left(self.places, self.last[at])

    def text_after(self, at: int) -> tuple[int, int] | None:
        """What stands right after an element without content; None at the end of its parent."""
        place = self.first[at] + 1
        after = self.events[place] if place < len(self.events) else None
        if after is None:
            return None
        return self.text(after) if isinstance(after, int) else (
            bisect_left(self.places, place), bisect_left(self.places, place + 1))

    @cached_property
    def spaced(self) -> JoinedText:
        return JoinedText(self.pieces, " ")

    @cached_property
    def tight(self) -> JoinedText:
        return JoinedText(self.pieces, "")

    def covered(self, outer: list[int], inner: list[int]) -> list[bool]:
        """Which of ``inner`` lie inside one of ``outer``: one sweep, both in page order."""
        out, reach, next_outer = [], -1, 0
        for at in inner:
            while next_outer < len(outer) and self.first[outer[next_outer]] < self.first[at]:
                reach = max(reach, self.last[outer[next_outer]])
                next_outer += 1
            out.append(self.first[at] < reach)
        return out


_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: numbers of the first element of a list and of the one after the last
_R = _struct(first=_I, last=_I)
_FIELDS = dict(
    pieces=T.ArrayType(_S),
    controls=T.ArrayType(_struct(kind=_S, name=_S, required=_B, placeholder=_S, label=_R)),
    links=T.ArrayType(_struct(href=_S, privacy=_B, banner_privacy=_B)),
    buttons=T.ArrayType(_struct(accept=_B, decline=_B, settings=_B)),
    forms=T.ArrayType(_struct(action=_S, method=_S, controls=_R, links=_R,
                              asked=_struct(checked=_B, around=_R, label=_R, after=_R))),
    named=T.ArrayType(_struct(id=_S, classes=_S, first=_I, buttons=_R, links=_R)),
    error=_S)
ELEMENTS = _struct(**_FIELDS)
_ELEMENTS_ARROW = arrow_type(ELEMENTS)
_NAMED = re.compile("|".join(fixed.BANNER_PATTERNS), re.IGNORECASE)


def _range(pair: tuple[int, int] | None) -> dict | None:
    return None if pair is None else {"first": pair[0], "last": pair[1]}


def _index(page: Intervals) -> dict:
    kinds: dict[str, list[int]] = {k: [] for k in ("form", "label", "link", "control", "button", "named")}
    for at, (name, attrs) in enumerate(zip(page.names, page.attrs)):
        if _NAMED.search(attrs.get("id", "")) or _NAMED.search(" ".join(attrs.get("class", "").split())):
            kinds["named"].append(at)
        if name in ("form", "label"):
            kinds[name].append(at)
        elif name in ("input", "textarea", "select"):
            kinds["control"].append(at)
        elif name == "a" and "href" in attrs:
            kinds["link"].append(at)
        if name in ("button", "a", "input"):
            kinds["button"].append(at)
    first = {k: [page.first[at] for at in ats] for k, ats in kinds.items()}

    def inside(kind: str, outer: int) -> tuple[int, int]:
        """The range of elements of a kind inside an element."""
        return bisect_left(first[kind], page.first[outer] + 1), bisect_left(first[kind], page.last[outer])

    # by the id they name, in page order
    labels: dict[str, list[int]] = {}
    for at in kinds["label"]:
        if page.attrs[at].get("for"):
            labels.setdefault(page.attrs[at]["for"], []).append(at)

    boxes = [at for at in kinds["control"] if page.names[at] == "input" and page.attrs[at].get("type") == "checkbox"]
    # text that explains a box wherever its form begins; a label counts only inside the form
    about = {}
    for at in boxes:
        parent = page.parents[at]
        explained = parent >= 0 and page.names[parent] in _EXPLAINING
        about[at] = (page.text(parent) if explained else None, page.text_after(at))

    def consents(*parts: tuple[int, int] | None) -> bool:
        return page.spaced.any_holds(fixed.CONSENT_TEXT_PATTERN, [p for p in parts if p is not None])

    # for each box the first from it on that needs no label to ask for consent, or has one that may
    following, ahead = [len(boxes)] * (len(boxes) + 1), len(boxes)
    for number in range(len(boxes) - 1, -1, -1):
        if page.attrs[boxes[number]].get("id") in labels or consents(*about[boxes[number]]):
            ahead = number
        following[number] = ahead

    def asked(form: int) -> dict | None:
        """The first checkbox of a form that asks for consent."""
        number, last = following[bisect_left(boxes, form)], bisect_left(first["control"], page.last[form])
        end = kinds["control"][last] if last < len(kinds["control"]) else len(page.names)
        while number < len(boxes) and boxes[number] < end:
            at = boxes[number]
            around, after = about[at]
            named = labels.get(page.attrs[at].get("id"), [])
            own = bisect_left(named, form + 1)  # elements are numbered in page order
            label = page.text(named[own]) if own < len(named) and page.first[named[own]] < page.last[form] else None
            if consents(around, label, after):
                return {"checked": "checked" in page.attrs[at], "around": _range(around), "label": _range(label),
                        "after": _range(after)}
            number = following[number + 1]
        return None

    def control(at: int) -> dict:
        attrs = page.attrs[at]
        named = labels.get(attrs.get("id", ""))
        return {"kind": attrs.get("type", "text"), "name": attrs.get("name", ""), "required": "required" in attrs,
                "placeholder": attrs.get("placeholder"), "label": _range(page.text(named[0]) if named else None)}

    def link(at: int, in_form: bool, in_banner: bool) -> dict:
        href, pieces, rule = page.attrs[at]["href"], page.text(at), fixed.PRIVACY_LINK_PATTERN
        known = _compiled(rule).search(href) is not None
        return {"href": href, "privacy": in_form and (known or page.spaced.holds(rule, pieces)),
                "banner_privacy": in_banner and (known or page.tight.holds(rule, pieces))}

    def button(at: int, in_banner: bool) -> dict:
        rules = {"accept": fixed.BANNER_ACCEPT_PATTERN, "decline": fixed.BANNER_DECLINE_PATTERN,
                 "settings": fixed.BANNER_SETTINGS_PATTERN}
        return {k: in_banner and page.spaced.any_holds(rule, [page.text(at)], page.attrs[at].get("value", ""))
                for k, rule in rules.items()}

    links, buttons = kinds["link"], kinds["button"]
    return {
        "pieces": page.pieces, "controls": [control(at) for at in kinds["control"]],
        "links": [link(*x) for x in zip(links, page.covered(kinds["form"], links), page.covered(kinds["named"], links))],
        "buttons": [button(*x) for x in zip(buttons, page.covered(kinds["named"], buttons))],
        "forms": [{"action": page.attrs[at].get("action"), "method": page.attrs[at].get("method", "GET").upper(),
                   "controls": _range(inside("control", at)), "links": _range(inside("link", at)), "asked": asked(at)}
                  for at in kinds["form"]],
        "named": [{"id": page.attrs[at].get("id"), "classes": " ".join(page.attrs[at].get("class", "").split()),
                   "first": page.first[at], "buttons": _range(inside("button", at)), "links": _range(inside("link", at))}
                  for at in kinds["named"]],
        "error": None}


def elements_of(html: str | None) -> dict | None:
    """The index of a page; a page that cannot be read gives an error, not a failed job."""
    if html is None:
        return None
    try:
        return _index(Intervals(html))
    except Exception as exc:  # noqa: BLE001 - one bad page must not stop the job
        return {"error": f"{type(exc).__name__}: {exc}"}


def by_slices(html: pa.Array, make: Callable[[str | None], object], type_: pa.DataType) -> pa.Array:
    """``make`` of every page; only those of one slice are Python objects at a time."""
    parts = [pa.array([make(h) for h in html.slice(first, _SLICE).to_pylist()], type=type_)
             for first in range(0, len(html), _SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], type=type_)


@F.arrow_udf(ELEMENTS)
def _elements(html: pa.Array) -> pa.Array:
    return by_slices(html, elements_of, _ELEMENTS_ARROW)


# Declared nondeterministic so that the optimizer never copies the call: a filter
# on a derived column would otherwise be pushed below it and cut pages twice.
_elements = _elements.asNondeterministic()


def needs_elements(html: Column) -> Column:
    """Cheap test inside the JVM: can this page hold a form or a banner at all?"""
    return html.rlike(r"(?i)<form[\s>]") | html.rlike("(?iu)" + "|".join(fixed.BANNER_PATTERNS))


def page_elements(html: Column) -> Column:
    """The index of a page; NULL for pages that hold neither a form nor a banner."""
    return _elements(F.when(needs_elements(html), html))


# -- what the lists mean ---------------------------------------------------

def _part(items: Column, range_: Column) -> Column:
    """The elements of a list that a range names."""
    return F.slice(items, range_.getField("first") + 1, range_.getField("last") - range_.getField("first"))


def _text(pieces: Column, range_: Column, separator: str) -> Column:
    """Text of a range; NULL without a range."""
    return F.array_join(_part(pieces, range_), separator)


def page_forms(e: Column) -> Column:
    """Forms with at least one data field: array<struct<form_ord, action, method, fields, consent..., href>>."""
    def field(control: Column) -> Column:
        return F.struct(
            control.getField("name").alias("name"), control.getField("kind").alias("field_type"),
            _text(e["pieces"], control.getField("label"), "").alias("label"),
            control.getField("required").alias("required"), control.getField("placeholder").alias("placeholder"))

    def form_of(form: Column) -> Column:
        asked = form.getField("asked")
        data = F.filter(_part(e["controls"], form.getField("controls")),
                        lambda c: ~c.getField("kind").isin(*fixed.NON_DATA_INPUT_TYPES))
        consent = F.array_join(F.array_compact(F.array(*[
            _text(e["pieces"], asked.getField(k), " ") for k in ("around", "label", "after")])), " ")
        return F.struct(
            form.getField("action").alias("action"), form.getField("method").alias("method"),
            F.transform(data, field).alias("fields"), asked.isNotNull().alias("has_consent_checkbox"),
            F.coalesce(asked.getField("checked"), F.lit(False)).alias("consent_prechecked"),
            F.when(asked.isNotNull(), tx.strip(consent)).alias("consent_text"),
            F.get(F.filter(_part(e["links"], form.getField("links")), lambda a: a.getField("privacy")), F.lit(0))
            .getField("href").alias("form_privacy_href"))

    with_fields = F.filter(F.transform(e["forms"], form_of), lambda f: F.size(f.getField("fields")) > 0)
    return F.transform(with_fields, lambda f, i: F.struct(
        i.alias("form_ord"), *[f.getField(k).alias(k) for k in (
            "action", "method", "fields", "has_consent_checkbox", "consent_prechecked", "consent_text", "form_privacy_href")]))


def page_banner(e: Column) -> Column:
    """Facts of the banner element: the best-named one, patterns in order, ids before classes."""
    def rank(named: Column) -> Column:
        order = F
        for i, pattern in enumerate(fixed.BANNER_PATTERNS):
            order = order.when(tx.matches(F.coalesce(named.getField("id"), F.lit("")), pattern), F.lit(2 * i))
            order = order.when(tx.matches(named.getField("classes"), pattern), F.lit(2 * i + 1))
        return order

    ranked = F.transform(e["named"], lambda x: F.struct(
        rank(x).alias("rank"), x.getField("first").alias("first"), x.getField("buttons").alias("buttons"),
        x.getField("links").alias("links")))
    best = F.array_min(F.filter(ranked, lambda x: x.getField("rank").isNotNull()))
    buttons, links = _part(e["buttons"], best.getField("buttons")), best.getField("links")

    def offers(kind: str) -> Column:
        return F.exists(buttons, lambda b: b.getField(kind))

    return F.when(best.isNotNull(), F.struct(
        F.lit(True).alias("found"), offers("accept").alias("has_accept"), offers("decline").alias("has_decline"),
        offers("settings").alias("has_settings"),
        (links.getField("last") > links.getField("first")).alias("has_policy_link")))


def banner_hrefs(e: Column) -> Column:
    """Policy links inside any banner element, in page order, without repeats."""
    inside = F.filter(e["links"], lambda a: a.getField("banner_privacy"))
    return F.array_distinct(F.transform(inside, lambda a: a.getField("href")))


# -- main content ----------------------------------------------------------

def main_text_of(html: str, hidden, rules) -> str:
    """Text of the region that the earliest of ``rules`` (attribute or None, pattern) finds, first in page order."""
    page = Intervals(html, hidden)
    best, region, clear = len(rules), None, -1
    for at, (name, attrs) in enumerate(zip(page.names, page.attrs)):
        if name in hidden:
            clear = max(clear, page.last[at])
        if page.first[at] < clear:
            continue
        for rank, (attribute, pattern) in enumerate(rules[:best]):
            if pattern.search(name if attribute is None else attrs.get(attribute, "")):
                best, region = rank, at
                break
    first, last = (0, len(page.pieces)) if region is None else page.text(region)
    return "\n".join(page.pieces[first:last])


def _main_text_udf(hidden, rules):
    @F.arrow_udf(T.StringType())
    def main_text(html: pa.Array) -> pa.Array:
        compiled = [(attribute, re.compile(pattern, re.IGNORECASE)) for attribute, pattern in rules]
        return by_slices(html, lambda h: None if h is None else main_text_of(h, hidden, compiled), pa.string())
    return main_text.asNondeterministic()  # see _elements


def main_content(html: Column, purpose: str = "monitor", limit: int | None = None) -> Column:
    """Main text of a page: trimmed lines of the main/article region.

    A page with exactly one region element of the preferred kind is handled by
    regular expressions in the JVM.  Python sees only the other pages, where
    the region has to be found by class, id or nesting.
    """
    if purpose == "monitor":
        hidden, prefer = fixed.MONITOR_DROP_TAGS, ("main", "article")
        by_class, by_id = fixed.MONITOR_CLASS_PATTERN, fixed.MONITOR_ID_PATTERN
    else:
        hidden, prefer = fixed.RESEARCH_DROP_TAGS, ("article", "main")
        by_class, by_id = fixed.RESEARCH_CLASS_PATTERN, fixed.RESEARCH_ID_PATTERN
    rules = [(None, rf"^{prefer[0]}$"), (None, rf"^{prefer[1]}$"), ("class", by_class), ("id", by_id), (None, "^body$")]
    kept = tx.drop_elements(tx.drop_comments(html), hidden)

    def count(tag):
        return F.regexp_count(kept, F.lit(rf"(?i)<{tag}[\s>]"))

    def region(tag):
        return F.regexp_extract(kept, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)

    def closed(tag):
        return kept.rlike(rf"(?i)</{tag}\s*>")

    first_simple = (count(prefer[0]) == 1) & closed(prefer[0])
    second_simple = (count(prefer[0]) == 0) & (count(prefer[1]) == 1) & closed(prefer[1])
    simple = first_simple | second_simple
    in_jvm = F.array_join(
        tx.text_nodes(F.when(first_simple, region(prefer[0])).otherwise(region(prefer[1]))), "\n")
    by_range = _main_text_udf(hidden, rules)(F.when(~simple, html))
    return tx.tidy_lines(F.when(simple, in_jvm).otherwise(by_range), limit)
