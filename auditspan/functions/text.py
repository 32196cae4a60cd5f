"""Text and markup column functions, all evaluated inside the JVM."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditspan.knowledge import fixed_values as fixed

# Marks the place of a removed tag; cannot occur in decoded text.
_BREAK = "\u0001"

# Attributes of a tag: a quote opens a value only after "=", so stray quotes
# and ">" inside quoted values are both read correctly.
ATTRS = r"""(?:[^>=]++|=\s*"[^"]*"|=\s*'[^']*'|=)*+"""
# A tag that is never closed runs to the end: every match consumes what it read,
# and hostile markup is still passed over once.
TAG_END = r"(?:>|\z)"

# Named character references resolved without leaving the JVM.
_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "),
    ("&laquo;", "«"), ("&raquo;", "»"), ("&mdash;", "—"), ("&ndash;", "–"),
    ("&hellip;", "…"), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"),
    ("&middot;", "·"), ("&bull;", "•"), ("&ldquo;", "“"), ("&rdquo;", "”"),
    ("&amp;", "&"),
)

# Whitespace as Unicode defines it (strip() in most languages).
_WS = r"[\s\u0085   -     　\u001c-\u001f]"


def fill(template: str, *values: Column | str) -> Column:
    """``{}`` placeholders of a fixed text filled with columns (or column names)."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for value, rest in zip(values, parts[1:], strict=True):
        out += [(F.col(value) if isinstance(value, str) else value).cast("string"), F.lit(rest)]
    return F.concat(*out)


def any_of(text: Column, words: Iterable[str]) -> Column:
    """True when any of the words is a substring of ``text``."""
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive Unicode search; ``.`` stops at ``\\n`` only."""
    return text.rlike("(?iudU)" + pattern)


def matches_exact(text: Column, pattern: str) -> Column:
    """Case-sensitive search with Unicode digits and spaces."""
    return text.rlike("(?dU)" + pattern)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_WS}+|{_WS}+$", "")


def _numeric_entities(text: Column) -> Column:
    """Decode ``&#1234;`` and ``&#x4d2;``."""
    parts = F.split(text, "&#")

    def decode(part: Column) -> Column:
        digits = F.regexp_extract(part, r"^([xX][0-9a-fA-F]+|[0-9]+);?", 1)
        code = F.when(
            F.lower(digits).startswith("x"), F.conv(F.substring(digits, 2, 12), 16, 16)
        ).otherwise(F.conv(digits, 10, 16))
        rest = F.regexp_replace(part, r"^([xX][0-9a-fA-F]+|[0-9]+);?", "")
        char = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        return F.when(digits == "", F.concat(F.lit("&#"), part)).otherwise(F.concat(char, rest))

    decoded = F.concat(
        F.element_at(parts, 1),
        F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), decode), ""))
    return F.when(text.contains("&#"), decoded).otherwise(text)


def decode_named(text: Column, names: Iterable[str]) -> Column:
    """Only the given named references resolved, in the order of the table above."""
    for name, char in _ENTITIES:
        if name in names:
            text = F.replace(text, F.lit(name), F.lit(char))
    return text


def decode_entities(text: Column) -> Column:
    out = _numeric_entities(text)
    for name, char in _ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.when(text.contains("&"), out).otherwise(text)


def drop_comments(html: Column) -> Column:
    """An unclosed comment runs to the end, so the text is passed over once."""
    return F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", _BREAK)


def drop_elements(html: Column, tags: Iterable[str]) -> Column:
    """Remove elements with their content; an unclosed one runs to the end."""
    names = "|".join(tags)
    return F.regexp_replace(html, rf"(?is)<({names})\b[^>]*+{TAG_END}.*?(</\1\s*>|\z)", _BREAK)


def text_nodes(html: Column) -> Column:
    """Stripped, non-empty text nodes of a fragment without scripts."""
    marked = F.regexp_replace(html, f"<[a-zA-Z/!?]{ATTRS}{TAG_END}", _BREAK)
    nodes = F.transform(F.split(marked, _BREAK), lambda t: strip(decode_entities(t)))
    return F.filter(nodes, lambda t: t != "")


def visible_text(html: Column, separator: str = "\n") -> Column:
    """Text of a page or fragment: one stripped text node after another."""
    return F.array_join(
        text_nodes(drop_elements(drop_comments(html), ("script", "style", "template"))),
        separator)


def inner_text(fragment: Column, separator: str = " ") -> Column:
    """Text of a small fragment such as the content of a link."""
    return F.array_join(text_nodes(fragment), separator)


def page_title(html: Column, entities: Iterable[str] | None = None) -> Column:
    """Title of a page or NULL; all references are resolved, or only the named ``entities``."""
    raw = F.regexp_extract(drop_comments(html), rf"(?is)<title[^>]*+{TAG_END}([^<]*)", 1)
    title = strip(decode_entities(raw) if entities is None else decode_named(raw, entities))
    return F.when(title != "", title)


def tidy_lines(text: Column, limit: int | None = None) -> Column:
    """Trim lines, drop blank ones; cut to ``limit`` characters if one is given."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")
    whole = F.array_join(lines, "\n")
    return whole if limit is None else F.substring(whole, 1, limit)


def count_items(text: Column) -> Column:
    """Number of non-blank lines; a missing text has none."""
    return F.coalesce(
        F.size(F.filter(F.split(text, "\n"), lambda s: strip(s) != "")), F.lit(0))


def is_cyrillic_text(text: Column) -> Column:
    """At least half of the letters, and at least 50 characters, are Cyrillic."""
    cyrillic = F.length(F.regexp_replace(text, r"[^\x{0400}-\x{04FF}]", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return (letters > 0) & (cyrillic * 2 >= letters) & (cyrillic >= 50)


def is_valid_policy_text(text: Column, is_russian: Column) -> Column:
    """Missing text passes; other texts must be long enough and in Russian."""
    return text.isNull() | ((F.length(text) >= fixed.POLICY_TEXT_MINIMUM) & is_russian)


def strip_preamble(text: Column) -> Column:
    """Everything from the first line that starts with a Cyrillic letter."""
    return F.regexp_extract(text, r"(?s)(?:^|[\n\r])([А-ЯЁа-яё].*)$", 1)


def content_flags(text: Column, pack=fixed.POLICY_FLAGS_RU) -> dict[str, Column]:
    """Named policy-content flags of a text.

    ``pack`` rows are (check id, flag, "raw" | "lower", patterns); another
    language is another pack.
    """
    forms = {"raw": text, "lower": F.lower(text)}
    flags = {}
    for _, flag, form, patterns in pack:
        hit = F.lit(True)
        for pattern in patterns:
            hit = hit & matches_exact(forms[form], pattern)
        flags[flag] = hit
    return flags


def provenance(text: Column, limit: int | None = None) -> dict[str, Column]:
    """Hash and full length of the text, and the stored form, cut only if a limit is given."""
    return {
        "text_hash": F.sha2(text, 256),
        "content_length": F.length(text).cast("bigint"),
        "stored_text": text if limit is None else F.substring(text, 1, limit),
        "text_truncated": F.when(text.isNotNull(), F.lit(False)) if limit is None else F.length(text) > limit,
    }
