"""Secret scans: fixed patterns, and the cost of guessing values in credential contexts.

Three kinds are found by pattern alone (``assign``, ``access``, ``hex``).  The
method adds kind ``guess``: a value that stands where credentials stand (after
``pwd:``, ``password is``, ``Bearer``, ``user:...@host`` and the like) and that is
expensive to guess.  Its cost in bits is the cheapest way to split it into
dictionary words, dates, repeated characters, keyboard walks and brute-force
characters, found by dynamic programming over its prefixes.

Rows: one per input row, repeated rows too.  A null text counts as empty and has
no spans.  Offsets count code points, ends are exclusive.  Time is linear in the
text: a word is looked for as far back as the longest one reaches, and of the starts of a
repeat or walk only those are followed that can still be the cheapest.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspan.llm.tasks import map_rows

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
#: a maximal run of at least that length is what the open-ended pattern finds and keeps
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: where a credential may stand; group 1 is the value
CONTEXTS = tuple(re.compile(p, re.ASCII | re.IGNORECASE) for p in (
    r"""\b(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|auth|credentials?)["']?(?:\x20*[:=]\x20*|\x20+is\x20+)["']?([!#-&(-_a-~]{6,})""",
    r"\bbearer\x20+([A-Za-z0-9+/_.=~-]{6,})",
))
#: the authority of a URL, of which ``user:value@`` is a context too; looked ahead, as its last sign may begin the next
AUTHORITY = re.compile(r"://(?=([^/\s]+))", re.ASCII)
SHORTEST_VALUE = 6
#: lower-cased literals without one of which a text has no ``assign`` match, or no context
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "api", "auth", "credential", "bearer", "://")
#: a value is reported from this many bits of guesses on
MIN_BITS = 32.0
#: frequent parts of passwords, the most frequent first; a word costs the logarithm of its place
WORDS = ("password", "admin", "welcome", "login", "letmein", "master", "hello", "secret", "dragon", "monkey", "test",
         "user", "root", "guest", "default", "changeme", "pass", "word", "access", "token", "key", "api", "love",
         "summer", "winter", "spring", "autumn", "football", "baseball", "shadow", "sunshine", "princess", "freedom",
         "example", "sample", "demo", "public", "private", "server", "service", "account", "system", "internal",
         "development", "production", "staging", "database", "my", "the", "your", "none", "null", "true", "false",
         "placeholder", "here", "insert", "value", "string", "company", "office", "home", "computer", "internet")
ROWS_OF_KEYS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?"
                  r"|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")
_NEXT = {a + b: True for row in ROWS_OF_KEYS for a, b in (*zip(row, row[1:]), *zip(row[1:], row))}
_LEET = str.maketrans("4@310$57!", "aaeiosstl")


def _brute_bits(c: str) -> float:
    if c.isdigit():
        return math.log2(10)
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return math.log2(26)
    return math.log2(33) if c.isascii() else math.log2(10_000)


#: one bit for the border of a segment keeps many small ones from looking cheap
BORDER = 1.0
SHORTEST_RUN = 3


class _Run:
    """Cheapest start of a run that ends at the current place.

    A start costs ``best[start] + log2(length)``.  What an earlier start pays more for its length shrinks as the
    run grows, so a start that costs no less than an earlier one now never will, and is dropped: the few
    that remain give the minimum over all starts in the run.
    """

    def __init__(self):
        self.begin = 0
        self.starts: list[int] = []

    def restart(self, begin: int) -> None:
        self.begin, self.starts = begin, []

    def cheapest(self, end: int, best: list[float]) -> float:
        fresh = end - SHORTEST_RUN
        if fresh >= self.begin:
            self.starts = [s for s in self.starts if best[s] < best[fresh]] + [fresh]
        least, kept = math.inf, []
        for start in self.starts:
            cost = best[start] + math.log2(end - start)
            if cost < least:
                least = cost
                kept.append(start)
        self.starts = kept
        return least


def date_ends(value: str) -> dict[int, list[int]]:
    """Starts of the dates that end at each place, in all their lengths."""
    found: dict[int, list[int]] = {}
    for at, c in enumerate(value):
        if c.isdigit():
            for end in (at + size for size in (4, 6, 7, 8, 9, 10)):
                if end <= len(value) and DATE.fullmatch(value, at, end):
                    found.setdefault(end, []).append(at)
    return found


def guess_bits(value: str, words: dict[str, float]) -> float:
    """Bits of the cheapest segmentation of ``value``; 0 for an empty value.

    ``words`` maps a lower-case word to its bits.  Upper case costs one bit a
    word, letters written as digits or signs another one.
    """
    n = len(value)
    low, plain = value.lower(), value.lower().translate(_LEET)
    if len(low) != n:  # lower-casing changed the length: compare characters as they are
        low = plain = value
    dates, longest = date_ends(value), max(map(len, words), default=0)
    best = [0.0] * (n + 1)
    repeat, walk = _Run(), _Run()
    for end in range(1, n + 1):
        c = value[end - 1]
        if end > 1 and value[end - 2] != c:
            repeat.restart(end - 1)
        if end > 1 and low[end - 2:end] not in _NEXT:
            walk.restart(end - 1)
        cost = min(repeat.cheapest(end, best) + _brute_bits(c), walk.cheapest(end, best) + math.log2(46) + 1)
        for start in dates.get(end, ()):
            cost = min(cost, best[start] + (math.log2(365 * 100) if end - start > 6 else math.log2(100)))
        for start in range(max(0, end - longest), end - 1):
            part = low[start:end]
            bits = words.get(part)
            if bits is None:
                bits = words.get(plain[start:end])
                bits = None if bits is None else bits + 1
            if bits is not None:
                cost = min(cost, best[start] + bits + (value[start:end] != part))
        best[end] = min(best[end - 1] + _brute_bits(c), cost + BORDER)
    return best[n]


def word_bits(words=WORDS) -> dict[str, float]:
    return {w: 1 + math.log2(i + 2) for i, w in enumerate(words)}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, order of the kind, end) of the pattern kinds, by start, then kind."""
    low = text.lower()
    spans = []
    if any(h in low for h in ASSIGN_HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def url_values(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the value in ``://user:value@`` of every URL authority; the user may be empty."""
    for m in AUTHORITY.finditer(text):
        at, to = m.span(1)
        end = text.rfind("@", at, to)
        start = text.find(":", at, end) + 1 if end >= 0 else 0
        if start and end - start >= SHORTEST_VALUE:
            yield start, end


def guess_spans(text: str, words: dict[str, float], min_bits: float) -> list[tuple[int, int, int]]:
    low = text.lower()
    if not any(h in low for h in CONTEXT_HINTS):
        return []
    values = {(m.start(1), m.end(1)) for p in CONTEXTS for m in p.finditer(text)}
    values.update(url_values(text))
    return sorted((s, 3, e) for s, e in values if guess_bits(text[s:e], words) >= min_bits)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with every covered stretch replaced by ``mark``; spans that overlap become one."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, *, words=WORDS, min_bits: float = MIN_BITS, mark: str = "[SECRET]",
         with_text: bool = True) -> DataFrame:
    """(doc_id, spans, base_spans, n_assign, n_access, n_hex, n_guess, redacted) of every row.

    ``redacted`` is null for a null text, and throughout without ``with_text``.
    """
    bits = word_bits(words)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                spans = sorted(base + guess_spans(text or "", bits, min_bits))
                rows.append((joined(spans), joined(base), *[sum(k == i for _, k, _ in spans) for i in range(4)],
                             redacted(text, spans, mark) if with_text and text is not None else None))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.string()]
            names = ["doc_id", "spans", "base_spans", "n_assign", "n_access", "n_hex", "n_guess", "redacted"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], names)

    return map_rows(docs.select("doc_id", "text"), run,
                    f"doc_id {kind}, spans string, base_spans string, n_assign long, n_access long, n_hex long, "
                    "n_guess long, redacted string")


def redact(docs: DataFrame, *, words=WORDS, min_bits: float = MIN_BITS, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of column ``text`` replaced by ``mark``; a null text stays null."""
    bits = word_bits(words)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else redacted(t, sorted(base_spans(t) + guess_spans(t, bits, min_bits)), mark)
                     for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return map_rows(docs, run, ", ".join(fields))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of a scan."""
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"),
                          "spans")


__all__ = ["scan", "redact", "digest", "guess_bits", "word_bits", "base_spans", "guess_spans", "redacted"]
