"""Document fingerprints from prefix polynomial hashes.

``Prefixes`` holds, for every prefix of a text, a polynomial hash modulo a
Mersenne prime (two of them for equality).  From these arrays the hash of any span follows in one
step, so two spans are compared without reading them again, and the longest
common extension of two places is found by binary search.

A document's fingerprint is its length, its whole hash under both moduli, and the
``SKETCH`` smallest distinct span hashes over all spans of ``SPAN`` code points
(texts below ``SHORT`` code points also give their spans of ``SHORT_SPAN``, or
themselves whole): equal texts have equal fingerprints, and the
share of common small hashes estimates how alike two texts are.

Rows: repeated rows of one id and text count as one document with one neighbour
and come back as often as they came.  A null text counts as empty.  Null ids come
after all others in descending order.
"""
from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspan.llm.tasks import map_rows, text_key

P31 = (1 << 31) - 1
BASES = (911_382_323, 972_663_749)
SPAN = 12
SHORT, SHORT_SPAN = 256, 4
SKETCH = 64
_TABLES: dict = {}


def _mod(x: np.ndarray) -> np.ndarray:
    """Modulo 2**31 - 1 of values below 2**62."""
    x = (x & np.uint64(P31)) + (x >> np.uint64(31))
    x = (x & np.uint64(P31)) + (x >> np.uint64(31))
    return np.where(x == P31, np.uint64(0), x)


def _powers(base: int, length: int) -> np.ndarray:
    """base**i modulo the prime, by doubling; kept per process, grown when needed."""
    have = _TABLES.get(base)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < length:
        have = np.concatenate([have, _mod(have * np.uint64(pow(base, len(have), P31)))])
    _TABLES[base] = have
    return have[:length]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefixes:
    """Prefix hashes of a text, H[i] = sum of (c_j + 1) * base**j for j < i."""

    def __init__(self, points: np.ndarray, bases: tuple[int, ...] = BASES):
        self.n, self.bases, self.sums = len(points), bases, []
        values = points.astype(np.uint64) + np.uint64(1)
        for base in bases:
            sums = np.zeros(self.n + 1, np.uint64)
            # terms are below 2**31, so up to 2**32 of them add without overflow
            np.cumsum(_mod(values * _powers(base, self.n)), out=sums[1:])
            self.sums.append(_mod(sums))

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """Hash of [start, end), the same wherever the span stands."""
        return tuple(int((int(s[end]) - int(s[start])) * pow(b, -start, P31) % P31)
                     for b, s in zip(self.bases, self.sums))

    def spans(self, width: int, which: int = 0) -> np.ndarray:
        """Hashes of all spans of ``width`` code points under one modulus."""
        sums, n = self.sums[which], self.n - width + 1
        down = _powers(pow(self.bases[which], -1, P31), n)
        return _mod(_mod(sums[width:] + np.uint64(P31) - sums[:n]) * down)


def spans_equal(a: Prefixes, i: int, b: Prefixes, j: int, length: int) -> bool:
    return a.span(i, i + length) == b.span(j, j + length)


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Length of the longest common span that starts at i and at j."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if spans_equal(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def _smallest(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct values of mixed hashes."""
    mixed = (hashes.astype(np.uint32) * np.uint32(2654435769))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(2246822519)
    mixed ^= mixed >> np.uint32(13)
    bound = min(1 << 32, (1 << 32) * 3 * k // max(1, len(mixed)))
    while True:
        low = np.unique(mixed if bound >= 1 << 32 else mixed[mixed < np.uint32(bound)])
        if len(low) >= k or bound >= 1 << 32:
            return low[:k]
        bound *= 4


def fingerprint_of(points: np.ndarray) -> tuple[str, np.ndarray]:
    """The fingerprint as text, and its sketch."""
    prefixes = Prefixes(points)
    if len(points) == 0:
        sketch = np.zeros(0, np.uint32)
    else:
        found = [prefixes.spans(SPAN)] if len(points) >= SPAN else []
        if len(points) < SHORT:
            found.append(prefixes.spans(min(SHORT_SPAN, len(points))) + np.uint64(1))
        sketch = _smallest(np.concatenate(found), SKETCH)
    whole = "".join(f"{h:08x}" for h in prefixes.span(0, len(points)))
    return f"{len(points):x}.{whole}.{base64.b64encode(sketch.astype('>u4').tobytes()).decode()}", sketch


def sketch_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint.split(".")[2]), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of spans in common, 2 * common / (a + b), from two sketches."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    either = np.union1d(a, b)[:max(len(a), len(b)) if max(len(a), len(b)) >= SKETCH else None]
    both = np.intersect1d(np.intersect1d(a, b), either)
    share = len(both) / len(either)
    return 2 * share / (1 + share)


def _order(doc_id, key) -> tuple:
    """Sorts ids downwards, null ids last, texts of one id by their digest."""
    return (doc_id is None, -(doc_id or 0), key)


def fingerprints(docs: DataFrame, *, rows_per_range: int = 600, most_ranges: int = 400_000) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    Documents are dealt into ranges of descending ids, cut at sampled ids, and the
    first document of a range is sent to the range before as well; each text
    moves once.  ``rows_per_range`` and ``most_ranges`` bound the list of cuts that
    the driver holds, not the result.  Ids are integers.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", text_key())
    kind = dict(docs.dtypes)["doc_id"]
    whole = rows.groupBy().agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct("doc_id", F.bitwise_not(F.col("key")).alias("key"))).alias("s")).first()
    one_in = max(rows_per_range, -(-whole.n // most_ranges))
    # keys picked by hash are the cuts; the greatest id of all starts the first range
    cuts = rows.select("doc_id", "key").filter(F.pmod(F.xxhash64("doc_id", "key"), F.lit(one_in)) == 0).distinct()
    heads = {_order(r.doc_id, r.key) for r in cuts.collect()}
    if whole.s is not None:
        heads.add(_order(whole.s.doc_id, ~whole.s.key))
    heads = sorted(heads)
    ranges = max(1, len(heads))

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, missing: pd.Series, keys: pd.Series) -> pd.Series:
        out = []
        for doc_id, null, key in zip(ids, missing, keys):
            at = _order(None if null else int(doc_id), int(key))
            own = max(0, bisect.bisect_right(heads, at) - 1)
            out.append([own, (own - 1) % ranges] if heads[own] == at and ranges > 1 else [own])
        return pd.Series(out)

    # several ranges a task even out their sizes
    dealt = (rows.withColumn("range", F.explode(places(F.coalesce("doc_id", F.lit(0)), F.isnull("doc_id"), "key")))
             .repartition(-(-ranges // 8), "range")
             .sortWithinPartitions("range", F.col("doc_id").desc_nulls_last(), "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("range", "doc_id", "key", "text")]
                yield from zip(*columns)

        out: list[tuple] = []

        def finish(held, following):
            """Results of the rows of one document whose next document is ``following``."""
            (doc_id, _), text, points, mark, sketch, copies = held
            cut = len(points) // 3
            edited = text[:len(points) - cut] + following[1][:cut]
            edited_mark, edited_sketch = fingerprint_of(code_points(edited))
            row = (doc_id, len(points), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark,
                   edited_mark, likeness(sketch, edited_sketch), likeness(sketch, following[4]))
            out.extend([row] * copies)

        def documents(rows_of_range):
            """One entry per document of a range: key, text, points, fingerprint, sketch, copies."""
            held = None
            for _, doc_id, key, text in rows_of_range:
                if held is not None and held[0] == (doc_id, key):
                    held = (*held[:5], held[5] + 1)
                    continue
                if held is not None:
                    yield held
                points = code_points(text)
                held = ((doc_id, key), text, points, *fingerprint_of(points), 1)
            if held is not None:
                yield held

        from itertools import groupby
        for number, rows_of_range in groupby(stream(), key=lambda r: r[0]):
            following_head = heads[(number + 1) % ranges]
            # the last range goes on with the first document of all, which sorts first in it
            borrowed = before = None
            for doc in documents(rows_of_range):
                place = _order(*doc[0])
                if ranges > 1 and place == following_head:
                    if number == ranges - 1:
                        borrowed = doc
                        continue
                    if before is not None:
                        finish(before, doc)
                        before = None
                    continue
                if before is not None:
                    finish(before, doc)
                if borrowed is None and ranges == 1:
                    borrowed = doc
                before = doc
                if len(out) >= 1000:
                    yield _batch(out)
                    out.clear()
            if before is not None:
                finish(before, borrowed if borrowed is not None else before)
        if out:
            yield _batch(out)

    arrow_kind = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16()}[kind]

    def _batch(rows_out: list[tuple]) -> pa.RecordBatch:
        kinds = [arrow_kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows_out), kinds)], names)

    return map_rows(dealt, run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                                "edited_fingerprint string, near_edited double, near_next double")
