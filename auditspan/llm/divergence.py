"""Source divergence audit: how far the words of each source lie from those of its language.

Terms are runs of letters (A-Z folded, every non-ASCII code point a letter).  Tasks count them
without a Python object per term: a term of up to 8 bytes is packed into one uint64, one
of up to 16 bytes into two, and these words are sorted by radix, 16 bits at a time, and
counted by runs.  Longer terms go to buckets of one length each, sorted as bytes.

A language keeps the terms of at least ``least_docs`` of its rows.  All figures are integers:
p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)) and f = floor((p - q)**2 / (p + q)).

Rows of the result: for each (lang, source) its distance to every other source of the language
(part ``pair``) and the terms it uses more than its language (part ``term``), ranked.  Null text,
lang and source count as empty strings; repeated rows count each time; a group without terms still has its
pairs.  Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspan.llm.tasks import kept_table, map_rows

LEAST_DOCS, TOP_TERMS, SCALE = 10, 10, 1_000_000_000
#: sources of one block: a unit of work compares two blocks over some of the terms
BLOCK = 128
#: rows of a unit, about, and numbers of a table of terms by sources that are held at once
UNIT_ROWS, CELLS = 1 << 18, 1 << 21
#: parts that the rows of one source are spread over when they get its total
SALTS = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: keeps the first k of eight bytes
_HEAD = np.array([0, *(((1 << 8 * k) - 1) << 8 * (8 - k) for k in range(1, 9))], np.uint64)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text number of every term of texts that lie one after another."""
    letter = _LETTER[data]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    before[inner], after[inner - 1] = False, False
    starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return starts, ends, texts


def radix_order(columns: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """``order`` sorted stably by uint64 ``columns``, the first the most significant, 16 bits a pass."""
    for column in reversed(columns):
        for shift in (0, 16, 32, 48):
            digit = (column >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                # numpy sorts 16-bit numbers by radix when asked for a stable order
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _packed(windows: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each start as one number that sorts as the bytes do."""
    return windows[starts].astype(np.uint64) & _HEAD[np.clip(lengths, 0, 8)]


def _runs(changed: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs begin, how long they are and of how many texts; ``changed`` marks their first places."""
    first = np.flatnonzero(changed)
    fresh = changed.copy()
    fresh[1:] |= text[1:] != text[:-1]
    return first, np.diff(np.append(first, len(changed))), np.add.reduceat(fresh.astype(np.int64), first)


def _strings(rows: np.ndarray) -> pa.Array:
    """Terms from rows of bytes padded with zeros."""
    filled = rows != 0
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum(filled.sum(1), out=ends[1:])
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends), pa.py_buffer(rows[filled].tobytes()))


def count_terms(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, group, occurrences, texts) by (term, group); ``group`` is a number below 2**16 for each text."""
    lowered = np.concatenate([_LOWER[data], np.zeros(16, np.uint8)])
    starts, ends, text = spans(data, offsets)
    length = ends - starts
    windows = np.ndarray((len(lowered) - 7,), ">u8", lowered.data, strides=(1,))
    owner = group[text].astype(np.uint16)
    for least, most in ((1, 8), (9, 16)):
        own = np.flatnonzero((length >= least) & (length <= most))
        if not len(own):
            continue
        words = [_packed(windows, starts[own] + 8 * k, length[own] - 8 * k) for k in range(most // 8)]
        order = np.argsort(owner[own], kind="stable")  # by radix: texts of a group stay in their order
        order = radix_order(words, order)
        words, at = [w[order] for w in words], own[order]
        changed = np.ones(len(at), bool)
        changed[1:] = owner[at[1:]] != owner[at[:-1]]
        for w in words:
            changed[1:] |= w[1:] != w[:-1]
        first, n, texts = _runs(changed, text[at])
        rows = np.stack([w[first] for w in words], 1).astype(">u8").view(np.uint8).reshape(len(first), most)
        yield _strings(rows), owner[at[first]], n, texts
    own = np.flatnonzero(length > 16)
    own = own[np.argsort(length[own], kind="stable")]
    for bucket in np.split(own, np.flatnonzero(np.diff(length[own])) + 1):
        if not len(bucket):
            continue
        size = int(length[bucket[0]])
        terms = np.stack([lowered[s:s + size] for s in starts[bucket]]).view(f"S{size}").ravel()
        order = np.argsort(owner[bucket], kind="stable")
        order = order[np.argsort(terms[order], kind="stable")]
        terms, at = terms[order], bucket[order]
        changed = np.ones(len(at), bool)
        changed[1:] = (owner[at[1:]] != owner[at[:-1]]) | (terms[1:] != terms[:-1])
        first, n, texts = _runs(changed, text[at])
        yield pa.array([t.decode() for t in terms[first].tolist()], pa.string()), owner[at[first]], n, texts


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and rows that hold it."""
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(c, empty).alias(c) for c in ("text", "lang", "source")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "term", "n", "docs"]
        for batch in batches:
            text = batch.column("text").cast(pa.large_string())
            _, bounds, data = text.buffers()
            offsets = np.frombuffer(bounds, np.int64)[text.offset:text.offset + len(text) + 1]
            if not len(text) or offsets[0] == offsets[-1]:
                continue
            owners = pd.MultiIndex.from_arrays([batch.column("lang").to_pylist(), batch.column("source").to_pylist()])
            group, known = owners.factorize()
            lang, source = (pa.array(known.get_level_values(i), pa.string()) for i in (0, 1))
            part = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
            for terms, owner, n, texts in count_terms(part, offsets - offsets[0], group):
                yield pa.RecordBatch.from_arrays(
                    [lang.take(pa.array(owner)), source.take(pa.array(owner)), terms, pa.array(n, pa.int64()),
                     pa.array(texts, pa.int64())], names)

    counted = map_rows(rows, count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """p of a count; exact for counts up to 10**18, 0 for a language without terms."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + 2 as decimal(19,0)) div "
                  f"cast(nullif({total} + 2 * {terms}, 0) as decimal(19,0)))").cast("long")


def distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _unit_pairs(unit: pd.DataFrame) -> pd.DataFrame:
    """Distances between the sources of two blocks over the terms of one bucket."""
    marks, rows = unit[unit["term"].isna()], unit[unit["term"].notna()]
    first, second = int(unit["low"].iloc[0]), int(unit["high"].iloc[0])
    a, b = (marks[marks["block"] == k].sort_values("source") for k in (first, second))
    names = pd.Index(a["source"]) if first == second else pd.Index(a["source"]).append(pd.Index(b["source"]))
    none = a["p"].to_numpy() if first == second else np.concatenate([a["p"].to_numpy(), b["p"].to_numpy()])
    left, right = len(a), len(names)
    column = names.get_indexer(rows["source"])
    term, known = pd.factorize(rows["term"])
    order = np.argsort(term, kind="stable")
    term, column, p = term[order], column[order], rows["p"].to_numpy()[order]
    total = np.zeros((left, right), np.int64)
    step = max(1, CELLS // max(1, right))
    for start in range(0, len(known), step):
        lo, hi = np.searchsorted(term, (start, start + step))
        table = np.repeat(none[:, None], min(step, len(known) - start), 1)
        table[column[lo:hi], term[lo:hi] - start] = p[lo:hi]
        for i in range(left):
            others = table[i + 1:] if first == second else table[left:]
            gap = others - table[i]
            total[i, right - len(others):] += (gap * gap // (others + table[i])).sum(1)
    i, j = np.nonzero(np.triu(np.ones((left, right), bool), 1) if first == second else
                      np.repeat((np.arange(right) >= left)[None, :], left, 0))
    return pd.DataFrame({"lang": unit["lang"].iloc[0], "a": names[i], "b": names[j], "part": total[i, j],
                         "seen": len(known), "p_a": none[i], "p_b": none[j], "terms": unit["terms"].iloc[0]})


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of every two sources of a language.

    Sources are dealt into blocks and terms into buckets by hash; a unit is two blocks and a bucket, and
    holds the terms' rows of its sources and one mark a source.  A term that no source of a
    unit has adds the same to a pair wherever it is, so such terms are only counted.
    """
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.sum("held").alias("rows"))
    sizes = sizes.select("lang", F.ceil(F.col("sources") / BLOCK).cast("int").alias("blocks"), F.greatest(
        F.lit(1), F.ceil(F.col("rows") / UNIT_ROWS)).cast("int").alias("buckets"))
    divided = kept_table(groups.join(sizes, "lang"), "divided")
    block = F.pmod(F.xxhash64("source", F.lit(5)), F.col("blocks")).cast("int").alias("block")
    marks = divided.select("lang", "source", F.lit(None).cast("string").alias("term"),
                           share("0", "total", "terms").alias("p"), "terms", block, "blocks",
                           F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    rows = _with_group(kept, divided, ["total", "terms", "blocks", "buckets"]).select(
        "lang", "source", "term", share("n", "total", "terms").alias("p"), "terms", block, "blocks",
        F.pmod(F.xxhash64("term", F.lit(7)), F.col("buckets")).cast("int").alias("bucket"))
    dealt = marks.union(rows).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    dealt = dealt.select("lang", "source", "term", F.coalesce("p", F.lit(1)).alias("p"), "terms", "block", "bucket",
                         F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))
    found = dealt.groupBy("lang", "bucket", "low", "high").applyInPandas(
        _unit_pairs, "lang string, a string, b string, part long, seen long, p_a long, p_b long, terms long")
    found = found.groupBy("lang", "a", "b").agg(
        F.sum("part").alias("part"), F.sum("seen").alias("seen"), F.max("p_a").alias("p_a"), F.max("p_b").alias("p_b"),
        F.max("terms").alias("terms"))
    found = found.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                   F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"),
                         (F.col("part") + (F.col("terms") - F.col("seen")) * distance("p_a", "p_b")).alias("value"))
    return found.select("lang", "x.source", "x.item", "value")


def _with_group(kept: DataFrame, groups: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of terms with figures of their group; a group's rows are spread, as it may hold most of them."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(
        groups.select("lang", "source", *columns, salts), ["lang", "source", "salt"])


def audit(docs: DataFrame, *, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group."""
    counts = kept_table(term_counts(docs), "terms")
    words = (counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
             .filter(F.col("docs") >= least_docs).select("lang", "term", "lang_n"))
    kept = kept_table(counts.select("lang", "source", "term", "n").join(words, ["lang", "term"]), "kept")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    langs = words.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    empty = F.lit("")
    groups = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source")).distinct()
    groups = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = kept_table(groups.na.fill(0, ["total", "held", "lang_total", "terms"]), "sources")

    terms = _with_group(kept, groups, ["total", "lang_total", "terms"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q"))
    terms = terms.filter("p > q").select("lang", "source", "part", "item", distance("p", "q").alias("value"))
    pairs = _pairs(kept, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(order).alias("rank")
    return pairs.select("*", ranked).union(terms.select("*", ranked).filter(F.col("rank") <= top_terms))


__all__ = ["audit", "count_terms", "radix_order", "term_counts"]
