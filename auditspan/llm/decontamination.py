"""Benchmark decontamination by spaced-seed hashing, DataFrame expressions only.

Words are lower-cased (A-Z) runs of other characters than ASCII white space.  A
mask names the places of a span that count; the rest are ignored, so a replaced
word at an ignored place does not hide an overlap.  Hashes of the masked spans of
benchmark items and of documents are joined.  A hit fixes how item and document
are aligned; the aligned words around it, ``window`` of them or the whole item if
it is shorter, are then compared, and the hit stands when at least ``similarity``
of them agree.  The masks lose nothing: every window that the comparison accepts
holds a masked span of its own (``lossless_masks``), for items of any length.

Rows: one per document and item, with the greatest agreement, its window and the
number of words; of equal agreement the first in the document.  Repeated rows of
a document or an item give one row.  Null and empty texts, and empty tables, give
no rows.  An item shorter than the window is aligned as a whole.  Further columns
of either table are not read.
"""
from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 15
SIMILARITY = 0.8
#: more masks for one length are not taken, however selective they would be
MOST_MASKS = 6
#: masked spans of a benchmark, at most 350 bytes each with the words around them, that are sent to every executor
MAX_BROADCAST_SEEDS = 100_000
#: places of a text that are joined as one row
BLOCK = 256
SPLIT = "[ \\t-\\r]+"


def word_list(text: Column) -> Column:
    """The words of a text, each as its 64-bit hash."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.array_remove(F.split(F.coalesce(lower, F.lit("")), SPLIT), ""), lambda w: F.xxhash64(w))


def lossless_masks(length: int, wrong: int, most: int = MOST_MASKS) -> list[tuple[int, ...]]:
    """Masks of which one fits in any ``length`` aligned words with at most ``wrong`` that differ.

    Cut into m parts, at least m - ``wrong`` of them agree; as every place of both texts
    begins a span, choices of parts that are shifts of each other are one mask.  Of all m
    the one whose masks count most words is taken, with at most ``most`` masks.
    """
    def rank(m: int) -> tuple[int, int]:
        return (m - wrong) * (length // m), -math.comb(m - 1, wrong)
    parts = max((m for m in range(wrong + 1, length + 1) if math.comb(m - 1, wrong) <= most), key=rank)
    width = length // parts
    return [tuple(part * width + i for part in (0, *rest) for i in range(width))
            for rest in combinations(range(1, parts), parts - wrong - 1)]


def _families(lengths: list[int], similarity: float) -> list[tuple[tuple[int, ...], list[int]]]:
    """(places, lengths that it serves) of the masks for windows of the given lengths."""
    served: dict[tuple[int, ...], list[int]] = {}
    for n in lengths:
        for mask in lossless_masks(n, n - math.ceil(similarity * n)):
            served.setdefault(mask, []).append(n)
    return list(served.items())


def _seeds(blocks: DataFrame, families, keep: list[str], fits) -> DataFrame:
    """(keep, words, at, family, covers, seed) of every place of every block.

    ``at`` counts within ``words``; ``fits(lengths)`` says whether a mask for these is used.
    The arrays are only referred to while places are joined, not copied.
    """
    places = blocks.select(*keep, "words", F.explode(F.sequence("first", "last")).alias("at"))
    parts = []
    for k, (offsets, lengths) in enumerate(families):
        n = offsets[-1] + 1
        seed = F.xxhash64(*[F.get(F.col("words"), F.col("at") + o) for o in offsets])
        parts.append(F.when((F.col("at") + n <= F.size("words")) & fits(lengths), F.struct(
            F.lit(k).alias("family"), F.lit(n).alias("covers"), seed.alias("seed"))))
    return (places.select(*keep, "words", "at", F.explode(F.array(*parts)).alias("s")).filter("s is not null")
            .select(*keep, "words", "at", F.col("s.family").alias("family"), F.col("s.covers").alias("covers"),
                    F.col("s.seed").alias("seed")))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, similarity: float = SIMILARITY,
                 doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, doc_start, window_words, matched_words): best verified overlap of each pair."""
    if not 0 < similarity <= 1 or window < 1:
        raise ValueError(f"no overlap is required by similarity {similarity} over {window} words")
    items = (benchmark.select("item_id", word_list(F.col("text")).alias("words"))
             .filter(F.size("words") > 0).distinct())
    # the lengths of the items decide the join; at most ``window`` rows
    aligned = F.least(F.size("words"), F.lit(window))
    sizes = items.groupBy(aligned.alias("n")).agg(F.sum(F.size("words").cast("long")).alias("words")).collect()
    families = _families(sorted(r.n for r in sizes) or [window], similarity)

    whole = items.withColumns({"first": F.lit(0), "last": F.size("words") - 1})
    used = _seeds(whole, families, ["item_id"], lambda lengths: aligned.isin(lengths))
    wanted = used.select(
        "family", "covers", "seed", "item_id", F.size("words").alias("item_size"), F.col("at").alias("item_at"),
        F.greatest(F.col("at") - window, F.lit(0)).alias("near_from"),
        F.slice("words", F.greatest(F.col("at") - window, F.lit(0)) + 1, 2 * window + 1).alias("near"))
    if sum(r.words * sum(r.n in lengths for _, lengths in families) for r in sizes) <= MAX_BROADCAST_SEEDS:  # beyond, the join is shuffled by seed
        wanted = F.broadcast(wanted)

    # blocks of words with a window before and after them: no row holds a long text's words again and again
    lists = docs.select(F.col(doc_id).alias("doc_id"), word_list(F.col("text")).alias("all"))
    starts = F.when(F.size("all") > 0, F.sequence(F.lit(0), F.size("all") - 1, F.lit(BLOCK)))
    blocks = lists.select("doc_id", "all", F.explode(starts).alias("b"))
    blocks = blocks.select("doc_id", F.greatest(F.col("b") - window, F.lit(0)).alias("base"), "b",
                           F.slice("all", F.greatest(F.col("b") - window, F.lit(0)) + 1,
                                   BLOCK + 2 * window).alias("words"))
    blocks = blocks.select("doc_id", "base", "words", (F.col("b") - F.col("base")).alias("first"),
                           (F.least(F.col("b") - F.col("base") + BLOCK, F.size("words")) - 1).alias("last"))
    hits = _seeds(blocks, families, ["doc_id", "base"], lambda lengths: F.lit(True)).join(
        wanted, ["family", "covers", "seed"])

    # the window slides along the alignment so that it holds the seed and stays inside both texts
    shift = F.col("at") - F.col("item_at")
    length = F.least(F.lit(window), F.col("item_size"))
    lo = F.greatest(F.col("item_at") + F.col("covers") - length, F.lit(0), -shift)
    hi = F.least(F.col("item_at"), F.col("item_size") - length, F.size("words") - shift - length)
    placed = hits.select("doc_id", "item_id", "base", "words", "near", "near_from", shift.alias("shift"),
                         length.alias("length"), lo.alias("lo"), hi.alias("hi"))
    same = F.expr("if(lo <= hi, transform(sequence(lo, hi), i -> struct("
                  "aggregate(sequence(0, length - 1), 0, (n, j) -> n + if(get(words, i + j + shift) = "
                  "get(near, i + j - near_from), 1, 0)) as matched, -(i + shift + base) as place)), null)")
    best = placed.select("doc_id", "item_id", "length", F.array_max(same).alias("m"))
    enough = F.col("m.matched") >= F.ceil(F.lit(similarity) * F.col("length"))
    # filtered after the aggregate, so that the join above stays one piece of generated code
    top = best.groupBy("doc_id", "item_id").agg(F.max(F.when(enough, F.struct(
        F.col("m.matched").alias("matched"), F.col("m.place").alias("place"), "length"))).alias("b"))
    return top.filter("b is not null").select(
        "doc_id", "item_id", (-F.col("b.place")).alias("doc_start"), F.col("b.length").alias("window_words"),
        F.col("b.matched").alias("matched_words"))
