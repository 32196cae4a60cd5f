"""Substring deduplication: every word covered by a window that starts anywhere else goes.

A window is ``width`` consecutive words of one document.  Two passes:

1. Count-min prefilter.  A window's key is the least hash of the ``width // 2 + 1``-word
   spans inside it, so equal windows have equal keys; neighbours mostly
   share one, and a run of windows with one key is counted once (twice when a
   window repeats inside the document).  Each task counts keys in a sketch, the
   sketches are merged, and a window whose estimate is one is settled: it starts nowhere else.
2. The other windows, still packed by runs, are dealt by key and grouped exactly by
   (key, window hash).  Keys that the sketch holds to be very frequent are dealt over
   ``SALTS`` tasks first; what is single there meets one witness of every other salt.

Positions of repeated windows go back to their documents, and each text moves once.

Rows: one per input row, repeated rows too (they repeat each other).  A null text has no words.
Texts with fewer than ``width`` words lose nothing.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditspan.llm.arrays import signed, sliding_min, windows, words
from auditspan.llm.sketch import bits_for, merged_sketch
from auditspan.llm.tasks import kept_table, map_rows, text_bytes, text_key, utf8

WIDTH = 35
#: a key counted that often is dealt over SALTS tasks
HOT = 200
SALTS = 64


def keyed_windows(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every window, and first window and key of every run of windows with one key."""
    hashes = words(data)[0]
    found = windows(hashes, width)
    if not len(found):
        return found, np.zeros(0, np.int64), found
    inner = width // 2 + 1
    keys = sliding_min(windows(hashes, inner), width - inner + 1)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return found, first, keys[first]


def repeats_inside(found: np.ndarray) -> np.ndarray | None:
    """Which windows occur twice in the document itself, or None when none does."""
    _, inverse, times = np.unique(found, return_inverse=True, return_counts=True)
    return (times > 1)[inverse] if len(times) < len(found) else None


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, key, starts): for each document that has any, the places of repeated windows.

    ``key`` is ``text_key`` of the text.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", text_key().alias("key")).filter("text is not null")
    # about one run of windows for each nine words of six bytes; four cells a run
    bits = bits_for(text_bytes(docs) // 14)

    def run_keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for data in utf8(batch.column("text")):
            found, first, keys = keyed_windows(data, width)
            yield keys
            twice = repeats_inside(found) if len(found) else None
            if twice is not None:
                yield keys[np.logical_or.reduceat(twice, first)]

    sent = spark.sparkContext.broadcast(
        merged_sketch(rows.select("text"), run_keys, bits=bits, lines=2, thresholds=(2, HOT)))
    kind = dict(docs.dtypes)["doc_id"]

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, turn = sent.value, 0
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, key, data in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(),
                                         utf8(batch.column("text"))):
                found, first, keys = keyed_windows(data, width)
                if not len(found):
                    continue
                again = np.flatnonzero(sketch.at_least(keys, 0))
                hot = sketch.at_least(keys[again], 1)
                ends = np.append(first[1:], len(found))
                for i, is_hot in zip(again.tolist(), hot.tolist()):
                    turn += is_hot
                    values = (int(signed(keys[i:i + 1])[0]), turn % SALTS if is_hot else -1, doc_id, key,
                              int(first[i]), signed(found[first[i]:ends[i]]).tolist())
                    for column, value in zip(out, values):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), batch.schema.field("doc_id").type, pa.int64(), pa.int32(),
                     pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], ["run", "salt", "doc_id", "key", "first", "windows"])

    runs = kept_table(map_rows(rows, suspects, f"run long, salt int, doc_id {kind}, key long, first int, "
                                               "windows array<long>"), "windows")
    # dealt before the windows are unpacked: a run of them moves as one row
    each = runs.repartition("run", "salt").select("run", "salt", "doc_id", "key", "first", F.posexplode("windows").alias("place", "window"))
    same = Window.partitionBy("run", "salt", "window")
    each = each.select("run", "salt", "doc_id", "key", (F.col("first") + F.col("place")).alias("start"), "window",
                       F.count(F.lit(1)).over(same).alias("n"))
    direct = each.filter("n > 1").select("doc_id", "key", "start")
    # hot keys: what is single in its salt meets one witness of each other salt
    witness = (each.filter("salt >= 0").groupBy("run", "window", "salt")
               .agg(F.max("n").alias("n"), F.max(F.struct("doc_id", "key", "start")).alias("w")))
    salts = Window.partitionBy("run", "window")
    spread = (witness.withColumn("salts", F.count(F.lit(1)).over(salts)).filter("n = 1 and salts > 1")
              .select("w.doc_id", "w.key", "w.start"))
    return direct.union(spread).groupBy("doc_id", "key").agg(F.collect_set("start").alias("starts"))


def deduplicated(docs: DataFrame, *, width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of every row.

    ``kept_text`` is the words that stay, joined by one space; null without ``with_text``.
    """
    found = repeated_windows(docs, width)
    rows = docs.select("doc_id", "text", text_key().alias("key"))
    joined = rows.alias("a").join(
        found.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")), "left"
    ).select("a.doc_id", "a.text", "b.starts")
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for data, starts in zip(utf8(batch.column("text")), batch.column("starts")):
                parts = (data or b"").split()  # bytes split at the white space of a word's definition
                removed = 0
                if starts.is_valid:
                    at = starts.values.to_numpy(zero_copy_only=False)
                    edge = np.zeros(len(parts) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + width, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    removed = int(len(parts) - keep.sum())
                    kept = b" ".join(compress(parts, keep.tolist()))
                else:
                    kept = b" ".join(parts)
                out[0].append(len(parts))
                out[1].append(removed)
                out[2].append(hashlib.sha256(kept).hexdigest())
                out[3].append(kept.decode() if with_text else None)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(out, kinds)]],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return map_rows(joined, cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
