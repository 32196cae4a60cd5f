"""Count-min sketches built part by part and merged by Spark.

Every task counts the hashes of its own rows in a sketch of ``rows`` lines of
``2**bits`` cells; the parts are merged by adding cell by cell, each block of cells
in the one task it is dealt to.  What is sent back to the tasks is one bit a cell and
threshold: whether the merged count reaches it.  The estimate, the least
count over the lines, is never below the true count, so a test for "at least t"
misses nothing.  The bit tables have a fixed greatest size, whatever the input.
The table of a threshold may be folded: 2**k neighbouring cells are added up first.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditspan.llm.arrays import mix
from auditspan.llm.tasks import map_rows

BLOCK_BITS = 16
#: greatest size of a line: 2**28 cells are 32 MiB a threshold and line
MOST_BITS = 28
LEAST_BITS = 18
#: hashes that a task counts before it hands its counts on
FLUSH = 2_000_000
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)


def bits_for(cells: int, most: int | None = None) -> int:
    return min(most or MOST_BITS, max(LEAST_BITS, int(cells).bit_length()))


def cells_of(hashes: np.ndarray, line: int, bits: int) -> np.ndarray:
    return (mix(hashes ^ np.uint64(_SEEDS[line])) >> np.uint64(64 - bits)).astype(np.int64)


class Sketch:
    """Bit tables by line and threshold; tests hashes by the merged counts."""

    def __init__(self, bits: int, thresholds: tuple[int, ...], tables: list[list[np.ndarray]], folds: tuple[int, ...]):
        self.bits, self.thresholds, self.tables, self.folds = bits, thresholds, tables, folds

    def at_least(self, hashes: np.ndarray, which: int) -> np.ndarray:
        """Whether the estimate reaches thresholds[which]."""
        out = np.ones(len(hashes), bool)
        for line, tables in enumerate(self.tables):
            cell = cells_of(hashes, line, self.bits) >> self.folds[which]
            out &= (tables[which][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
        return out


def merged_sketch(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], *, bits: int, lines: int,
                  thresholds: tuple[int, ...], folds: tuple[int, ...] | None = None) -> Sketch:
    """Sketch of all arrays that ``hashes`` gives for the batches of ``df``; ``folds`` has the k of each threshold."""
    folds = folds or (0,) * len(thresholds)
    names, kinds = ["line", "block", "cells", "counts"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for part in hashes(batch):
                held.append(part)
                size += len(part)
                if size >= FLUSH:
                    yield flush(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield flush(np.concatenate(held))

    def flush(values: np.ndarray) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for line in range(lines):
            cells, counts = np.unique(cells_of(values, line, bits), return_counts=True)
            counts = np.minimum(counts, 255).astype(np.uint8)
            blocks, first = np.unique(cells >> BLOCK_BITS, return_index=True)
            offsets = (cells & ((1 << BLOCK_BITS) - 1)).astype(np.uint16)
            for block, a, b in zip(blocks.tolist(), first.tolist(), [*first[1:].tolist(), len(cells)]):
                out[0].append(line)
                out[1].append(block)
                out[2].append(offsets[a:b].tobytes())
                # counts of one are not sent
                out[3].append(counts[a:b].tobytes() if (counts[a:b] > 1).any() else b"")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        out: list[list] = [[], [], []]

        def close():
            out[0].append(now[0])
            out[1].append(now[1])
            out[2].append(b"".join(np.packbits(total.reshape(-1, 1 << k).sum(1) >= t).tobytes()
                                   for t, k in zip(thresholds, folds)))

        for batch in batches:
            for line, block, cells, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if (line, block) != now:
                    if now is not None:
                        close()
                    now, total = (line, block), np.zeros(1 << BLOCK_BITS, np.int64)
                at = np.frombuffer(cells, np.uint16)
                total[at] += np.frombuffer(counts, np.uint8) if counts else 1
        if now is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int32(), pa.binary()))], ["line", "block", "bits"])

    parts = map_rows(df, count, "line int, block int, cells binary, counts binary")
    merged = map_rows(parts.repartition("line", "block").sortWithinPartitions("line", "block"), merge,
                      "line int, block int, bits binary").toArrow()
    sizes = [1 << BLOCK_BITS - 3 - k for k in folds]
    tables = [[np.zeros(max(size, 1 << max(0, bits - 3 - k)), np.uint8) for size, k in zip(sizes, folds)]
              for _ in range(lines)]
    for batch in merged.to_batches():
        for line, block, packed in zip(*(c.to_pylist() for c in batch.columns)):
            whole, at = np.frombuffer(packed, np.uint8), 0
            for table, size in zip(tables[line], sizes):
                table[block * size:(block + 1) * size] = whole[at:at + size]
                at += size
    return Sketch(bits, thresholds, tables, folds)
