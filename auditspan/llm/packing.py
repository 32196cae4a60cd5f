"""Packing: shortest-pack-first over the length histogram.

A document's token ids, with an end id after them, are cut into full sequences and
one remainder.  How many remainders there are of each length decides everything
else: lengths are placed from the longest to the shortest, each into the shortest
pack it fits, by updating counts of packing patterns, never single documents.
Packs that stay underfull are then evened out: the emptiest are taken apart and
their pieces, cut where needed, fill the gaps of the others.  Documents meet the
patterns by rank: the j-th remainder of a length takes the j-th place of that length.

Sequences are padded to ``size``; one whose length is a power of two is not padded.

Rows: one per piece.  Repeated rows are packed one by one.  A null text counts as
empty and gives the end id alone.  Only the histogram (fewer than ``size`` numbers) reaches the driver.
"""
from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditspan.llm.arrays import span_classes
from auditspan.llm.tasks import kept_table, map_rows, utf8

SIZE = 1024
END_ID = 0
#: words of a generation whose ids a worker process remembers, about 250 bytes each
CACHE = 400_000
#: bytes of the longest words that are remembered
LONG = 64
#: bytes of texts whose words are gathered at once; longer texts are cut at a space
CHUNK = 1 << 19
#: rows of (task, length) that are sent to every executor
MOST_OFFSETS = 2_000_000


class Encoder:
    """Ids of texts by a tokenizer file, remembering those of words met before.

    A byte-level tokenizer never joins a word with the space after it, so a text is
    cut before every single space between two other characters, and before a line feed if the tokenizer
    keeps that apart too.  Many texts are taken at once: their
    words are sorted into classes of equal ones, each different word is looked up or encoded once,
    and the ids of all words are gathered from one array.  A word is kept with the sign before it; only those without
    other white space at their ends are remembered, and a text with others is encoded in larger parts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        around = [("a", "b"), ("a.", "B"), ("1", "("), (")", "1"), ("a,", "\u00e9"), ("$", "$")]
        #: the signs that words are cut before
        self.cuts = b" \n" if all(
            self._list(x + "\n" + y) == self._list(x) + self._list("\n" + y) for x, y in around) else b" "
        #: ids of tokens that begin with one: the first of every word after the head of a text
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        signs = ("\u0120", "\u010a")[:len(self.cuts)]
        self.begins[[i for token, i in vocabulary.items() if token.startswith(signs)]] = True
        self._first = re.compile(b"[" + self.cuts + b"]")
        # two generations: when the young one is full it becomes the old one
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.heads: dict[bytes, bytes] = {}
        self.end = np.array([END_ID], np.uint32).tobytes()

    def _list(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self._list(text), np.uint32)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word with the sign before it, from one call."""
        ids = self._encode("".join(words))
        cuts = np.flatnonzero(self.begins[ids])
        if len(cuts) != len(words) or cuts[0] != 0:  # a tokenizer that writes spaces in another way
            return [self._encode(w).tobytes() for w in words]
        data, at = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
        return [data[x:y] for x, y in zip(at, at[1:])]

    def _head(self, word: bytes) -> bytes | None:
        """Ids of a word that begins a text; None if white space stands at its end."""
        known = self.heads.get(word)
        if known is None:
            text = word.decode()
            if not text or text[-1].isspace():
                return None
            known = self._encode(text).tobytes()
            if len(self.heads) >= CACHE:
                self.heads.clear()
            if len(word) <= LONG:
                self.heads[word] = known
        return known

    def _ids_of(self, words: list[bytes]) -> list[bytes | None]:
        """Ids of different words with the sign before them; None for one with other white space at an end."""
        found = list(map(self.cache.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if not missing:
            return found
        fresh, new = {}, []
        for i, known in zip(missing, map(self.older.get, [words[i] for i in missing])):
            if known is None:
                new.append(i)
            else:
                found[i] = fresh[words[i]] = known
        whole = b"".join([words[i] for i in new]).decode()
        texts = [words[i].decode() for i in new]
        if len(whole.split()) != len(texts):  # white space other than the signs before the words
            plain = [len(t) > 1 and not t[1].isspace() and not t[-1].isspace() for t in texts]
            new, texts = [i for i, ok in zip(new, plain) if ok], [t for t, ok in zip(texts, plain) if ok]
        if new:
            for i, ids in zip(new, self._encode_words(texts)):
                found[i] = fresh[words[i]] = ids
        for word in [w for w in fresh if len(w) > LONG]:
            del fresh[word]
        if len(self.cache) + len(fresh) > CACHE:
            self.older, self.cache = self.cache, {}
        if len(fresh) <= CACHE:
            self.cache.update(fresh)
        return found

    def _gathered(self, parts: list[bytes]) -> list[bytes | None]:
        """Ids of every part's words from its first cut on; None for a part with other white space at a word's end."""
        data = b"".join(parts)
        whole = np.frombuffer(data, np.uint8)
        last = np.cumsum([len(p) for p in parts])
        starts = np.flatnonzero((whole == 32) | (whole == self.cuts[-1]))
        if not len(starts):
            return [b""] * len(parts)
        owner = np.searchsorted(last, starts, "right")
        ends = np.minimum(np.append(starts[1:], len(data)), last[owner])
        classes = span_classes(whole, starts, ends)
        if classes is None:
            return [None] * len(parts)  # two words with one hash
        first, inverse = classes
        found = self._ids_of([data[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist())])
        odd = np.zeros(len(parts), bool)
        if None in found:
            odd[owner[np.array([ids is None for ids in found])[inverse]]] = True
            found = [ids or b"" for ids in found]
        known = np.frombuffer(b"".join(found), np.uint32)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        before = np.cumsum(size) - size
        n = size[inverse]
        at = np.cumsum(n) - n
        ids = known[np.repeat(before[inverse] - at, n) + np.arange(at[-1] + n[-1])]
        edges = np.append(at, len(ids))[np.searchsorted(owner, np.arange(len(parts) + 1))]
        return [None if bad else ids[x:y].tobytes() for bad, x, y in zip(odd.tolist(), edges.tolist(), edges[1:].tolist())]

    def batch(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text, END_ID last; equal texts are encoded once."""
        different = list(dict.fromkeys(texts))
        parts, owner = [], []
        for number, text in enumerate(different):
            at = 0
            while at < len(text) or at == 0:
                end = text.find(b" ", at + CHUNK) if len(text) - at > CHUNK else -1
                end = len(text) if end < 0 else end
                parts.append(text[at:end])
                owner.append(number)
                at = max(end, 1)
        made: list[bytes | None] = []
        first = size = 0
        for i, part in enumerate(parts):
            size += len(part)
            if size >= CHUNK or i == len(parts) - 1:
                made += self._gathered(parts[first:i + 1])
                first, size = i + 1, 0
        rest: list[list[bytes | None]] = [[] for _ in different]
        for number, ids in zip(owner, made):
            rest[number].append(ids)
        found = {}
        for text, ids in zip(different, rest):
            cut = self._first.search(text)
            head = self._head(text if cut is None else text[:cut.start()])
            found[text] = (self._spaced(text.decode().split(" ")) if head is None or None in ids
                           else b"".join([head, *ids, self.end]))  # type: ignore[list-item]
        return [found[text] for text in texts]

    def ids(self, text: str) -> bytes:
        return self.batch([text.encode()])[0]

    def _spaced(self, words: list[str]) -> bytes:
        """A text with white space next to a space: its words stay together there."""
        head, *rest = self._joined(words)
        return b"".join([self._encode(head).tobytes(), *(self._encode(" " + w).tobytes() for w in rest), self.end])

    @staticmethod
    def _joined(words: list[str]) -> list[str]:
        """Words put together again where white space stands next to the space between them."""
        out, held = [], [words[0]]
        for before, word in zip(words, words[1:]):
            if before and word and not before[-1].isspace() and not word[0].isspace():
                out.append(" ".join(held))
                held = []
            held.append(word)
        return [*out, " ".join(held)]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder per worker process, so that what it remembers serves later tasks."""
    return Encoder(path)


@dataclass
class Lot:
    """``count`` packs of one pattern; a slot is (rest length, offset in it, piece length, first rank)."""

    count: int
    slots: list[tuple[int, int, int, int]] = field(default_factory=list)

    @property
    def total(self) -> int:
        return sum(s[2] for s in self.slots)

    def split(self, count: int) -> "Lot":
        """Take the first ``count`` packs off."""
        first = Lot(count, list(self.slots))
        self.slots = [(r, o, n, rank + count) for r, o, n, rank in self.slots]
        self.count -= count
        return first


class Packs:
    """Packing patterns by the space they have left."""

    def __init__(self, size: int):
        self.size = size
        self.open: dict[int, list[Lot]] = {}
        self.heap: list[int] = []
        self.full: list[Lot] = []

    def add(self, lot: Lot, space: int) -> None:
        if space == 0:
            self.full.append(lot)
            return
        if not self.open.get(space):
            heapq.heappush(self.heap, -space)
        self.open.setdefault(space, []).append(lot)

    def shortest(self) -> int:
        """The space of the shortest pack, 0 if there is none."""
        while self.heap and not self.open.get(-self.heap[0]):
            heapq.heappop(self.heap)
        return -self.heap[0] if self.heap else 0

    def place(self, unit: Lot, cut: bool) -> Lot | None:
        """Place pieces of one kind; with ``cut`` what a cut leaves over is returned."""
        (rest, offset, length, _), = unit.slots
        space = self.shortest()
        fits = space >= length
        if not fits and not (cut and space):
            copies = self.size // length  # new packs, each with as many copies as it holds
            count, copies = (unit.count // copies, copies) if unit.count >= copies else (1, unit.count)
            slots = [unit.split(count).slots[0] for _ in range(copies)]
            self.add(Lot(count, slots), self.size - copies * length)
            return unit if unit.count else None
        lots = self.open[space]
        lot = lots.pop()
        count = min(lot.count, unit.count)
        taken = lot.split(count) if lot.count > count else lot
        if taken is not lot:
            self.add(lot, space)
        piece = unit.split(count) if unit.count > count else unit
        more = unit if piece is not unit else None
        rank = piece.slots[0][3]
        part = length if fits else space
        taken.slots.append((rest, offset, part, rank))
        self.add(taken, space - part)
        if part < length:
            tail = Lot(count, [(rest, offset + part, length - part, rank)])
            return Lot(0, [tail, more]) if more else Lot(0, [tail])  # type: ignore[list-item]
        return more


def pack_histogram(counts: dict[int, int], size: int = SIZE) -> list[Lot]:
    """Patterns for ``counts[length]`` pieces of each length below ``size``."""
    packs = Packs(size)
    for length in sorted(counts, reverse=True):
        unit = Lot(counts[length], [(length, 0, length, 0)])
        while unit is not None and unit.count:
            unit = packs.place(unit, False)
    # even out: take the shortest packs apart until they can fill the gaps of the rest
    under = sorted(((lot.total, lot) for lots in packs.open.values() for lot in lots
                    if lot.total & (lot.total - 1)), key=lambda x: x[0])
    gaps = sum((size - total) * lot.count for total, lot in under)
    again = Packs(size)
    again.full = packs.full + [lot for lots in packs.open.values() for lot in lots if not lot.total & (lot.total - 1)]
    loose: list[tuple[int, int, Lot]] = []
    number = 0

    def push(lot: Lot) -> None:
        nonlocal number
        number += 1
        heapq.heappush(loose, (-lot.slots[0][2], number, lot))

    filled = 0
    for total, lot in under:
        if filled < gaps:
            # only as many packs as the gaps of the others need
            need = -(-(gaps - filled) // (size if size > total else total))
            lot_apart = lot.split(need) if lot.count > need else lot
            filled += total * lot_apart.count
            gaps -= (size - total) * lot_apart.count
            for slot in lot_apart.slots:
                push(Lot(lot_apart.count, [slot]))
            if lot_apart is lot:
                continue
        again.add(lot, size - total)
    while loose:
        unit = heapq.heappop(loose)[2]
        rest = again.place(unit, True)
        if rest is None:
            continue
        for part in (rest.slots if rest.count == 0 else [rest]):
            if part.count:
                push(part)
    return again.full + [lot for lots in again.open.values() for lot in lots]


def piece_table(lots: list[Lot]) -> tuple[dict, int]:
    """Per rest length: rank bounds and the pieces of the ranks between them; and the number of packs."""
    found: dict[int, list] = {}
    base = 0
    for lot in lots:
        at = 0
        for rest, offset, length, rank in lot.slots:
            found.setdefault(rest, []).append((rank, rank + lot.count, offset, length, base, at))
            at += length
        base += lot.count
    table = {}
    for rest, pieces in found.items():
        bounds = sorted({p[0] for p in pieces} | {p[1] for p in pieces})
        between: list[list] = [[] for _ in bounds]
        place = {b: i for i, b in enumerate(bounds)}
        for first, last, offset, length, start, at in pieces:
            for i in range(place[first], place[last]):
                between[i].append((offset, length, start - first, at))
        table[rest] = (np.array(bounds, np.int64), [sorted(b) for b in between])
    return table, base


def pack(docs: DataFrame, tokenizer_path: str, *, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of every piece.

    ``ids`` holds the piece's little-endian unsigned 32-bit ids; null without ``with_ids``.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = encoder_of(tokenizer_path), TaskContext.get().partitionId()
        wide = encoder.tokenizer.get_vocab_size() > 1 << 16
        ranks, full = [0] * size, 0
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for data in encoder.batch([text or b"" for text in utf8(batch.column("text"))]):
                ids = np.frombuffer(data, np.uint32)
                rest = len(ids) % size
                values = (len(ids), ids.tobytes() if wide else ids.astype(np.uint16).tobytes(), rest, ranks[rest], full)
                ranks[rest] += 1
                full += len(ids) // size
                for column, value in zip(out, values):
                    column.append(value)
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(out, kinds)],
                 pa.array([task] * batch.num_rows, pa.int32())],
                ["doc_id", "tokens", "packed", "rest", "rest_rank", "full_rank", "task"])

    # written once: ranks within a task hold only for the tasks that made them
    encoded = kept_table(map_rows(docs.select("doc_id", "text"), encode,
                                  f"doc_id {kind}, tokens long, packed binary, rest int, rest_rank long, "
                                  "full_rank long, task int"), "tokens")
    rests = encoded.filter("rest > 0").groupBy("task", "rest").agg(F.count(F.lit(1)).alias("n"))
    fulls = encoded.groupBy("task").agg(F.sum(F.expr(f"tokens div {size}")).alias("n")).select(
        "task", F.lit(0).alias("rest"), "n")
    counts = kept_table(rests.union(fulls), "ranks")
    histogram = {r.rest: r.n for r in counts.filter("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    table, packed = piece_table(pack_histogram(histogram, size))
    before = Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    few = counts.count() <= MOST_OFFSETS

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    placed = (encoded.join(sent(offsets.filter("rest > 0").select("task", "rest", F.col("before").alias("rest_before"))),
                           ["task", "rest"], "left")
              .join(sent(offsets.filter("rest = 0").select("task", F.col("before").alias("full_before"))), "task"))
    placed = placed.select("doc_id", "tokens", "packed", "rest",
                           (F.col("rest_rank") + F.coalesce("rest_before", F.lit(0))).alias("rank"),
                           (F.col("full_rank") + F.col("full_before")).alias("full"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, tokens, data, rest, rank, full in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(data, np.uint16 if len(data) == 2 * tokens else np.uint32)
                whole = tokens // size
                pieces = [(i * size, size, packed + full + i, 0) for i in range(whole)]
                if rest:
                    bounds, between = table[rest]
                    pieces += [(whole * size + offset, length, start + rank, at) for offset, length, start, at
                               in between[int(np.searchsorted(bounds, rank, "right")) - 1]]
                for start, length, sequence, at in pieces:
                    own = ids[start:start + length].astype("<u4").tobytes()
                    for column, value in zip(out, (doc_id, start, length, zlib.crc32(own), tokens, sequence, at,
                                                   own if with_ids else None)):
                        column.append(value)
            kinds = [batch.schema.field("doc_id").type, *[pa.int64()] * 6, pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return map_rows(placed, cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                                 "sequence_id long, offset long, ids binary")
