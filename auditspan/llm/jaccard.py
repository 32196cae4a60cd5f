"""N-gram Jaccard join: grouped prefix join, answered with connected classes.

A document is the set of its distinct ``width``-word shingles (words of lower-cased
A-Z; a text with fewer words is one shingle, the whole sequence).  Two documents link
when 100 * common >= percent * all.

1. A merged count-min sketch of shingles orders them, rare ones first; a text that stands in several rows is
   counted once.  Linked documents share a shingle within their prefixes, the first
   n - ceil(percent * n / 100) + 1 shingles in this order.  A shingle counted once
   stands nowhere else; it fills its place in the prefix but needs no look-up.  Where there are more
   shingles than cells, only those whose hash is below a border are counted, and the prefix
   takes them first: any order does, as long as it is the same for all documents.
2. Documents with equal sets become one member.  Members with equal size and
   equal prefix are collapsed into one group, and the groups, not the members, are listed under
   the shingles of the prefix; shingles that only one member has are dropped, and lists with the same first member are one.
   A list is cut where the next size is too large to link with any before.
3. A list's groups are expanded and their members verified against each other in blocks: a
   list of many members is cut into parts, every pair of parts is one unit of work, and no
   unit holds more than two parts.  A fixed part of each set, the shingles of least hash, first rules out members that differ
   too much for any link; equal remainders of units become one.  Only members that are left are read again, one text each, and texts,
   which compress, are dealt to the units instead of hashes, which do not.  A unit hands on only as many links as
   connect its members, at most one fewer than they are.
4. Linked members are joined into classes; every document gets its class.

Rows: one per input row, repeated rows too.  Null and empty texts have no shingles and are linked
with nothing.  Documents with a null id count as members but never name a class; a class of such documents alone has a null id.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditspan.llm.arrays import signed, windows, words
from auditspan.llm.components import components
from auditspan.llm.sketch import Sketch, bits_for, merged_sketch
from auditspan.llm.tasks import kept_table, map_rows, utf8

#: counts that tell classes of frequency apart, rare to frequent
CLASSES = (2, 16, 200)
#: the tables of the higher classes have a quarter of the cells
FOLDS = (0, 2, 2)
#: where shingles that are not counted stand between the classes
UNCOUNTED = 2.5
#: greatest size of the sketch of shingles: 2**30 cells are 192 MiB for all classes
MOST_BITS = 30
#: a part of a set is so many times the share in which linked sets may differ
PART_TIMES = 2.5
#: cells for each value in a line of a table of marks
KEY_CELLS = 16
#: members of one part of a shingle's list
PART = 500
#: tasks that the rows of one class are spread over when they get its name
SALTS = 16
#: columns of the table of common shingles that are multiplied at once
COLUMNS = 4096


def shingles(data: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    hashes = words(data or b"", lower=True)[0]
    return np.unique(windows(hashes, min(width, len(hashes)))) if len(hashes) else hashes


def short(own: np.ndarray) -> np.ndarray:
    """Distinct ends of hashes: two sets share no more hashes than ends and hashes without an end of their own."""
    return np.unique(own.astype(np.uint32))


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n shingles with one it links to."""
    return -(-percent * n // 100)


def linked_roots(sets: list[np.ndarray], sizes: np.ndarray, percent: int, rest: np.ndarray | None = None) -> np.ndarray:
    """For every set the first set it is connected with by links among these sets.

    ``sets`` may leave out shingles that no other set has; ``sizes`` are the true sizes.  ``rest`` counts other shingles
    that are left out of each set: as many of them as two sets can share then count as shared.
    """
    m = len(sets)
    root = np.arange(m)
    rest = np.zeros(m, np.int64) if rest is None else rest
    if m == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True)) + min(rest)
        root[1] = 0 if 100 * common >= percent * (sizes[0] + sizes[1] - common) else 1
        return root
    values, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    shared = times[inverse] > 1
    number = np.cumsum(times > 1) - 1
    column, owner = number[inverse[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((m, m), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        table = np.zeros((m, COLUMNS), np.float32)
        table[owner[a:b], column[a:b] - first] = 1
        common += table @ table.T
    common += np.minimum(rest[:, None], rest[None, :])
    total = sizes[:, None] + sizes[None, :] - common
    link = 100 * common >= percent * total
    np.fill_diagonal(link, True)
    seen = np.zeros(m, bool)
    for i in range(m):
        if seen[i]:
            continue
        front = np.zeros(m, bool)
        front[i] = True
        member = front.copy()
        while front.any():
            front = link[front].any(0) & ~member
            member |= front
        root[member] = i
        seen |= member
    return root


def _texts(rows: DataFrame) -> tuple[Sketch | None, int]:
    """Bit table of the marks of each text's first row and the digests of repeated texts, and the bytes of all texts once.

    None if no text is repeated.  The first row of a text is one of its rows with the least mark.
    """
    texts = kept_table(
        rows.groupBy("digest", F.xxhash64(F.lit(1), "text").alias("more"))
        .agg(F.min("mark").alias("mark"), F.max(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .select("mark", F.when(F.col("rows") > 1, F.col("digest")).alias("digest"), "bytes"), "texts")
    several, n, size = texts.agg(F.count("digest"), F.count(F.lit(1)), F.sum(F.col("bytes").cast("long"))).first()
    if not several:
        return None, size or 0

    def values(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for column in batch.select(["mark", "digest"]).columns:
            yield column.drop_null().to_numpy().view(np.uint64)

    return merged_sketch(texts, values, bits=bits_for(KEY_CELLS * (n + several)), lines=2, thresholds=(1,)), size or 0


def _has(table: Sketch | None, batch: pa.RecordBatch, name: str, without: bool) -> np.ndarray:
    """Whether the table may hold the values of a column; ``without`` if there is no table."""
    if table is None:
        return np.full(batch.num_rows, without)
    return table.at_least(batch.column(name).to_numpy().view(np.uint64), 0)


def _node(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _members(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, mark, digest, n, node, prefix, part) of every row.

    ``node`` names the set (null if the row can link with nothing), ``prefix`` its look-up
    shingles (null if it can only link with equal sets), ``part`` the ends of its shingles of least hash.
    """
    spark = rows.sparkSession
    texts, size = _texts(rows)
    # about one shingle for each six bytes
    bits = bits_for(size // 10, MOST_BITS)
    share = max((1 << bits) / max(1, size // 6), 2 * (100 - percent) / 100)
    border = np.uint64(int(share * 2**64)) if share < 1 else None
    known = spark.sparkContext.broadcast(texts)
    # linked sets differ in (100 - percent) / (100 + percent) of their shingles at most; unlike ones in all of a part
    part_border = np.uint64(int(min(0.5, PART_TIMES * (100 - percent) / (100 + percent)) * 2**64))

    def counted(own: np.ndarray) -> int:
        return len(own) if border is None else int(np.searchsorted(own, border))

    def all_shingles(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        first = _has(known.value, batch, "mark", True)
        for data in utf8(batch.column("text").filter(pa.array(first))):
            own = shingles(data, width)
            yield own[:counted(own)]

    sent = spark.sparkContext.broadcast(merged_sketch(
        rows.select("text", "mark"), all_shingles, bits=bits, lines=1, thresholds=CLASSES, folds=FOLDS))
    kind = dict(rows.dtypes)["doc_id"]

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = sent.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for data, copied in zip(utf8(batch.column("text")), _has(known.value, batch, "digest", False).tolist()):
                own = shingles(data, width)
                n = len(own)
                level = np.full(n, UNCOUNTED)
                some = own[:counted(own)]
                often = sketch.at_least(some, 0)
                level[:len(some)] = often
                rest = np.flatnonzero(often)
                for c in range(1, len(CLASSES)):
                    level[rest] += sketch.at_least(some[rest], c)
                prefix = np.lexsort((own, level))[:n - needed(n, percent) + 1] if n else np.zeros(0, np.int64)
                prefix = prefix[level[prefix] > 0]
                out[0].append(n)
                out[1].append(_node(own) if len(prefix) or n and copied else None)
                out[2].append(np.sort(signed(own[prefix])).tolist() if len(prefix) else None)
                out[3].append(short(own[:np.searchsorted(own, part_border)]).tobytes() if len(prefix) else None)
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "mark", "digest")), *[pa.array(c, k) for c, k in zip(out, kinds)]],
                ["doc_id", "mark", "digest", "n", "node", "prefix", "part"])

    members = kept_table(map_rows(rows.select("doc_id", "mark", "digest", "text"), ordered,
                                  f"doc_id {kind}, mark long, digest long, n long, node binary, prefix array<long>, "
                                  "part binary"),
                         "members")
    sent.destroy()
    known.destroy()
    return members


def _read_again(rows: DataFrame, members: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, node, text): a text of every node, for each of its units."""
    chosen = kept_table(units.select("node").distinct().join(
        members.filter("prefix is not null").groupBy("node").agg(F.min(F.struct("mark", "digest")).alias("row")), "node")
        .select("node", "row.*"), "chosen")

    def values(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield batch.column("mark").to_numpy().view(np.uint64)

    table = rows.sparkSession.sparkContext.broadcast(
        merged_sketch(chosen.select("mark"), values, bits=bits_for(KEY_CELLS * chosen.count()), lines=2, thresholds=(1,)))

    def chosen_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_has(table.value, batch, "mark", True)))

    # the table lets a few other rows pass; they meet no node
    texts = map_rows(rows.select("mark", "digest", "text"), chosen_rows, "mark long, digest long, text string")
    return (units.join(chosen, "node").join(texts.dropDuplicates(["mark", "digest"]), ["mark", "digest"])
            .select("unit", "node", "text"))


def _by_unit(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], member: Callable, close: Callable,
             kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows that ``close`` makes of the members of each unit; a member that is None is left out."""
    out: list[tuple] = []
    held: list[tuple] = []
    now = None

    def made() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(kinds)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

    for batch in batches:
        columns = [utf8(batch.column(c)) if c == "text" else batch.column(c).to_pylist() for c in ("unit", *names)]
        for unit, *row in zip(*columns):
            if unit != now:
                if len(held) > 1:
                    out.extend(close(held))
                held, now = [], unit
                if len(out) >= 10_000:
                    yield made()
            if (one := member(*row)) is not None:
                held.append(one)
    if len(held) > 1:
        out.extend(close(held))
    yield made()


def _links(rows: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links that connect the nodes of every class."""
    listing = members.filter("prefix is not null").withColumn("group", F.xxhash64("n", "prefix"))
    # groups: equal size and equal prefix; a shingle is listed once for each group
    groups = (listing.select("node", "group", "n", "prefix").dropDuplicates(["node"])
              .groupBy("group", "n", "prefix").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("head")))
    listed = groups.select("group", "n", "size", "head", F.explode("prefix").alias("shingle"))
    # shingles whose lists begin with the same member are one list: near copies share most of their shingles
    lists = (listed.groupBy("shingle").agg(F.sum("size").alias("members"), F.min("head").alias("list"))
             .filter("members > 1").select("shingle", "list"))
    listed = kept_table(listed.join(lists, "shingle").select("list", "group", "n", "size").distinct(), "lists")
    # a list ends where the next size is too large to link with any before
    by_size = Window.partitionBy("list").orderBy("n")
    sizes = (listed.groupBy("list", "n").agg(F.sum("size").alias("here"))
             .withColumn("cut", (100 * F.lag("n").over(by_size) < percent * F.col("n")).cast("int"))
             .withColumn("run", F.coalesce(F.sum("cut").over(by_size), F.lit(0))))
    runs = sizes.groupBy("list", "run").agg(F.sum("here").alias("members")).filter("members > 1")
    sizes = sizes.join(runs, ["list", "run"]).select("list", "n", "run", "members")
    # expand: the members of each listed group, in parts
    places = (listed.select("list", "group", "n").join(sizes, ["list", "n"])
              .join(listing.select("group", "n", "node").distinct(), ["group", "n"])
              .select("list", "run", "members", "node"))
    parts = F.ceil(F.col("members") / PART).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(3)), parts).cast("int")
    units = places.select("list", "run", "node", own.alias("own"),
                          F.explode(F.sequence(F.lit(0), parts - 1)).alias("with"))
    units = units.select("node", F.xxhash64("list", "run", F.least("own", "with"), F.greatest("own", "with"))
                         .alias("unit"))
    parts = listing.select("node", "n", "part").dropDuplicates(["node"])

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def member(node: bytes, n: int, part: bytes) -> tuple:
            return node, n, np.frombuffer(part, np.uint32)

        def close(held: list[tuple]) -> Iterator[tuple]:
            sizes, own = np.array([h[1] for h in held], np.int64), [h[2] for h in held]
            root = linked_roots(own, sizes, percent, sizes - [len(s) for s in own])
            for r in np.flatnonzero(np.bincount(root, minlength=len(held)) > 1):
                group = [held[i][0] for i in np.flatnonzero(root == r)]
                key = int.from_bytes(hashlib.blake2b(b"".join(group), digest_size=8).digest(), "big", signed=True)
                yield from ((key, node) for node in group)

        return _by_unit(batches, ("node", "n", "part"), member, close, {"unit": pa.int64(), "node": pa.binary()})

    # members that may be linked, by what a part of their sets shows; the same members are one unit
    units = kept_table(map_rows(
        units.join(parts, "node").repartition("unit").sortWithinPartitions("unit", "node"), possible,
        "unit long, node binary").distinct(), "units")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def member(node: bytes, data: bytes) -> tuple | None:
            own = shingles(data, width)
            # another text may have the same mark
            return (node, own) if _node(own) == node else None

        def close(held: list[tuple]) -> Iterator[tuple]:
            sets = [h[1] for h in held]
            root = linked_roots(sets, np.array([len(s) for s in sets], np.int64), percent)
            yield from ((held[r][0], held[i][0]) for i, r in enumerate(root.tolist()) if r != i)

        return _by_unit(batches, ("node", "text"), member, close, {"a": pa.binary(), "b": pa.binary()})

    dealt = _read_again(rows, members, units)
    return map_rows(dealt.repartition("unit").sortWithinPartitions("unit", "node"), verify, "a binary, b binary")


def near_duplicate_classes(docs: DataFrame, *, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    ``component_id`` is the smallest doc_id that links lead to, the row's own included.
    """
    # a row is known by its mark wherever texts are read again; rows with one mark are taken together
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"),
                       F.xxhash64(F.lit(2), "doc_id", "text").alias("mark"))
    members = _members(rows, width, percent)
    roots = components(_links(rows, members, width, percent))
    # rows that can link with nothing keep clear of the joins, where they would all have the key null
    alone = members.filter("node is null").select("doc_id", F.col("n").alias("n_shingles"),
                                                  F.col("doc_id").alias("component_id"))
    # a set or a class may hold a third of all rows: their rows meet one copy of the answer per salt
    rows = members.filter("node is not null").select(
        "doc_id", "n", "node", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    rows = rows.join(roots.select("node", "root", salts), ["node", "salt"], "left").select(
        "doc_id", "n", "salt", F.coalesce("root", "node").alias("class"))
    least = (rows.groupBy("class").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
             .filter("rows > 1").select("class", "least", salts))
    named = rows.join(least, ["class", "salt"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
    return alone.union(named)


__all__ = ["near_duplicate_classes", "shingles", "linked_roots"]
