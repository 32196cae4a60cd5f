"""Fill-in-the-middle rewriting of texts, cut with an indexable skip list.

A text is a list of units (code points unless a pattern is given).  The skip list holds
nodes of a few units on its bottom lane; every express lane above skips over more of them.
Each link carries two widths, how many units and how many code points it spans, so
descending from the top lane while the accumulated units do not pass a rank reaches the
place of any unit, and its code point, in about log(n) steps.

Rows: one per input row, repeated rows too.  A null text counts as empty, a null id as an
empty one.  A text that is empty or holds a marker stays as it is.  Texts of any length are cut whole.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspan.llm.tasks import map_rows

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: units of a node on the bottom lane, and links of a lane that one link of the next lane spans
NODE, LANE = 32, 8


class SkipList:
    """Units of a text by rank; ``lengths`` are the code points of each unit."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        units = len(lengths)
        starts = np.arange(0, units, NODE)
        widths = np.full(len(starts), NODE, np.int64)
        if units:
            widths[-1] = units - starts[-1]
        #: lanes from the bottom: (units, code points) of each link
        self.lanes: list[tuple[np.ndarray, np.ndarray]] = [
            (widths, np.add.reduceat(lengths, starts, dtype=np.int64) if units else widths)]
        while len(self.lanes[-1][0]) > LANE:
            below = self.lanes[-1]
            heads = np.arange(0, len(below[0]), LANE)
            self.lanes.append((np.add.reduceat(below[0], heads), np.add.reduceat(below[1], heads)))

    def code_point(self, rank: int) -> int:
        """Code points before the unit with this rank (0 to the number of units)."""
        at = units = points = 0
        for unit_width, point_width in reversed(self.lanes):
            while at < len(unit_width) and units + unit_width[at] <= rank:
                units += int(unit_width[at])
                points += int(point_width[at])
                at += 1
            at *= LANE  # the same node, one lane below
        return points + int(self.lengths[units:rank].sum())


def unit_lengths(text: str, unit: regex.Pattern | None) -> np.ndarray:
    """Code points of every unit; what a pattern leaves out belongs to the unit before it."""
    if unit is None:
        return np.ones(len(text), np.int8)
    starts = [m.start() for m in unit.finditer(text) if m.end() > m.start()]
    if text and (not starts or starts[0] > 0):
        starts.insert(0, 0)
    return np.diff(np.array([*starts, len(text)], np.int64)) if text else np.zeros(0, np.int64)


def _hash(doc_id: str, number: int) -> Column:
    return F.conv(F.substring(F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256),
                              8 * number - 7, 8), 16, 10).cast("long")


def rewritten(docs: DataFrame, *, unit: str | None = None, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    ``n`` counts units, ``prefix_chars`` and ``middle_chars`` code points (null if plain).  Cuts and
    forms follow from the id alone.  ``unit`` is a pattern matched from left to right.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    compiled = None if unit is None else regex.compile(unit)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       *[_hash("doc_id", i).alias(f"h{i}") for i in (1, 2, 3, 4)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, h1, h2, h3, h4 in zip(*(batch.column(c).to_pylist() for c in ("text", "h1", "h2", "h3", "h4"))):
                lengths = unit_lengths(text, compiled)
                n, form, prefix, middle, output = len(lengths), "plain", None, None, text
                if text and h3 % 100 < 100 - plain_percent and not any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                    units = SkipList(lengths)
                    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
                    prefix, end = units.code_point(first), units.code_point(last)
                    middle, form = end - prefix, "spm" if h4 % 100 < spm_percent else "psm"
                    head, body, tail = text[:prefix], text[prefix:end], text[end:]
                    output = (f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{body}" if form == "spm" else
                              f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{body}")
                for column, value in zip(out, (n, form, prefix, middle, output)):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(out, kinds)]],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_rows(rows, cut, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from; no marker can stand in its parts or across their ends."""
    whole, kind = F.col(output), F.col(form)
    second = F.when(kind == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    # a marker's first and last sign stand nowhere else in it, so the first find is the true one
    body = F.substr(whole, F.lit(len(PREFIX) + 1))
    at = F.locate(MIDDLE, F.col(output))
    split = F.instr(body, second)
    left = F.substr(body, F.lit(1), split - 1)
    right = F.substr(body, split + len(PREFIX), at - split - 2 * len(PREFIX))
    middle = F.substr(whole, at + len(MIDDLE))
    return F.when(kind == "psm", F.concat(left, middle, right)).when(
        kind == "spm", F.concat(right, middle, left)).otherwise(whole)


__all__ = ["SkipList", "restored", "rewritten", "unit_lengths"]
