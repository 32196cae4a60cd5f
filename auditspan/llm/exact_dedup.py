"""Exact deduplication by skew-safe combining, in DataFrame functions only.

Two texts are equal when they are identical after every space and ``\\t \\n \\v \\f \\r`` is
deleted.  Of equal texts the row with the most code points stays, then the smallest doc_id.

1. Local: each task combines its own copies of a content (the map side of the aggregate).
2. Salted: what the tasks hand on is merged by (digest, salt, content); the salt is
   the task, so a content that stands in every task goes to many reducers, one row a task.
3. Global: the winners of the salts are combined by (digest, content).

The content is a grouping key of every step, next to its digest, so texts are compared in full
and no digest is trusted.  The rows themselves move without their texts: they meet the groups by digest.  Should
different contents ever share a digest, those rows alone are decided by their content.

Rows: one per input row.  A null text counts as empty; all empty texts are one group.  A null
id comes after all others.  Of rows with the same id and the same number of code points exactly one
stays.  ``doc_id`` may have any type that can be ordered; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditspan.llm.tasks import kept_table

#: reducers that the tasks' copies of one content are spread over, and parts of a group's rows
SALTS = 32
#: 2**65: more than there are long values, and one more for a null id
_SHIFT = "36893488147419103232"


def normalised(text: str = "text") -> Column:
    """The text without white space."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256(content: Column) -> Column:
    """32 bytes for a content."""
    return F.unhex(F.sha2(content, 256))


def _is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _place(kind: T.DataType) -> Column:
    """What orders the rows of a group: the smallest stays.

    Integer ids and lengths fit one decimal, which a hash aggregate can update in place.
    """
    if _is_integer(kind):
        return F.expr(f"coalesce(cast(doc_id as decimal(20,0)), cast(9223372036854775808 as decimal(20,0)))"
                      f" - cast(n as decimal(11,0)) * cast({_SHIFT} as decimal(21,0))").cast("decimal(38,0)")
    return F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))


def _id_of(kind: T.DataType, place: str) -> Column:
    """The id in a place."""
    if not _is_integer(kind):
        return F.col(f"{place}.id")
    # ids lie between -2**63 and 2**63, the last stands for null
    moved = F.expr(f"pmod({place} + cast(9223372036854775808 as decimal(20,0)), cast({_SHIFT} as decimal(21,0)))")
    value = moved - F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(moved < F.lit("18446744073709551616").cast("decimal(21,0)"), value.cast(kind))


def _groups(rows: DataFrame, key: list[str]) -> DataFrame:
    """(digest, content, place, size) of every content, combined in a task, by salt, then globally."""
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")
    salted = rows.select(*key, salt, "place").groupBy(*key, "salt").agg(
        F.min("place").alias("place"), F.count(F.lit(1)).alias("size"))
    return salted.groupBy(*key).agg(F.min("place").alias("place"), F.sum("size").alias("size"))


def _decided(rows: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    """(digest, place, keep, size, kept) of every row.

    Rows that nothing tells apart are counted per task and dealt out again at the end, so no
    key holds more than a task's rows.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    same = Window.partitionBy(*key, "place")
    counted = (rows.select(*key, "place", F.spark_partition_id().alias("task")).groupBy(*key, "place", "task")
               .agg(F.count(F.lit(1)).cast("int").alias("copies")))
    counted = counted.withColumn("first", F.min("task").over(same) == F.col("task"))
    counted = counted.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(SALTS)).cast("int"))
    shared = groups.filter("size > 1").select(*key, F.col("place").alias("keep"), "size", salts)
    found = counted.join(shared, [*key, "salt"], "left")
    found = found.select("digest", "place", F.coalesce("keep", "place").alias("keep"),
                         F.coalesce("size", F.lit(1)).cast("long").alias("size"), "first",
                         F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return found.select("digest", "place", "keep", "size",
                        (F.col("first") & (F.col("copy") == 1) & (F.col("keep") == F.col("place"))).alias("kept"))


def duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) of every row.

    ``digest`` only divides the work: whatever it returns, contents are compared in full.
    """
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", normalised().alias("content"),
                       F.length(F.coalesce("text", F.lit(""))).alias("n"))
    rows = rows.select(digest(F.col("content")).alias("digest"), "content", _place(kind).alias("place"))
    contents = _groups(rows, ["digest", "content"])
    # without the texts; a digest of several contents is no key for them
    groups = kept_table(contents.select("digest", "place", "size"), "groups")
    several = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("digest")
    if several.isEmpty():
        found = _decided(rows, groups, ["digest"])
    else:
        several = kept_table(several, "several")
        found = _decided(rows.join(several, "digest", "left_anti"), groups.join(several, "digest", "left_anti"),
                         ["digest"])
        found = found.union(_decided(rows.join(several, "digest", "left_semi"),
                                     contents.join(several, "digest", "left_semi"), ["digest", "content"]))
    return found.select(_id_of(kind, "place").alias("doc_id"), _id_of(kind, "keep").alias("keep_id"),
                        F.col("size").alias("group_size"), "kept", "digest")


__all__ = ["duplicates", "normalised", "sha256"]
