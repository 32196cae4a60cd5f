"""Bounded samples of labelled rows to fit a classifier on."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: hashes of ids are compared with thresholds of this range
RANGE = 1 << 30


def labelled_sample(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """(doc_id, label): at most ``per_label`` rows of each label, the first by a hash of the id.

    Only ids and labels move, and of a frequent label only the ids whose hash lies
    below a threshold that lets about twice ``per_label`` pass, so what is ranked
    does not grow with the table.  The choice does not depend on how rows are split.
    """
    known = rows.select("doc_id", F.col(label).alias("label")).filter("doc_id is not null and label is not null")
    counts = known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 4 * per_label).collect()
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(RANGE))
    low = F
    for r in counts:
        low = low.when(F.col("label") == r.label, place < math.ceil(RANGE * (2 * per_label + 50) / r.n))
    near = known.withColumn("place", place).filter(low.otherwise(True)) if counts else known.withColumn("place", place)
    order = Window.partitionBy("label").orderBy("place", "doc_id")
    return (near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_label)
            .select("doc_id", "label").distinct())


def texts_of(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, label) of a bounded sample; its ids are few, so they travel to the documents."""
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").filter("text is not null")
