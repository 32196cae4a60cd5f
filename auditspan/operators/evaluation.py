"""Comparison of scanner results with hand labels and with earlier runs."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_with_labels(checks: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join; ``expected`` and ``status`` are upper/lower case tolerant.

    ``strict``: equal outcomes.  ``soft``: a warning also counts as a failure.
    Rows without a label or without a result are kept with NULL agreement.
    """
    joined = checks.select(*keys, F.lower("status").alias("status")).join(
        labels.select(*keys, F.lower("expected").alias("expected")), keys, "full")
    both = F.col("status").isNotNull() & F.col("expected").isNotNull()
    softened = F.when(F.col("status") == "warning", F.lit("fail")).otherwise(F.col("status"))
    return joined.withColumns({
        "strict": F.when(both, F.col("status") == F.col("expected")),
        "soft": F.when(both, (F.col("status") == F.col("expected")) | (softened == F.col("expected")))})


def agreement(compared: DataFrame, *by: str) -> DataFrame:
    strict, soft = F.count_if("strict"), F.count_if("soft")
    labelled = F.count("strict")
    return compared.groupBy(*by).agg(
        labelled.alias("labelled"), strict.alias("strict_matches"), soft.alias("soft_matches"),
        (strict / labelled).alias("strict_rate"), (soft / labelled).alias("soft_rate"),
        F.count_if(F.col("strict") == F.lit(False)).alias("misses"))


def compare_runs(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Status of two runs side by side; ``changed`` is null-safe."""
    return before.select(*keys, F.col("status").alias("was")).join(
        now.select(*keys, F.col("status").alias("now")), keys, "full"
    ).withColumn("changed", ~F.col("was").eqNullSafe(F.col("now")))
