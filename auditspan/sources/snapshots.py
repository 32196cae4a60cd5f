"""Stored snapshot events as input."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditspan import schemas


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SNAPSHOTS).parquet(path)


def stream_snapshots(spark: SparkSession, path: str, max_files: int | None = None,
                     max_bytes: str = "8g") -> DataFrame:
    """Arriving snapshot files, rate limited.

    The limit bounds a micro-batch, and with it the rows of one page that the
    stateful change job puts in order at a time.
    """
    reader = spark.readStream.schema(schemas.SNAPSHOTS)
    limited = (reader.option("maxBytesPerTrigger", max_bytes) if max_files is None
               else reader.option("maxFilesPerTrigger", max_files))
    return limited.parquet(path)
