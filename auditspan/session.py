"""Session helpers shared by jobs, tests and the benchmark."""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: bytes of pages that are handed to Python at once; one longer page goes alone
PAGE_BATCH = "2m"


def local_session(app: str = "auditspan", cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # call-site capture doubles the time it takes to build large expressions
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_page_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of pages holds by its bytes, so that a task's Python needs the same however long its part is."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", PAGE_BATCH)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, as named by the cluster.

    A local session without ``spark.checkpoint.dir`` (tests) gets a temporary
    folder; on a cluster its executors would not see it, so the setting is required.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint area."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Used where one expensive result (the parsed pages) feeds several jobs: it is
    computed once, survives the loss of executors, and each reader loads only the
    columns it needs.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
