"""Registry of the driver's queries: a Spark callable and its oracle SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditspan.session import small_page_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; no SQL means rows-only."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def plan_once(fn):
    """Reuse the logical plan ``fn`` builds for a session and folder.

    Plans are immutable and lazy: this saves building large expressions again for
    every query, no data is kept.
    """
    plans: dict = {}

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (id(spark), spark.sparkContext.applicationId, sf_dir)
        if key not in plans:
            plans[key] = fn(spark, sf_dir)
        return plans[key]
    return build


def page_plan(fn):
    """``plan_once`` for plans that hand pages to Python.

    Spark reads the bound of a batch when a query runs, so a plan used again sets it again.
    """
    cached = plan_once(fn)

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_page_batches(spark)
        return cached(spark, sf_dir)
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
