"""Stored crawl tables as input."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspan import schemas
from auditspan.functions import urls

def read_crawl(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A crawl table with the explicit schema; missing columns are NULL."""
    return spark.read.schema(schemas.CRAWL).format(fmt).load(path)


def stream_crawl(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """The same table as a stream of arriving files."""
    return spark.readStream.schema(schemas.CRAWL).format(fmt).options(**options).load(path)


def from_pages(pages: DataFrame) -> DataFrame:
    """Crawl rows from a bare (page_id, url, html) table."""
    return pages.select(
        F.col("page_id").alias("page_ord"), "url", F.lit(200).alias("status_code"),
        F.lit("text/html").alias("content_type"), "html",
        F.array().cast("array<string>").alias("cookies"),
        F.lit(None).cast("string").alias("pdf_text"),
        F.lit(None).cast("string").alias("pdf_method"), F.lit(False).alias("is_fallback"))


def is_client_error(status: Column) -> Column:
    return status.between(400, 499)


def is_pdf(url: Column, content_type: Column) -> Column:
    return (F.lower(F.coalesce(content_type, F.lit(""))).contains("application/pdf")
            | F.lower(urls.path_of(url)).endswith(".pdf"))


def is_html_page(url: Column, status: Column, content_type: Column) -> Column:
    return F.coalesce(
        ~is_client_error(status) & ~is_pdf(url, content_type)
        & content_type.contains("text/html"), F.lit(False))


def probe_answered(is_fallback: Column, status: Column) -> Column:
    """False for a probe of a well-known path that did not answer with 200."""
    return ~F.coalesce(is_fallback, F.lit(False)) | F.coalesce(status == 200, F.lit(False))


def html_pages(crawl: DataFrame) -> DataFrame:
    return crawl.filter(is_html_page(F.col("url"), F.col("status_code"), F.col("content_type")))


def crawl_errors(crawl: DataFrame) -> DataFrame:
    """One row per fetch that ended with a 4xx status; probes of well-known paths may fail."""
    own = ~F.coalesce("is_fallback", F.lit(False))
    return crawl.filter(own & is_client_error(F.col("status_code"))).select(
        urls.site_of(F.col("url")).alias("site"), "page_ord", "url",
        F.concat(F.col("url"), F.lit(": HTTP "), F.col("status_code").cast("string")).alias("error"))


def first_fetches(crawl: DataFrame) -> DataFrame:
    """Keep the first fetch of every normalised URL of a site.

    ``min_by`` aggregates before the shuffle, so repeated fetches of one page
    do not pile up in one task.
    """
    row = F.struct(*[F.col(c) for c in crawl.columns])
    return (
        crawl.groupBy(urls.site_of(F.col("url")).alias("_site"),
                      urls.normalize_url(F.col("url")).alias("_url"))
        .agg(F.min_by(row, F.col("page_ord")).alias("_row")).select("_row.*"))


def policy_pdf_rows(crawl: DataFrame) -> DataFrame:
    """Policy documents delivered as extracted PDF text (NULL when unreadable)."""
    url = F.col("url")
    return crawl.filter(
        ~is_client_error(F.col("status_code")) & is_pdf(url, F.col("content_type"))
        & urls.is_policy_url(url)
    ).select(urls.site_of(url).alias("site"), "page_ord", "url",
             F.col("pdf_text").alias("text"), F.col("pdf_method").alias("extraction_method"))
