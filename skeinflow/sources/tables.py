"""Parquet tables by name, and the crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crawled_bodies(crawl: DataFrame) -> DataFrame:
    """(page_id, page) of every crawled page: distinct page_id, page not null; second deliveries count once.

    One shuffle by page_id behind a map-side combine, so copies of one page never meet in one task uncombined.  Should
    deliveries of one page_id differ, the least body is taken.
    """
    return crawl.where("page is not null").groupBy("page_id").agg(F.min("page").alias("page"))
