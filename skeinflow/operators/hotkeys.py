"""Results by key where a handful of keys hold most rows.

Every result is algebraic (count, least row), so partial aggregates are made on the map side in bounded hash tables
that spill, and only one compact state per key and map task is shuffled: the work of a key doesn't grow with its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.operators.packed import unpack_links


def key_results(df: DataFrame, key: str | Column, order: str | Column) -> DataFrame:
    """(key_value, n, first) by key: number of rows and the least ``order`` of them.

    ``order`` should be a number, so that the states stay in hash aggregates.  Null keys are no keys.  An empty table
    gives no rows.
    """
    key = F.col(key) if isinstance(key, str) else key
    order = F.col(order) if isinstance(order, str) else order
    rows = df.select(key.alias("key_value"), order.alias("o")).where("key_value is not null")
    return rows.groupBy("key_value").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("first"))


def body_results(crawl: DataFrame) -> DataFrame:
    """(key_value, n, first): MD5 of a body, the crawled pages that have it, the least page_id of them."""
    pages = crawl.where("page is not null").select("page_id", F.md5(F.col("page").cast("binary")).alias("body")).distinct()
    return key_results(pages, "body", "page_id")


def link_results(state: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(key_value, n, first): link, how often it stands in the fields of distinct seq, the least seq that has it."""
    return key_results(unpack_links(state) if links is None else links, "link", "seq")


def with_first_url(results: DataFrame, rows: DataFrame, order: str, url: str) -> DataFrame:
    """Adds first_url, the ``url`` of the row that has the least ``order``; a join on a number, one row for each key."""
    urls = rows.groupBy(F.col(order).alias("first")).agg(F.min(url).alias("first_url"))
    return results.join(urls, "first", "left").select("key_value", "n", "first_url")


def heavy(results: DataFrame, percent: int) -> DataFrame:
    """Keys with at least ``percent`` % of all rows: at most 100/percent of them."""
    total = results.select(F.sum("n")).scalar()
    return results.where(F.col("n") * 100 >= F.lit(percent) * total)
