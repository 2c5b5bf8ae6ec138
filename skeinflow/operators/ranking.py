"""Orders, limits and top sets of scored rows; ties are broken by a second column, so results are determined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top(df: DataFrame, n: int, score: str = "score", tie: str = "url") -> DataFrame:
    """The n rows of greatest score."""
    return df.orderBy(F.desc_nulls_last(score), F.asc(tie)).limit(n)


def top_distinct_scores(df: DataFrame, n: int, score: str = "score") -> DataFrame:
    return df.select(score).where(F.col(score).isNotNull()).distinct().orderBy(F.desc(score)).limit(n)


def ranked(df: DataFrame, n: int, score: str = "score", tie: str = "url") -> DataFrame:
    """The top n with their ranks from 1; only they meet in one task."""
    return top(df, n, score, tie).withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(score), F.asc(tie))).cast("int"))


def tied_groups(df: DataFrame, n: int, score: str = "score", tie: str = "url") -> DataFrame:
    """The top n with the number of their score's group, from 1."""
    return top(df, n, score, tie).withColumn("place", F.dense_rank().over(Window.orderBy(F.desc_nulls_last(score))).cast("int"))


def result_page(df: DataFrame, page: int, size: int = 10, score: str = "score", tie: str = "url") -> DataFrame:
    """Page ``page`` (from 1) of the ranked rows."""
    return ranked(df, page * size, score, tie).where(F.col("rank") > (page - 1) * size)


def threshold_set(freq: DataFrame, size: int = 200, key: str = "url", count: str = "n") -> DataFrame:
    """The keys whose count is at least the greatest threshold that still keeps ``size`` of them; all where there are fewer.

    The threshold comes from the histogram of counts, accumulated from the top: no loop, and no sort of the keys.  The
    histogram has one row for each distinct count.
    """
    histogram = freq.groupBy(count).agg(F.count(F.lit(1)).alias("keys"))
    kept = histogram.withColumn("kept", F.sum("keys").over(Window.orderBy(F.desc(count))))
    threshold = kept.where(F.col("kept") >= size).agg(F.max(count)).scalar()
    return freq.where(F.col(count) >= F.coalesce(threshold, F.lit(0)))
