"""Streams over files: windowed counts with late data, and an index that grows by increments.

Both run with the trigger ``availableNow`` by default and keep their checkpoints and results in the shared folder, so a
lost executor or driver goes on from the last increment.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.session import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """A stream of Parquet files; a path may also be one file, for which the last letter makes a pattern."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def _finish(writer, every: str | None) -> None:
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    writer.start().awaitTermination()


def hourly_counts(spark: SparkSession, path: str, late: str = "30 days", into: str | None = None, every: str | None = None, files: int = 100) -> DataFrame:
    """(start, event_type, n, value) by hour and type of the events stream.

    Events that come when the stream's time is more than ``late`` past the end of their hour are left out, and hours that
    are so old leave the state, which so holds the hours of that time only.  Each increment writes the hours that it changed
    under its own number, so one that is run again writes the same, and readers see whole increments: of each hour the last.
    """
    into = into or _folder(spark, "hourly")
    stream = _stream(spark, path, files).withColumn("ts", F.col("ts").cast("timestamp"))
    hours = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    counts = hours.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    flat = counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{into}/increment={number}")

    _finish(flat.writeStream.outputMode("update").option("checkpointLocation", _folder(spark, "state")).foreachBatch(save), every)
    last = spark.read.parquet(into).groupBy("start", "event_type").agg(F.max_by(F.struct("n", "value"), "increment").alias("l"))
    return last.select("start", "event_type", "l.n", "l.value")


def index_stream(spark: SparkSession, path: str, into: str | None = None, files: int = 4, every: str | None = None, limits: dict[str, int] | None = None) -> DataFrame:
    """(term, url, n, positions): postings of the pages of a crawl stream, ``files`` files an increment; the limits are
    those of ``pages_of``.

    An address that is fetched again replaces its postings: each increment writes its own folder with the time of its
    fetches, and readers take an address's postings of its last increment.
    """
    from skeinflow.plans.search import pages_of, word_postings

    into = into or _folder(spark, "index")
    stream = _stream(spark, path, files)

    def save(batch: DataFrame, number: int) -> None:
        seen = batch.where("page is not null and url is not null").groupBy("url").agg(F.max(F.struct("fetched_at", "page_id")).alias("at"))
        postings = word_postings(pages_of(batch, limits=limits), limits).join(seen, "url")
        postings.write.mode("overwrite").parquet(f"{into}/increment={number}")

    _finish(stream.writeStream.option("checkpointLocation", _folder(spark, "progress")).foreachBatch(save), every)
    rows = spark.read.parquet(into)
    last = rows.groupBy("url").agg(F.max("at").alias("at"))
    return rows.join(last, ["url", "at"], "left_semi").select("term", "url", "n", "positions")
