"""All queries outside the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinflow.plans import catalogue, problems

QUERIES = {**problems.QUERIES, **catalogue.QUERIES}
SQL = {**problems.SQL, **catalogue.SQL}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.QUERIES["q4_search"](spark, folder)
