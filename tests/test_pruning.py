"""The filter before a semi-join changes no row."""

import pytest
from pyspark.sql import functions as F

from skeinflow.operators.pruning import pruned_semi
from tests.conftest import rows


@pytest.mark.parametrize("words", [1, 3, 1 << 17])
def test_pruned_semi(spark, words):
    df = spark.createDataFrame([(i % 500 if i % 7 else None, f"v{i}") for i in range(2000)], "k long, _v string")
    keys = spark.createDataFrame([(3,), (3,), (77,), (None,), (9999,)], "k int")
    want = rows(df.where("k in (3, 77, 9999)"))
    assert rows(pruned_semi(df, keys, "k", words)) == want and len(want) > 2
    assert pruned_semi(df, keys.limit(0), "k").count() == 0 and pruned_semi(df.limit(0), keys, "k").count() == 0


def test_most_rows_are_dropped_before_the_shuffle(spark):
    """The filter's join stands below the exchange of the rows."""
    df = spark.range(100_000).select(F.col("id").alias("k"), F.concat(F.lit("text "), "id").alias("v"))
    keys = spark.range(0, 100_000, 2000).select(F.col("id").alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = pruned_semi(df, keys, "k")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [x.strip() for x in plan.split("\n") if "Join" in x]
    assert "_w" in lines[-1] and "strategy=broadcast" in lines[-1] and len(lines) == 2
